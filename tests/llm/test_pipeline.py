"""The pipeline against brute force, stage by stage on its own input."""

import brute
import duckdb
import pyarrow as pa

import corpus_pipeline
from tessella.llm import oracle


def test_pipeline_against_brute_force(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "pii", "mixing", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, None, "src1", 0), (10_002, "12 + 34", "en", "src1", 7), (10_003, "the that of and ing", None, "src2", 19)], docs.schema)
    inputs = {"language_id": docs.limit(120).unionByName(extra).toPandas()}
    names = list(stages)
    for name, after in zip(names, [*names[1:], "out"]):
        df = spark.createDataFrame(inputs[name], docs.schema)
        inputs[after] = stages[name](spark, df, sf_dir).toPandas()

    before, after = inputs["language_id"], inputs["near_dedup"]
    assert set(before.doc_id) - set(after.doc_id) == {10_001, 10_002}
    assert after.set_index("doc_id").lang[10_003] == "en"

    groups = brute.near_duplicates(list(zip(after.doc_id, after.text)))
    assert sorted(inputs["pii"].doc_id) == sorted(i for i, (_, _, kept) in groups.items() if kept)

    clean = inputs["mixing"].set_index("doc_id")
    for i, text in zip(inputs["pii"].doc_id, inputs["pii"].text):
        spans = brute.base_pii(text)
        if not spans:
            assert len(clean.text[i]) <= len(text)
        for _, a, b in spans:
            assert text[a:b] not in clean.text[i]
        assert clean.n_chars[i] == len(clean.text[i])

    con = duckdb.connect()
    con.register("documents", pa.Table.from_pandas(inputs["mixing"]))
    want = [r[0] for r in con.execute(f"SELECT doc_id FROM ({oracle.MIXING}) WHERE take_tokens > 0").fetchall()]
    assert sorted(inputs["bpe"].doc_id) == sorted(want)

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    # a document of two epochs is two rows, of which one may be cut
    rows = inputs["bpe"]
    encoded = [(i, t.encode(text, add_special_tokens=False).ids) for i, text in zip(rows.doc_id, rows.text)]
    out = inputs["out"]
    assert sorted(encoded) == sorted((i, list(ids)) for i, ids in zip(out.doc_id, out.ids)) and list(out.n_tokens) == list(map(len, out.ids))
    whole = inputs["mixing"].set_index("doc_id").text
    chosen = {}
    for r in con.execute(f"SELECT doc_id, tokens, take_tokens FROM ({oracle.MIXING}) WHERE take_tokens > 0").fetchall():
        chosen.setdefault(r[0], []).append(whole[r[0]] if r[1] == r[2] else " ".join(whole[r[0]].split()[: r[2]]))
    assert {i: sorted(rows[rows.doc_id == i].text) for i in chosen} == {i: sorted(v) for i, v in chosen.items()}


def test_near_dedup_keeps_every_text_that_is_no_copy(spark):
    import random

    r = random.Random(2)
    text = lambda: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(40))
    a, b = text(), text()
    docs = [(1, b, "x", "s2"), (1, b, "x", "s1"), (1, a, "x", "s1"), (2, a + " tail", "x", "s1"), (None, b, "x", "s1"), (None, b, "x", "s1")]
    want = sorted([(1, b, "x", "s1"), (1, a, "x", "s1"), (None, b, "x", "s1"), (None, b, "x", "s1")], key=str)
    for parts in (1, 2, 4):
        r.shuffle(docs)
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(parts)
        got = corpus_pipeline.near_dedup(spark, df, "")
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == want


def test_stored_tables_are_released(spark, tmp_path):
    import os

    from tessella.llm import store

    mark = store.so_far()
    a, b = store.stored(spark.range(5)), store.stored(spark.range(7))
    store.released(spark, mark, b)
    assert not os.path.exists(a._tessella_path) and b.count() == 7 and store.so_far() == mark + 1
    store.released(spark, mark)
    assert not os.path.exists(b._tessella_path) and store.so_far() == mark
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(store.BATCH_BYTES)
