"""A corpus from raw documents to token ids, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that
its predecessor kept. All but the last return the columns of ``docs``, extra
ones included.

1. language_id: profiles are learnt from the documents with a language; texts
   without a letter, or far from every profile, go. A missing ``lang`` is filled.
2. near_dedup: of each group of near-duplicates the smallest doc_id stays. Of rows
   that share that id and the text, the least one by the other columns stays; texts
   that differ stay, as neither is a copy of the other.
3. pii: personal data and secrets in the text are replaced by their kind.
4. mixing: documents are chosen to meet the target weights of the tree of
   domains, languages and sources; a second epoch of a document is a second row.
5. bpe: token ids.

Null texts have no letter and go in the first stage. Rows without a doc_id
can't be compared and stay in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, language, minhash, mixing, pii
from tessella.llm.queries import tokenizer_path
from tessella.llm.store import dropped, released, so_far, stored

#: Documents further from every profile than this are no language that was learnt.
LEAST_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language."""
    # columns of the input may be called like those of the prediction
    columns = [f"in_{c}" for c in docs.columns]
    named = docs.toDF(*columns).withColumnsRenamed({"in_doc_id": "doc_id", "in_text": "text"})
    rest = tuple(c for c in named.columns if c != "doc_id")
    judged = language.identify(named, language.learn(docs), keep=rest)
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumn("in_lang", F.coalesce("in_lang", "lang_pred"))
    return kept.select(*named.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not rest:
        one = rows.dropDuplicates()
    else:
        least = F.min_by(F.struct(*rest), F.to_json(F.struct(*rest)))
        one = rows.groupBy("doc_id", "text").agg(least.alias("_rest")).select("doc_id", "text", "_rest.*")
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text; ``n_chars`` follows."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chooses documents by target weights; one row for each epoch of a document.

    The last document of a leaf's budget is cut after the words that the budget has room for.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", redact_pii), ("mixing", mix), ("bpe", encode)]
#: SQL can't express language identification by learnt profiles and what follows from it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, mark = docs, so_far()
        docs = stored(stage(spark, docs, sf_dir))
        # what the stage stored on its way, and its input
        released(spark, mark, docs)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
