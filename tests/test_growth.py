"""Plans that must hold for larger tables: no step in one task, nothing that grows sent through the driver."""

import contextlib
import io

import pytest

from tessella.plans import queries as core
from tessella.plans import sample_queries as more
from tessella.sources import rasters

QUERIES = core.QUERIES | more.QUERIES


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def many_suppliers(spark, tmp_path):
    spark.range(3 * rasters.IMAGES).selectExpr("id as s_suppkey", "cast(id % 25 as int) as s_nationkey", "0d as s_acctbal").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("made", [rasters.formula_pixels, rasters.block_pixels])
def test_images_of_formulas_spread_over_tasks(spark, many_suppliers, made):
    p = made(spark, many_suppliers)
    assert p.rdd.getNumPartitions() >= 3
    assert p.groupBy("image_id").count().where("count = 770").count() == 3 * rasters.IMAGES


@pytest.mark.parametrize("name", [*(f"orient_{k}" for k in range(1, 9)), "box_downsample", "edge_replicated", "upsample_replicate", "runs_raster"])
def test_pixels_are_not_broadcast(spark, sf_dir, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, sf_dir))


def test_replicated_samples_are_cut_to_the_size(spark):
    from pyspark.sql import functions as F

    from tessella.operators.samples import upsample_replicated

    plane = spark.createDataFrame([(1, y, x, y * 10 + x) for y in range(2) for x in range(3)], "image_id int, y int, x int, u int")
    got = {tuple(r) for r in upsample_replicated(plane, "u", F.lit(5), F.lit(3)).collect()}
    assert got == {(1, y, x, y // 2 * 10 + x // 2) for y in range(3) for x in range(5)}


@pytest.fixture
def long_texts(spark, tmp_path):
    texts = [(1, "ab"), (2, "x"), (3, ""), (4, None), (5, "é" * 4 * rasters.PIECE + "x"), (None, "abc"), *((k, "".join(chr(33 + k * j * j % 90) for j in range(rasters.PIECE + k % 5))) for k in range(10, 60))]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), {(k, x, v) for k, t in texts if t for x, v in enumerate(t.encode())}


@pytest.mark.parametrize("name", ["raster_r4", "byte_delta_undo"])
def test_bytes_of_texts_come_back(spark, long_texts, name):
    folder, want = long_texts
    got = [tuple(r) for r in QUERIES[name](spark, folder).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("name", ["raster_r4", "byte_delta", "byte_delta_undo"])
def test_pieces_of_texts_are_shuffled_but_not_bytes(spark, long_texts, name):
    # a file of one row group is one task; bytes get their rows in the last step
    lines = [line for line in plan(QUERIES[name](spark, long_texts[0])).splitlines() if any(k in line for k in ("MapInArrow", "Exchange", "Broadcast"))]
    assert "MapInArrow" in lines[0] and any("Exchange hashpartitioning(image_id" in line for line in lines) and not any("Broadcast" in line for line in lines)


def test_no_sketch_for_each_colour(spark, sf_dir):
    sketched = [line for line in plan(QUERIES["approximate_colours"](spark, sf_dir)).splitlines() if "approx_count_distinct" in line]
    assert sketched and all("keys=[x#" in line and ", r#" not in line.split("functions=")[0] for line in sketched)


def test_counts_before_ranges_are_not_broadcast(spark, sf_dir):
    assert "Broadcast" not in plan(rasters.lineitem_pixels(spark, sf_dir))


def test_rows_leave_folds_together(spark):
    import numpy as np

    from tessella.operators.lines import together

    assert list(together(np.array([0, 3, 6, 7, 20, 21]), 7)) == [(0, 3), (3, 4), (4, 5)]
    assert list(together(np.array([5, 5, 5]), 7)) == [(0, 2)]
    assert list(together(np.array([0]), 7)) == []


def test_groups_of_symbols_are_arrow_tables(spark, sf_dir):
    # a pandas frame for each of many small groups takes longer than its code lengths
    text = plan(QUERIES["prefix_codes"](spark, sf_dir))
    assert "FlatMapGroupsInArrow" in text and "FlatMapGroupsInPandas" not in text


def test_small_files_are_dealt_to_tasks():
    from tessella.sources.datasource import OPEN, ranges

    split = 64 << 20
    made = ranges([(f"{k}.tga", 1500, 0.0) for k in range(2000)], split)
    assert max(len(r.ranges) for r in made) <= split // OPEN and sum(len(r.ranges) for r in made) == 2000
    # a large file is cut as before
    assert [r.ranges for r in ranges([("a", 3 * split, 0.0)], split)] == [[("a", k * split, (k + 1) * split, 3 * split)] for k in range(3)]


@pytest.mark.parametrize("name", ["smoothed_planes", "edge_preserving_planes"])
def test_pixels_of_tiles_are_neither_sorted_nor_grouped_one_by_one(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Exchange hashpartitioning(image_id#" in text and "FlatMapGroupsInArrow" not in text
    dealt = [line for line in text.splitlines() if "Exchange hashpartitioning(image_id" in line and ", ty#" in line and ", tx#" in line]
    assert len(dealt) == 1 and text.count("MapInArrow") == 2


def test_samples_of_a_pyramid_are_shuffled_in_bundles(spark, sf_dir):
    text = plan(QUERIES["squeeze_roundtrip"](spark, sf_dir))
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning(image_id" in line and ", band#" in line]
    # six steps back, each over the steps that lead to its rests; windows only number line items
    assert len(moved) >= 12 and "collect_list" not in text and "lead(" not in text
