"""The data source: batches, byte ranges, pushed filters, committed writes and streams."""

import os
import struct

import pytest

from tessella.operators import files
from tessella.plans import sample_queries
from tessella.sources import datasource, rasters


@pytest.fixture(scope="module")
def known(spark):
    datasource.register(spark)
    return spark


def written(spark, sf_dir, kind="bmp"):
    return getattr(files, f"write_{kind}")(rasters.lineitem_pixels(spark, sf_dir))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("kind", ["bmp", "tga", "tiff"])
def test_what_is_written_is_read_as_the_columns_read_it(known, sf_dir, tmp_path, kind):
    made = written(known, sf_dir, kind)
    made.select("image_id", "content").write.format("raster").option("kind", kind).mode("append").save(str(tmp_path))
    want = rows(getattr(files, f"read_{kind}")(made).select("image_id", "y", "x", *"rgba"))
    for split in (64 << 20, 300):
        got = known.read.format("raster").option("splitBytes", split).load(str(tmp_path))
        assert got.where(f"format <> '{kind}'").count() == 0
        assert rows(got.selectExpr("cast(regexp_extract(path, '([0-9]+)-[0-9]+[.]', 1) as bigint) as image_id", "y", "x", *"rgba")) == want
    if kind == "bmp":
        assert known.read.format("raster").option("splitBytes", 300).load(str(tmp_path)).rdd.getNumPartitions() > 10


def test_filters_are_pushed(known, sf_dir, tmp_path, monkeypatch):
    written(known, sf_dir).select("image_id", "content").write.format("raster").mode("append").save(str(tmp_path))
    df = known.read.format("raster").load(str(tmp_path))
    some = df.where("y >= 1 and y < 3 and format = 'bmp' and width = 16 and height in (40, 41, 42) and r > 100")
    plan = some._jdf.queryExecution().executedPlan().toString()
    # what was pushed is not looked at again, the rest is
    assert "Filter" in plan and "r#" in plan.split("Filter", 1)[1].split("\n")[0] and "height" not in plan.split("Filter", 1)[1].split("\n")[0]
    assert rows(some) == sorted(x for x in rows(df) if 1 <= x[4] < 3 and x[3] in (40, 41, 42) and x[6] > 100)
    reader = datasource.RasterReader(datasource.Options({"path": str(tmp_path)}))
    one = reader.options.listed()[0][0]
    ds = datasource.ds
    rest = list(reader.pushFilters([ds.EqualTo(("path",), one), ds.GreaterThan(("y",), 0), ds.IsNotNull(("y",)), ds.GreaterThan(("r",), 3)]))
    assert [f.attribute for f in rest] == [("r",)]
    parts = reader.partitions()
    assert [r[0] for p in parts for r in p.ranges] == [one]
    assert min(y for p in parts for b in reader.read(p) for y in b.column("y").to_pylist()) == 1


def test_damaged_files_are_left_out_or_an_error(known, tmp_path):
    bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 24, 0, 0, 0, 0, 0, 0) + bytes(range(6)) + bytes(2)
    for name, data in {"good.bmp": bmp, "cut.bmp": bmp[:56], "short.bmp": b"BM", "empty.tga": b"", "text.txt": b"some words that are longer", "far.tiff": b"II*\0\xff\xff\xff\x0f", "big.tiff": b"MM\0*" + bytes(9)}.items():
        (tmp_path / name).write_bytes(data)
    df = known.read.format("raster").load(str(tmp_path))
    assert [(os.path.basename(r[0]), *r[1:]) for r in rows(df)] == [("good.bmp", "bmp", 2, 1, 0, 0, 2, 1, 0, 255), ("good.bmp", "bmp", 2, 1, 0, 1, 5, 4, 3, 255)]
    with pytest.raises(Exception, match="truncated|unknown|no reader"):
        known.read.format("raster").option("mode", "FAILFAST").load(str(tmp_path)).count()
    with pytest.raises(Exception, match="path"):
        known.read.format("raster").load().count()


def test_only_committed_folders_are_read(known, sf_dir, tmp_path):
    made = written(known, sf_dir).select("image_id", "content")
    made.write.format("raster").mode("append").save(str(tmp_path))
    n = known.read.format("raster").load(str(tmp_path)).count()
    lost = tmp_path / "part-000000-lost"
    lost.mkdir()
    (lost / "1-0.bmp").write_bytes(bytes(made.first().content))
    assert known.read.format("raster").load(str(tmp_path)).count() == n
    made.limit(1).write.format("raster").mode("append").save(str(tmp_path))
    assert known.read.format("raster").load(str(tmp_path)).count() > n
    made.limit(2).write.format("raster").mode("overwrite").save(str(tmp_path))
    assert len(datasource.Options({"path": str(tmp_path)}).listed()) == 2 and not lost.exists()


def test_an_aborted_write_leaves_nothing(known, tmp_path):
    writer = datasource.RasterWriter(datasource.Options({"path": str(tmp_path)}), False)
    (tmp_path / "part-x").mkdir()
    writer.abort([datasource.Written("part-x", 1), None, datasource.Written("none", 0)])
    assert os.listdir(tmp_path) == []


def test_a_stream_sees_each_file_once(known, sf_dir, tmp_path):
    made = written(known, sf_dir).select("image_id", "content")
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    batch = [(r.image_id, bytes(r.content)) for r in made.limit(6).collect()]

    def run():
        df = known.readStream.format("raster").option("settleMs", 0).load(str(source))
        query = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", str(out)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return known.read.parquet(str(out))

    for n in (3, 6):
        for image_id, content in batch[n - 3 : n]:
            (source / f"{image_id}.bmp").write_bytes(content)
        got = run()
        assert got.select("path").distinct().count() == n
        assert got.count() == known.read.format("raster").load(str(source)).count()


def test_query_goes_through_the_source(known, sf_dir):
    assert "raster_source" in sample_queries.QUERIES
