"""Core queries against their SQL, on the smallest tables."""

import pytest
import test_codes
import test_palettes

from tessella.plans import sample_queries
from tessella.plans.oracle import ORACLE as CORE
from tessella.plans.queries import QUERIES as CORE_QUERIES

ORACLE, QUERIES = CORE | sample_queries.ORACLE, CORE_QUERIES | sample_queries.QUERIES
#: Queries that have no SQL, with the test that holds them.
NO_SQL = {"context_trees": "test_context_trees_match_a_plain_learner", "median_cut_palettes": "test_palettes_match_a_plain_splitter", "dithered_indices": "test_indices_match_the_serial_rule"}

#: One of each family; the driver compares all of them.
SOME = ["raster_r1", "raster_r2", "raster_r3", "raster_r4", "channel_order_abgr", "orient_6", "oriented_dims", "white_composite", "matte_composite", "rgb_to_ycbcr", "ycbcr_to_rgb", "yuv_limited", "chroma_420", "rct_forward", "rct_roundtrip", "unpremultiply", "float_to_byte", "bilevel_threshold", "combine_xnor", "png_filter_choice", "gradient_residual", "horizontal_predictor_undo", "byte_delta", "runs_raster", "runs_rows", "hist555", "first_colour_cell", "channel_entropy", "box_downsample", "encode_bmp", "encode_tga", "encode_tiff", "roundtrip_bmp", "joined_segments", "stream_states", "arriving_totals", "sniff_signatures", "sniff_formats", "inspect_headers", "png_chunks", "file_outcomes", "metadata_headers", "metadata_written", "format_cube", "roundtrip_tga", "roundtrip_tiff", "flagship"]


def rows(values):
    return sorted(tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in values)


@pytest.mark.parametrize("name", [*SOME, *sample_queries.ORACLE])
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*cols).collect())
    con = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})")
    assert got == rows(con.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) | set(NO_SQL) and all(hasattr(test_codes, f) or hasattr(test_palettes, f) for f in NO_SQL.values())


def test_primaries_matrix():
    import numpy as np

    from tessella.functions.light import D65, SRGB_PRIMARIES, primaries_matrix
    from tessella.plans.sample_queries import BT2020

    # fixed values: the published matrix from linear BT.2020 to linear sRGB
    want = [[1.6605, -0.5876, -0.0728], [-0.1246, 1.1329, -0.0083], [-0.0182, -0.1006, 1.1187]]
    assert np.abs(primaries_matrix(BT2020) - want).max() < 1e-4
    assert np.allclose(primaries_matrix(SRGB_PRIMARIES, D65), np.eye(3))
    # another white becomes white
    assert np.allclose(primaries_matrix(SRGB_PRIMARIES, (0.3457, 0.3585)).sum(1), 1, atol=1e-9)


def test_entry_has_a_row_per_image(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["image_id", "n_pixels", "mean_r", "mean_g", "mean_b", "n_colours"]
    assert df.count() > 0


def test_names_need_no_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= int(out[1]) >= 80
