"""Registered queries against their SQL, over the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from isovec.plans import catalog

TABLES = Path(os.environ.get("ISOVEC_TABLES", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the test tables are not here")


@pytest.mark.parametrize("name", ["euclidean", "cosine_distance_double", "topk_global", "knn_agg_dot_product", "knn_agg_orders", "knn_agg_rollup",
                                  "bounds_agg", "quantize_int8", "quantize_int1_hex", "hamming", "int8_manhattan", "rerank_int1",
                                  "embed_word_tokens", "embed_word_norm"])
def test_query(spark, name):
    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = catalog.QUERIES[name](spark, str(TABLES))
    columns = sorted(found.columns)
    mine = sorted(tuple(map(str, r)) for r in found.select(columns).collect())
    theirs = sorted(tuple(map(str, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall())
    assert mine == theirs
