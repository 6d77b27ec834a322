"""The SQL surface against hand-computed values and the column builders."""

import pytest

from isovec.functions import sql
from isovec.operators import search


@pytest.fixture(scope="module")
def run(spark):
    sql.register(spark)
    return lambda text: spark.sql(f"SELECT {text} AS x").first()["x"]


def test_metrics(run):
    assert run("euclidean_squared_distance(array(0D, 0D), array(3D, 4D))") == 25
    assert run("euclidean_distance(array(0.1f, 0.2f), array(0.3f, 0.4f))") == pytest.approx(0.28284272195765997, abs=1e-15)
    assert run("manhattan_distance(array(1D, -2D), array(4D, CAST(NULL AS DOUBLE)))") is None
    bounds = "named_struct('offsets', array(10D, 10D), 'scale', 1D)"
    assert run(f"dot_product(array(1Y, 2Y), array(3Y, 4Y), {bounds})") == 311
    assert run("euclidean_squared_distance(array(0Y, 0Y), array(3Y, 4Y))") == 25
    assert run("cosine_similarity(unhex('000000040F'), unhex('0000000400'))") == -1
    assert run("hamming_distance(unhex('000000040F'), unhex('00000004FF'))") == 0


def test_codes_and_norms(run):
    bounds = "named_struct('offsets', array(0D, 0D), 'scale', 1D)"
    assert run(f"quantize_vector_int8(array(1000D, -2.5D), {bounds})") == [127, -2]
    assert bytes(run(f"quantize_vector_int1(array(1f, -1f), {bounds})")).hex() == "0000000201"
    assert run("l2_norm(array(3f, 4f))") == 5 and run("normalize_vector(array(3D, 4D))") == [0.6, 0.8]


def test_embedding(spark, run):
    df = spark.createDataFrame([("Alpha beta, beta ΟΔΟΣ 42",), ("!!!",)], "t string")
    mine = [r["vector"] for r in search.to_vector(df, "t", 64, "word", "double").orderBy("t").collect()]
    df.createOrReplaceTempView("texts")
    assert [r["x"] for r in spark.sql("SELECT to_vector_double(t, 64L, 'WORD') AS x FROM texts ORDER BY t").collect()] == mine
