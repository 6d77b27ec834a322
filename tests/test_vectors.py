"""Hand-computed values, error messages, null rules and plans of the vector engine."""

import math

import pytest
from pyspark.sql import functions as F

from isovec.functions import codes, embed, exact, metric
from isovec.operators import search


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*xs, kind="double"):
    return F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")


def bounds(offsets, scale):
    return F.struct(vec(*offsets).alias("offsets"), F.lit(float(scale)).alias("scale"))


def test_exact_values(spark):
    assert value(spark, exact.euclidean_squared_distance(vec(0, 0), vec(3, 4))) == 25
    assert value(spark, exact.manhattan_distance(vec(1, -2), vec(4, 2))) == 7
    assert value(spark, exact.euclidean_distance(vec(0.1, 0.2, kind="float"), vec(0.3, 0.4, kind="float"))) == 0.28284272195765997
    assert value(spark, exact.euclidean_distance(vec(0.1, 0.2), vec(0.3, 0.4))) == pytest.approx(0.282842712474619)
    assert value(spark, exact.cosine_similarity(vec(0.1, 0.7), vec(0.1, 0.7))) == 1
    assert value(spark, exact.l2_norm(F.array().cast("array<double>"))) == 0


def test_exact_extremes(spark):
    assert value(spark, exact.cosine_similarity(vec(1e200, 0), vec(1e200, 1e200))) == pytest.approx(math.sqrt(0.5))
    assert value(spark, exact.cosine_similarity(vec(1e-200, 0), vec(1e-200, 1e-200))) == pytest.approx(math.sqrt(0.5))
    assert value(spark, exact.l2_norm(vec(3e200, 4e200))) == pytest.approx(5e200)
    assert value(spark, exact.normalize_vector(vec(3, 4, kind="float"), "float")) == pytest.approx([0.6, 0.8])


@pytest.mark.parametrize("column, message", [
    (lambda: exact.euclidean_distance(vec(1, None), vec(1, 2, 3)), exact.SAME_LENGTH),
    (lambda: exact.cosine_similarity(vec(0, 0), vec(1, 2)), exact.NO_MAGNITUDE),
    (lambda: exact.normalize_vector(vec(0, 0)), exact.NO_MAGNITUDE),
    (lambda: codes.quantize_int8(vec(1, 2, None), bounds([0, 0], 1)), "fitted on 2"),
    (lambda: codes.hamming_distance(F.unhex(F.lit("0000")), F.unhex(F.lit("0000"))), codes.NOT_BINARY),
    (lambda: codes.hamming_distance(F.unhex(F.lit("000000040F")), F.unhex(F.lit("00000008FF"))), exact.SAME_LENGTH),
])
def test_errors(spark, column, message):
    with pytest.raises(Exception, match=message):
        value(spark, column())


def test_nulls(spark):
    assert value(spark, exact.euclidean_distance(vec(1, None), vec(1, 2))) is None
    assert value(spark, exact.dot_product(F.lit(None).cast("array<double>"), vec(1, 2))) is None
    assert value(spark, codes.quantize_int8(vec(1, None), bounds([0, 0], 1))) is None


def test_codes(spark):
    unit = bounds([0, 0], 1)
    assert value(spark, codes.quantize_int8(vec(1000, -1000), unit)) == [127, -128]
    assert value(spark, codes.quantize_int8(vec(-2.5, 2.5), unit)) == [-2, 3]
    assert value(spark, codes.quantize_int8(vec(float("nan"), 1), bounds([0, 0], 0))) == [0, 0]
    assert bytes(value(spark, codes.quantize_int1(vec(1, -1), unit))).hex() == "0000000201"
    assert bytes(value(spark, codes.quantize_int1(vec(float("nan"), 0), unit))).hex() == "0000000202"
    tiny = lambda *x: vec(*x, kind="tinyint")
    assert value(spark, codes.int8_euclidean_squared_distance(tiny(0, 0), tiny(3, 4), bounds([0, 0], 2))) == 100
    assert value(spark, codes.int8_dot_product(tiny(1, 2), tiny(3, 4), bounds([10, 10], 1))) == 311
    assert value(spark, codes.int8_manhattan_distance(tiny(-128, 0), tiny(127, 0), bounds([0, 0], -1))) == 255


def test_int8_cosine_edges(spark):
    """Only a vector of zeros is an error; extreme bounds are passed on."""
    tiny = lambda *x: vec(*x, kind="tinyint")
    of = lambda b, y=(3, 4): value(spark, codes.int8_cosine_similarity(tiny(1, 2), tiny(*y), b))
    assert math.isnan(of(bounds([0, 0], float("inf")))) and of(bounds([0, 0], 1e-70)) == pytest.approx(11 / math.sqrt(125))
    assert not math.isfinite(of(bounds([0, 0], 1e-90)))
    with pytest.raises(Exception, match=exact.NO_MAGNITUDE):
        of(bounds([0, 0], 1), (0, 0))


def test_binary_metrics(spark):
    ones, zeros, dirty = (F.unhex(F.lit(x)) for x in ("000000040F", "0000000400", "00000004FF"))
    got = [value(spark, getattr(codes, n)(ones, zeros)) for n in (
        "hamming_distance", "int1_euclidean_squared_distance", "int1_euclidean_distance", "int1_manhattan_distance", "int1_dot_product",
        "int1_cosine_similarity")]
    assert got == [4, 16, 4, 8, -4, -1]
    assert value(spark, codes.hamming_distance(ones, dirty)) == 0


@pytest.fixture(scope="module")
def points(spark):
    rows = [(1, "a", [0.0, 0.0]), (1, "b", [1.0, 0.0]), (2, "c", [2.0, 0.0]), (2, "d", [3.0, 0.0]), (3, "e", None), (2, None, [2.5, 0.0]), (2, "f", [None, 1.0])]
    return spark.createDataFrame(rows, "g int, id string, v array<double>").withColumn("q", F.array(F.lit(0.0), F.lit(0.0)))


def test_knn(points):
    got = {r["g"]: r["neighbours"] and [(n["key"], n["distance"]) for n in r["neighbours"]]
           for r in search.knn_agg(points, "id", "v", "q", 2, "EUCLIDEAN", ("g",)).collect()}
    assert got == {1: [("a", 0.0), ("b", 1.0)], 2: [("c", 2.0), (None, 2.5)], 3: None}
    far = search.knn_agg(points.withColumn("q", F.array(F.lit(1.0), F.lit(0.0))), "id", "v", "q", 1, "dot_product").first()["neighbours"]
    assert [(n["key"], n["distance"]) for n in far] == [("d", 3.0)]
    assert search.knn_agg(points.where("false"), "id", "v", "q", 1, "cosine").first()["neighbours"] is None


def test_knn_arguments(points):
    for k, name, message in ((0, "cosine", "k must be greater than zero, got 0"), (10001, "cosine", "less than or equal to 10000; found 10001"),
                             (1, "hamming", "Unknown metric 'hamming'")):
        with pytest.raises(ValueError, match=message):
            search.knn_agg(points, "id", "v", "q", k, name)
    assert metric.higher_is_closer("Dot_Product") and not metric.higher_is_closer("cosine")


def test_knn_plan(points):
    plan = search.nearest(points, "id", "v", "q", 2, "euclidean", ("g",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    plan = search.nearest(points, "id", "v", "q", 2, "euclidean")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_knn_distance_once(points):
    """The distance is computed once a row, and a group that has none needs no second scan."""
    plan = search.nearest(points, "id", "v", "q", 2, "manhattan")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with") == 1
    plan = search.knn_agg(points, "id", "v", "q", 2, "euclidean", ("g",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_bounds_of_empty_vectors(spark):
    rows = spark.createDataFrame([(1, []), (2, []), (2, [1.0]), (3, None), (3, [None]), (4, [1.0]), (4, [3.0])], "g int, v array<double>")
    got = {r["g"]: r["bounds"] for r in search.vector_bounds_agg(rows.where("g <> 2"), "v", ("g",)).collect()}
    assert got[1].asDict() == {"offsets": [], "scale": 0.0} and got[3] is None and got[4].asDict() == {"offsets": [2.0], "scale": 2 / 255}
    with pytest.raises(Exception, match=exact.SAME_LENGTH):
        search.vector_bounds_agg(rows, "v", ("g",)).collect()


def test_bounds(spark):
    df = spark.createDataFrame([([0.0, 100.0],), ([1.0, 101.0],), ([None, 5.0],), (None,)], "v array<double>")
    b = search.vector_bounds_agg(df, "v").first()["bounds"]
    assert b["offsets"] == [0.5, 100.5] and b["scale"] == 1 / 255
    assert search.vector_bounds_agg(df.where("false"), "v").first()["bounds"] is None


def test_rerank(points):
    rows = points.where("id in ('a', 'b', 'c', 'd')").withColumn("b", F.expr("named_struct('offsets', array(0D, 0D), 'scale', 1D)"))
    rows = rows.withColumn("c", codes.quantize_int8(F.col("v"), F.col("b"))).withColumn("qc", codes.quantize_int8(F.col("q"), F.col("b")))
    assert [r["key"] for r in search.knn_rerank(rows, "id", "c", "qc", "v", "q", 2, 2, "euclidean", bounds="b").orderBy("rank").collect()] == ["a", "b"]


def test_embedding(spark):
    texts = ["alpha beta gamma delta", "zeta alpha beta gamma", "north south east west", "!!!", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["vector"] for r in search.to_vector(df, "t", 4096, "word", "double").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(got[a], got[b], strict=True))
    assert dot(0, 1) == pytest.approx(0.75, abs=1e-9) and dot(0, 2) == pytest.approx(0, abs=1e-9) and dot(0, 0) == pytest.approx(1)
    assert got[3] == [0.0] * 4096 and got[4] is None
    assert value(spark, embed.tokens(F.lit("user_42 id-7 ΟΔΟΣ"), "word")) == ["user", "42", "id", "7", "οδοσ"]
    assert value(spark, embed.tokens(F.lit("hi"), "char_3gram")) == []
    with pytest.raises(ValueError, match="between 1 and 65536, got 0"):
        embed.resolve("word", 0)
    with pytest.raises(ValueError, match="Unknown embedding algorithm 'x'"):
        embed.resolve("x", 3)


def test_embedding_columns(spark):
    """All algorithms against the definition, dimension and algorithm as columns, without an exchange."""
    import xxhash

    texts = ["Alpha beta, beta ΟΔΟΣ 42 é", "!!!", "x", "漢字 river river stone"]
    rows = [(t, n, a) for t in texts for n in (1, 7, 64) for a in embed.ALGORITHMS]
    df = spark.createDataFrame([*rows, (None, 3, "word"), ("x", None, "word")], "t string, n int, a string")
    found = search.to_vector(df, "t", F.col("n"), F.col("a"), "double")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        if r["t"] is None or r["n"] is None:
            assert r["vector"] is None
            continue
        low = r["t"].replace("Σ", "σ").lower()
        tokens = "".join(c if c.isalnum() else " " for c in low).split() if r["a"] == "word" else [
            low[k:k + int(r["a"][5])] for k in range(len(low) - int(r["a"][5]) + 1)]
        v = [0.0] * r["n"]
        for w in tokens:
            h = xxhash.xxh64_intdigest(w.encode())
            v[(h >> 32) * r["n"] >> 32] += -1 if h >> 31 & 1 else 1
        norm = math.sqrt(sum(x * x for x in v))
        assert r["vector"] == pytest.approx([x / norm for x in v] if norm else v)
    for n, a, message in ((0, "word", "between 1 and 65536, got 0"), (3, "x", "Unknown embedding algorithm 'x'")):
        with pytest.raises(Exception, match=message):
            search.to_vector(df.limit(1).selectExpr("t", f"{n} AS n", f"'{a}' AS a"), "t", F.col("n"), F.col("a")).collect()


def test_tables_and_streams(spark, tmp_path):
    """Codes are written beside the rows and read alone; distances and embeddings run on a stream, rankings by micro-batch."""
    from isovec.sources import tables
    from isovec.streaming import search as streaming

    rows = spark.createDataFrame([(k, [float(k), 1.0 - k], f"word {k}") for k in range(6)], "id long, v array<double>, t string")
    rows.write.parquet(str(tmp_path / "rows.parquet"))
    tables.write_codes(rows, "v", search.vector_bounds_agg(rows, "v"), str(tmp_path / "codes.parquet"))
    coded = tables.read_table(spark, str(tmp_path), "codes").orderBy("id").collect()
    assert [r["code_int8"] for r in coded][::5] == [[-127, 128 - 1], [128 - 1, -127]] and len(coded[0]["code_int1"]) == 5
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "*rows.parquet"))
    found, ranked = [], []
    for frame, sink in ((streaming.with_distance(search.to_vector(stream, "t", 8), "v", [0.0, 1.0], "manhattan"), found),):
        frame.writeStream.foreachBatch(lambda b, _: sink.extend(b.collect())).trigger(availableNow=True).start().awaitTermination()
    streaming.nearest_per_batch(stream, "id", "v", [0.0, 1.0], 2, "manhattan", lambda b, _: ranked.extend(b.collect())).trigger(
        availableNow=True).start().awaitTermination()
    assert {r["id"]: r["distance"] for r in found} == {k: 2.0 * k for k in range(6)} and all(len(r["vector"]) == 8 for r in found)
    assert sorted((r["rank"], r["key"]) for r in ranked) == [(1, 0), (2, 1)]


@pytest.mark.parametrize("kind, oversample, floor", [("int8", 1, 0.96), ("int1", 10, 0.86)])
def test_recall(spark, kind, oversample, floor):
    """Shortlists on codes against exact search: 500 uniform vectors of 32 components, 5 queries, k = 10."""
    import random

    rng = random.Random(11)
    rows = spark.createDataFrame([(k, [rng.random() for _ in range(32)]) for k in range(500)], "id long, v array<double>")
    rows = rows.crossJoin(search.vector_bounds_agg(rows, "v")).withColumn(
        "c", (codes.quantize_int8 if kind == "int8" else codes.quantize_int1)(F.col("v"), F.col("bounds"))).cache()
    hit = 0
    for q in range(5):
        beside = rows.crossJoin(rows.where(F.col("id") == q).select(F.col("v").alias("q"), F.col("c").alias("qc")))
        true = {r["key"] for r in search.nearest(beside, "id", "v", "q", 10, "euclidean").collect()}
        near = search.knn_rerank(beside, "id", "c", "qc", "v", "q", 10, oversample, "euclidean", bounds="bounds" if kind == "int8" else None)
        hit += len(true & {r["key"] for r in near.collect()})
    assert hit / 50 >= floor
