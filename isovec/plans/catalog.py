"""The vector engine's registered queries and the SQL that checks them.

Doubles are rounded to six digits on both sides, since engines add up in
different orders; adding 0.0 makes a rounded negative zero a plain one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, embed, exact, metric, sql
from ..operators import search
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DIGITS = 6


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def rounded(x: Column | str) -> Column:
    return F.round(x, DIGITS) + 0.0


def vectors(spark: SparkSession, sf_dir: str, width: str = "float") -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast(f"array<{width}>").alias("v"))


def with_query(rows: DataFrame, column: str = "v", into: str = "q", vec_id: int = 0) -> DataFrame:
    """``rows`` with the vector of one id, a single row, beside each."""
    return rows.crossJoin(F.broadcast(rows.where(F.col("vec_id") == vec_id).select(F.col(column).alias(into)).limit(1)))


PAIRS = "SELECT e.vec_id, e.label, CAST(e.embedding AS DOUBLE[]) AS x, CAST(q.embedding AS DOUBLE[]) AS y FROM embeddings e, embeddings q WHERE q.vec_id = 0"
ON_PAIRS = {
    "euclidean_squared": "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    "euclidean": "list_distance(x, y)",
    "manhattan": "list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])))",
    "dot_product": "list_inner_product(x, y)",
    "cosine_similarity": "list_cosine_similarity(x, y)",
    "cosine_distance": "1 - list_cosine_similarity(x, y)",
}
EXACT = {"euclidean_squared": exact.euclidean_squared_distance, "euclidean": exact.euclidean_distance, "manhattan": exact.manhattan_distance,
         "dot_product": exact.dot_product, "cosine_similarity": exact.cosine_similarity, "cosine_distance": exact.cosine_distance}


def _exact(function: Callable[[Column, Column], Column], width: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = with_query(vectors(spark, sf_dir, width))
        return rows.select("vec_id", rounded(function(F.col("v"), F.col("q"))).alias("value"))

    return run


for _name, _function in EXACT.items():
    for _width, _suffix in (("float", ""), ("double", "_double")):
        query(f"SELECT vec_id, round({ON_PAIRS[_name]}, {DIGITS}) + 0.0 AS value FROM ({PAIRS})", _name + _suffix)(_exact(_function, _width))


def _norm(width: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir, width)
        return rows.select("vec_id", rounded(exact.l2_norm(F.col("v"))).alias("norm"),
                           rounded(exact.l2_norm(F.transform("v", lambda x: x * 3))).alias("norm_of_triple"))

    return run


def _normal(width: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tripled = F.transform("v", lambda x: x * 3).cast(f"array<{width}>")
        return (vectors(spark, sf_dir, width).select("vec_id", F.posexplode(exact.normalize_vector(tripled, width)).alias("i", "x"))
                .select("vec_id", F.col("i").cast("bigint").alias("i"), rounded(F.col("x").cast("double")).alias("x")))

    return run


for _width, _suffix in (("float", ""), ("double", "_double")):
    query(f"""SELECT vec_id, round(sqrt(list_inner_product(x, x)), {DIGITS}) + 0.0 AS norm,
        round(3 * sqrt(list_inner_product(x, x)), {DIGITS}) + 0.0 AS norm_of_triple
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)""", "l2_norm" + _suffix)(_norm(_width))
    query(f"""SELECT vec_id, i, round(CAST({'CAST(v / n AS FLOAT)' if _width == 'float' else 'v / n'} AS DOUBLE), {DIGITS}) + 0.0 AS x
        FROM (SELECT vec_id, unnest(range(len(x))) AS i, unnest(x) AS v, sqrt(list_inner_product(x, x)) AS n
              FROM (SELECT vec_id, CAST({'list_transform(embedding, lambda e: CAST(e * 3 AS FLOAT))' if _width == 'float'
                    else 'list_transform(CAST(embedding AS DOUBLE[]), lambda e: e * 3)'} AS DOUBLE[]) AS x FROM embeddings))""",
          "normalize_vector" + _suffix)(_normal(_width))


@query(f"""SELECT CAST(row_number() OVER (ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id AS key, round(d, {DIGITS}) + 0.0 AS distance
    FROM (SELECT vec_id, {ON_PAIRS['euclidean']} AS d FROM ({PAIRS})) ORDER BY d, vec_id LIMIT 10""")
def topk_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.nearest(with_query(vectors(spark, sf_dir)), "vec_id", "v", "q", 10, "euclidean")
    return found.withColumn("distance", rounded("distance"))


@query(f"""SELECT vec_id, round({ON_PAIRS['euclidean']}, {DIGITS}) + 0.0 AS distance FROM ({PAIRS})
    ORDER BY {ON_PAIRS['euclidean']}, vec_id LIMIT 10""")
def topk_order_by_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_query(vectors(spark, sf_dir)).select("vec_id", exact.euclidean_distance(F.col("v"), F.col("q")).alias("d"))
    return rows.orderBy("d", "vec_id").limit(10).select("vec_id", rounded("d").alias("distance"))


def _unrolled(found: DataFrame, group: str) -> DataFrame:
    return (found.select(group, F.posexplode("neighbours").alias("rank", "n"))
            .select(group, (F.col("rank") + 1).alias("rank"), F.col("n.key").alias("key"), rounded("n.distance").alias("distance")))


def _grouped(name: str, width: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _unrolled(search.knn_agg(with_query(vectors(spark, sf_dir, width)), "vec_id", "v", "q", 5, name, ("label",)), "label")

    return run


def _grouped_sql(value: str, rows: str, name: str, group: str = "label", key: str = "vec_id", k: int = 5) -> str:
    way = "DESC" if metric.higher_is_closer(name) else "ASC"
    return f"""SELECT {group}, rank, key, round(d, {DIGITS}) + 0.0 AS distance FROM (
        SELECT {group}, {key} AS key, d, CAST(row_number() OVER (PARTITION BY {group} ORDER BY d {way}, {key}) AS INTEGER) AS rank
        FROM (SELECT {group}, {key}, {value} AS d FROM ({rows}))) WHERE rank <= {k}"""


VALUE_OF = {**{n: ON_PAIRS[n] for n in ("euclidean", "euclidean_squared", "manhattan", "dot_product")}, "cosine": ON_PAIRS["cosine_distance"]}
for _name in metric.NAMES:
    query(_grouped_sql(VALUE_OF[_name], PAIRS, _name), f"knn_agg_{_name}")(_grouped(_name, "float"))
query(_grouped_sql(VALUE_OF["euclidean"], PAIRS, "euclidean"), "knn_agg_double")(_grouped("euclidean", "double"))

ORDER_ROWS = "SELECT o_orderkey, o_orderstatus, CAST(o_orderkey AS DOUBLE) - 1000 AS t FROM orders"


@query(_grouped_sql("abs(t)", ORDER_ROWS, "euclidean", "o_orderstatus", "o_orderkey", 10))
def knn_agg_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.array(F.col("o_orderkey").cast("double"), F.lit(0.0)).alias("v"), F.array(F.lit(1000.0), F.lit(0.0)).alias("q"))
    return _unrolled(search.knn_agg(rows, "o_orderkey", "v", "q", 10, "euclidean", ("o_orderstatus",)), "o_orderstatus")


BLOCK = 512


@query(f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS d
      FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
    SELECT query_id, rank, key, round(d, {DIGITS}) + 0.0 AS distance FROM (SELECT query_id, vec_id AS key, d,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank FROM p) WHERE rank <= 5""")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every id divisible by 50, against all rows, in blocks of about ``BLOCK`` queries, as groups of one search."""
    rows = vectors(spark, sf_dir)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    blocks = max(1, -(-asked.count() // BLOCK))
    found = [search.nearest(rows.crossJoin(F.broadcast(asked.where(F.expr(f"pmod(query_id div 50, {blocks}) = {b}")))), "vec_id", "v", "q", 5, "euclidean",
                            ("query_id",)) for b in range(blocks)]
    return reduce(DataFrame.union, found).withColumn("distance", rounded("distance"))


@query(f"SELECT vec_id, round({ON_PAIRS['euclidean']}, {DIGITS}) + 0.0 AS value FROM ({PAIRS})")
def scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text, the query vector a scalar subquery."""
    sql.register(spark)
    vectors(spark, sf_dir).createOrReplaceTempView("isovec_vectors")
    found = spark.sql("SELECT vec_id, euclidean_distance(v, (SELECT v FROM isovec_vectors WHERE vec_id = 0)) AS value FROM isovec_vectors")
    return found.select("vec_id", rounded("value").alias("value"))


def _stretched(rows: DataFrame, kind: str) -> DataFrame:
    """Vectors of different lengths, whose cosine is not their dot product; powers of two change no other digit."""
    return rows.select("vec_id", F.transform("v", lambda e: e * F.pow(F.lit(2.0), F.col("vec_id") % 5)).cast(kind).alias("v"), F.transform("q", lambda e: e * 4).cast(kind).alias("q"))


for _name in ("cosine_similarity", "cosine_distance"):
    for _width, _suffix in (("float", ""), ("double", "_double")):
        query(f"""SELECT vec_id, round({ON_PAIRS[_name]}, {DIGITS}) + 0.0 AS value FROM (SELECT vec_id, list_transform(x, lambda e: e * pow(2, vec_id % 5)) AS x,
            list_transform(y, lambda e: e * 4) AS y FROM ({PAIRS}))""", f"{_name}_stretched{_suffix}")(
            lambda spark, sf_dir, f=EXACT[_name], w=_width: _stretched(with_query(vectors(spark, sf_dir, w)), f"array<{w}>").select(
                "vec_id", rounded(f(F.col("v"), F.col("q"))).alias("value")))


@query(f"""WITH p AS ({PAIRS}), g AS (SELECT CAST(label AS VARCHAR) AS label, vec_id, {ON_PAIRS['euclidean']} AS d FROM p UNION ALL SELECT 'all', vec_id, {ON_PAIRS['euclidean']} FROM p)
    SELECT label, rank, key, round(d, {DIGITS}) + 0.0 AS distance FROM (SELECT label, vec_id AS key, d,
      CAST(row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS INTEGER) AS rank FROM g) WHERE rank <= 3""")
def knn_agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets: every row once by label and once for all labels."""
    rows = with_query(vectors(spark, sf_dir)).select("vec_id", "v", "q", F.explode(F.array(F.col("label").cast("string"), F.lit("all"))).alias("label"))
    return search.nearest(rows, "vec_id", "v", "q", 3, "euclidean", ("label",)).withColumn("distance", rounded("distance"))


def bounds_sql(group: str | None = None) -> str:
    by, comma, using = (f"GROUP BY {group}, i", f"{group}, ", f"GROUP BY {group}") if group else ("GROUP BY i", "", "")
    return f"""u AS (SELECT {comma}unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
        m AS (SELECT {comma}i, min(v) AS lo, max(v) AS hi FROM u {by}),
        b AS (SELECT {comma}list((lo + hi) / 2 ORDER BY i) AS off, max(hi - lo) / 255 AS sc FROM m {using})"""


@query(f"WITH {bounds_sql()} SELECT CAST(unnest(range(len(off))) AS BIGINT) AS i, round(unnest(off), {DIGITS}) + 0.0 AS off, round(sc, 9) AS scale FROM b")
def bounds_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = search.vector_bounds_agg(vectors(spark, sf_dir), "v")
    return fitted.select(F.posexplode("bounds.offsets").alias("i", "off"), F.round("bounds.scale", 9).alias("scale")).select(
        F.col("i").cast("bigint").alias("i"), rounded("off").alias("off"), "scale")


@query(f"WITH {bounds_sql('label')} SELECT label, CAST(unnest(range(len(off))) AS BIGINT) AS i, round(unnest(off), {DIGITS}) + 0.0 AS off, round(sc, 9) AS scale FROM b")
def bounds_agg_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = search.vector_bounds_agg(vectors(spark, sf_dir, "double"), "v", ("label",))
    return fitted.select("label", F.posexplode("bounds.offsets").alias("i", "off"), F.round("bounds.scale", 9).alias("scale")).select(
        "label", F.col("i").cast("bigint").alias("i"), rounded("off").alias("off"), "scale")


def encoded(spark: SparkSession, sf_dir: str, width: str = "float") -> DataFrame:
    """The vectors with their bounds, one row beside each, and both codes."""
    rows = vectors(spark, sf_dir, width)
    beside = rows.crossJoin(F.broadcast(search.vector_bounds_agg(rows, "v")))
    return beside.withColumn("c", codes.quantize_int8(F.col("v"), F.col("bounds"))).withColumn("h", codes.quantize_int1(F.col("v"), F.col("bounds")))


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoded(spark, sf_dir)
    one = rows.where("vec_id = 0").select(F.col("v").alias("q"), F.col("c").alias("qc"), F.col("h").alias("qh")).limit(1)
    return rows.crossJoin(F.broadcast(one))


_Q = "(z[1] - z[2]) / sc"
CODES_SQL = f"""{bounds_sql()},
    c AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, off, sc,
      list_transform(list_zip(CAST(embedding AS DOUBLE[]), off), lambda z: CAST(greatest(-128, least(127,
        floor({_Q}) + CASE WHEN {_Q} - floor({_Q}) >= 0.5 THEN 1 ELSE 0 END)) AS BIGINT)) AS code,
      list_transform(list_zip(CAST(embedding AS DOUBLE[]), off), lambda z: CASE WHEN z[1] >= z[2] THEN 1 ELSE 0 END) AS bit FROM embeddings, b)"""
CODE_PAIRS = f"""SELECT a.vec_id, a.label, a.e, q.e AS qe, a.sc, a.code AS cx, q.code AS cy,
    list_transform(list_zip(a.code, a.off), lambda z: z[2] + z[1] * a.sc) AS x, list_transform(list_zip(q.code, q.off), lambda z: z[2] + z[1] * q.sc) AS y,
    CAST(list_sum(list_transform(list_zip(a.bit, q.bit), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS ham, len(a.bit) AS dim
    FROM c a, c q WHERE q.vec_id = 0"""
_SQ = "CAST(list_sum(list_transform(list_zip(cx, cy), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS DOUBLE)"
INT8_SQL = {"euclidean": f"abs(sc) * sqrt({_SQ})", "euclidean_squared": f"sc * sc * {_SQ}",
            "manhattan": "abs(sc) * CAST(list_sum(list_transform(list_zip(cx, cy), lambda z: abs(z[1] - z[2]))) AS DOUBLE)",
            "dot_product": ON_PAIRS["dot_product"], "cosine_similarity": ON_PAIRS["cosine_similarity"], "cosine_distance": ON_PAIRS["cosine_distance"]}
INT1_SQL = {"euclidean": "2 * sqrt(CAST(ham AS DOUBLE))", "euclidean_squared": "4.0 * ham", "manhattan": "2.0 * ham", "dot_product": "dim - 2.0 * ham",
            "cosine_similarity": "(dim - 2.0 * ham) / dim", "cosine_distance": "1 - (dim - 2.0 * ham) / dim"}
INT8 = {n: getattr(codes, f"int8_{EXACT[n].__name__}") for n in EXACT}
INT1 = {n: getattr(codes, f"int1_{EXACT[n].__name__}") for n in EXACT}


INT8_CODES = f"WITH {CODES_SQL} SELECT vec_id, array_to_string(code, ',') AS codes FROM c"
INT1_CODES = f"""WITH {CODES_SQL} SELECT vec_id, printf('%08X', len(bit)) || array_to_string(list_transform(range(0, len(bit) // 8),
    lambda j: printf('%02X', CAST(list_sum(list_transform(range(0, 8), lambda i: bit[j * 8 + i + 1] * (1 << i))) AS BIGINT))), '') AS codes FROM c"""
for _width, _suffix in (("float", ""), ("double", "_double")):
    query(INT8_CODES, "quantize_int8" + _suffix)(lambda spark, sf_dir, w=_width: encoded(spark, sf_dir, w).select(
        "vec_id", F.array_join(F.col("c").cast("array<string>"), ",").alias("codes")))
    query(INT1_CODES, "quantize_int1_hex" + _suffix)(lambda spark, sf_dir, w=_width: encoded(spark, sf_dir, w).select("vec_id", F.hex("h").alias("codes")))


@query(f"WITH {CODES_SQL}, p AS ({CODE_PAIRS}) SELECT vec_id, round({_SQ}, {DIGITS}) + 0.0 AS value FROM p")
def tinyint_euclidean_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-argument call on one-byte codes, which takes them as plain numbers."""
    return coded(spark, sf_dir).select("vec_id", rounded(exact.euclidean_squared_distance(F.col("c"), F.col("qc"))).alias("value"))


@query(f"WITH {CODES_SQL}, p AS ({CODE_PAIRS}) SELECT vec_id, ham AS value FROM p")
def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir).select("vec_id", codes.hamming_distance(F.col("h"), F.col("qh")).alias("value"))


def _int8(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return coded(spark, sf_dir).select("vec_id", rounded(function(F.col("c"), F.col("qc"), F.col("bounds"))).alias("value"))

    return run


def _int1(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return coded(spark, sf_dir).select("vec_id", rounded(function(F.col("h"), F.col("qh"))).alias("value"))

    return run


for _name in EXACT:
    query(f"WITH {CODES_SQL}, p AS ({CODE_PAIRS}) SELECT vec_id, round(CAST({INT8_SQL[_name]} AS DOUBLE), {DIGITS}) + 0.0 AS value FROM p",
          f"int8_{_name}")(_int8(INT8[_name]))
    query(f"WITH {CODES_SQL}, p AS ({CODE_PAIRS}) SELECT vec_id, round(CAST({INT1_SQL[_name]} AS DOUBLE), {DIGITS}) + 0.0 AS value FROM p",
          f"int1_{_name}")(_int1(INT1[_name]))


def _grouped_codes(name: str, code: str, asked: str, bounds: str | None):
    return lambda spark, sf_dir: _unrolled(search.knn_agg(coded(spark, sf_dir), "vec_id", code, asked, 5, name, ("label",), bounds), "label")


for _name in metric.NAMES:
    _on = "cosine_distance" if _name == "cosine" else _name
    for _kind, _sql, _args in (("int8", INT8_SQL, ("c", "qc", "bounds")), ("int1", INT1_SQL, ("h", "qh", None))):
        query(f"WITH {CODES_SQL}, p AS ({CODE_PAIRS}) " + _grouped_sql(f"round(CAST({_sql[_on]} AS DOUBLE), 9)", "SELECT * FROM p", _name),
              f"knn_agg_{_kind}_{_name}")(_grouped_codes(_name, *_args))


def _rerank_sql(short: str) -> str:
    return f"""WITH {CODES_SQL}, p AS ({CODE_PAIRS}), s AS (SELECT vec_id, e, qe FROM p ORDER BY {short}, vec_id LIMIT 50),
        d AS (SELECT vec_id, list_distance(e, qe) AS d FROM s)
        SELECT CAST(row_number() OVER (ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id AS key, round(d, {DIGITS}) + 0.0 AS distance
        FROM d ORDER BY d, vec_id LIMIT 5"""


@query(_rerank_sql(INT8_SQL["euclidean"]))
def rerank_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(spark, sf_dir, "c", "qc", "bounds")


def _short(spark: SparkSession, sf_dir: str, code: str, asked: str, bounds: str | None) -> DataFrame:
    found = search.knn_rerank(coded(spark, sf_dir), "vec_id", code, asked, "v", "q", 5, 10, "euclidean", bounds=bounds)
    return found.withColumn("distance", rounded("distance"))


@query(_rerank_sql("ham"))
def rerank_int1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(spark, sf_dir, "h", "qh", None)


def _embedded(spark: SparkSession, sf_dir: str, algorithm: str, dimension: int, width: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.to_vector(docs, "text", dimension, algorithm, width)


def _embedding(algorithm: str, width: str):
    """SQL has no XXH64: components are checked by tests; the query returns what is not zero."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return (_embedded(spark, sf_dir, algorithm, 256, width).select("doc_id", F.posexplode("vector").alias("i", "x"))
                .where("x <> 0").select("doc_id", "i", rounded(F.col("x").cast("double")).alias("x")))

    return run


for _algorithm in embed.ALGORITHMS:
    query(name=f"embed_{_algorithm}")(_embedding(_algorithm, "float"))
query(name="embed_word_double")(_embedding("word", "double"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) AS BIGINT) AS n_tokens FROM documents")
def embed_word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(embed.tokens(F.col("text"), "word")).cast("bigint").alias("n_tokens"))


@query("SELECT doc_id, CAST(greatest(0, length(text) - 2) AS BIGINT) AS n_tokens FROM documents")
def embed_char_3gram_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(embed.tokens(F.col("text"), "char_3gram")).cast("bigint").alias("n_tokens"))


@query("SELECT doc_id, CASE WHEN len(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS norm FROM documents")
def embed_word_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings have length 1, or 0 without a token."""
    return _embedded(spark, sf_dir, "word", 1024, "double").select("doc_id", rounded(exact.l2_norm(F.col("vector"))).alias("norm"))
