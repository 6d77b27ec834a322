"""The pipeline as a whole against its stages by brute force, on a small table."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("isovec.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from isovec.llm import line_dedup, quality_rules  # noqa: E402
from isovec.llm.queries import tokenizer_path  # noqa: E402
from test_operators import DE, EN, corpus, fingerprint, text  # noqa: E402


def documents():
    rng = random.Random(9)
    rows = corpus()
    for k in range(300, 304):  # the words of a clean text, broken into other lines
        ws = text(rng, EN if k % 2 else DE, 1).split()
        ws = [*ws, *text(rng, EN if k % 2 else DE, 2).split()]
        rows.append((k, "\n".join(" ".join(ws[j:j + 12]) for j in range(0, len(ws), 12)), None))
        rows.append((k + 100, "\n".join(" ".join(ws[max(0, j):j + 12]) for j in range(-6, len(ws), 12)), None))
    rows += [(500, "too short", None), (501, "the # " * 40, None), (502, "", None), (503, None, None), (504, "the of and to in " * 30, "en")]
    return rows


def without_repeated_lines(docs):
    """Of lines that chains of Jaccard similarity 0.8 connect, the first by id and number stays."""
    held = sorted((i, k, x) for i, t in docs.items() for k, x in line_dedup.lines_of(t))
    sets = [line_dedup.shingles(x) for _, _, x in held]
    root = list(range(len(held)))
    changed = True
    links = [(a, b) for a in range(len(held)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    gone = {held[k][:2] for k in range(len(held)) if root[k] != k}
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs.items()}
    return {i: t for i, t in left.items() if t.strip() or t == docs[i]}


def one_of_each_group(docs):
    fps = {i: fingerprint(t) for i, t in docs.items()}
    root = {i: i for i in fps}
    for _ in fps:
        for i in fps:
            root[i] = min(root[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2)
    return {i: t for i, t in docs.items() if root[i] == i}


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = documents()
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": [r[2] for r in rows],
                      "source": ["s"] * len(rows), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})
    pq.write_table(table, tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.register("documents", table)
    ruled = {i for i, kept in con.sql(f"SELECT doc_id, kept FROM ({quality_rules.ORACLE_SQL})").fetchall() if kept}
    assert 0 in ruled and ruled.isdisjoint(range(500, 505))
    texts = {i: t for i, t, _ in rows if i in ruled}  # all of a language that is learned
    lined = without_repeated_lines(texts)
    kept = one_of_each_group(lined)
    assert len(ruled) > len(lined) > len(kept) and {300, 303} <= set(kept) and kept.keys().isdisjoint(range(400, 404))

    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    expected = Counter()
    for i, t in kept.items():
        ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
        expected[i, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    ends = {}
    for r in sorted(found, key=lambda r: r["offset"]):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096


def test_pipeline_stages(spark):
    """Stages but the last give back the columns of their input; texts of no known language go; an empty table stays empty."""
    rows = [(i, t, lang, "s", 1) for i, t, lang in corpus()] + [(600, "12 34 ### 56", None, "s", 1), (601, "", None, "s", 1), (602, None, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_known_languages(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in rows[:-3])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), "")
        assert empty.columns == docs.columns and empty.count() == 0
