"""Language-model scoring (operator 7): Katz backoff over word pairs.

Counts are Good-Turing discounted up to ``DISCOUNTED``; what the discounts free
is the probability of unknown words (single words) and of words not seen after
a given one (pairs), the latter spread by backoff weights that make every
context sum to 1 exactly. A token's probability is that of its pair if the pair
was seen in training, else the context's backoff weight times that of the word.

No row a token is ever shuffled. A task turns about ``PART_TOKENS`` tokens at a
time into a *part*: its distinct words and pairs as sorted hashes, dealt into
buckets, and its documents as compressed word numbers. A bucket merges the
hashes of all parts and gives each part the totals back, in the part's own
order and so without keys. Backoff sums take the same way by context. Frequent
words cost one entry a part, wherever they stand, so that no bucket is hot. All
of a corpus's words and pairs are counted; the tables grow with it.

Word hashes have 64 bits. Pair hashes have ``log2(characters / 4) + 17``, 63 at most,
so that about one pair in 2^17 is taken for another.

Edge cases: a null or empty text is the end token alone; rows of null id are
scored and not learned from; every row is a document, also of a repeated id; with
nothing to learn from, every token is unknown and has probability 1; an empty
table gives an empty result; further columns of the input, also of clashing
names, are ignored.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Isolated, discard, fold, materialise, partitions, scratch_path

FOLDS, HELD_OUT = 5, 1
PART_TOKENS = 1_500_000
DISCOUNTED = 5
SPARE_BITS = 17
DOCS_A_ROW = 256
POINT = 44
START, END = b" s", b" e"  # no word holds a space
ROW = "part long, kind int, bucket int, doc_id long, held boolean, n long, a binary, b binary"
NAMES = ["part", "kind", "bucket", "doc_id", "held", "n", "a", "b"]
DOC, WORDS, PAIRS, WORD_TOTALS, PAIR_TOTALS, SUMS, SUM_TOTALS, RANKS, HISTOGRAM = range(9)


def shut(x: np.ndarray) -> bytes:
    """Compressed by byte planes, which keeps small numbers small."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 3)


def opened(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def shut_sorted(x: np.ndarray) -> bytes:
    return shut(np.diff(x, prepend=np.uint64(0)))


def opened_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(opened(data, np.uint64), dtype=np.uint64)


def shut_sums(pairs: np.ndarray, kept: np.ndarray, covered: np.ndarray) -> bytes:
    """Sums by context. Only ``1 - covered`` is used, so that a fixed point of ``POINT`` bits gives all the digits there are."""
    return shut(np.concatenate([pairs.astype(np.int64), kept.view(np.int64), np.rint(covered * 2.0 ** POINT).astype(np.int64)]))


def opened_sums(data: bytes) -> np.ndarray:
    pairs, kept, covered = opened(data, np.int64).reshape(3, -1)
    return np.array([pairs.astype(np.float64), kept.view(np.float64), covered / 2.0 ** POINT])


def pair_keys(hashes: np.ndarray, first: np.ndarray, second: np.ndarray, width: int) -> np.ndarray:
    """In place as far as can be: a part's arrays of all its tokens decide a task's memory."""
    h, other = hashes[first], hashes[second]
    other ^= other >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h += other
    del other
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h >>= np.uint64(64 - width)
    return h


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, a place of each, and for every place which of them it is."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    which = np.empty(len(keys), np.uint32)
    which[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return keys[new], order[new], which


def context_of(second: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The word before each word; ``start`` before a document's first."""
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[np.cumsum(lengths) - lengths] = start
    return first


def bucket_bounds(keys: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Where each bucket, the keys of equal top bits, begins among sorted keys."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)
    return np.append(np.searchsorted(keys, edges), len(keys))


class Part:
    """What a part's rows hold, put together again."""

    def __init__(self, frame: pd.DataFrame, width: int):
        by = defaultdict(list)
        for row in frame.sort_values(["kind", "bucket"], kind="stable").itertuples(index=False):
            by[row.kind].append(row)
        self.by = by
        self.hashes = np.concatenate([opened_sorted(r.a) for r in by[WORDS]])
        rank = opened(by[RANKS][0].a, np.uint32)
        self.second = np.concatenate([rank[opened(r.a, np.uint32)] for r in by[DOC]])
        facts = np.concatenate([opened(r.b, np.int64).reshape(3, -1) for r in by[DOC]], axis=1)
        self.ids, self.marks, self.lengths = facts
        self.first = context_of(self.second, self.lengths, int(np.searchsorted(self.hashes, np.uint64(xxhash.xxh64_intdigest(START)))))
        self.keys, self.at, self.pair = distinct(pair_keys(self.hashes, self.first, self.second, width))

    def totals(self, kind: int, of: type = np.uint64) -> np.ndarray:
        return np.concatenate([opened(r.a, of) for r in self.by[kind]])


def parts(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Rows of all parts: documents, words and pairs with their training counts."""

    def rows(number: int, texts: list[tuple], table: dict, ids: list[np.ndarray]) -> pa.RecordBatch:
        out: list[tuple] = []
        words = list(table)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        order = np.argsort(hashes)  # 64-bit hashes of a part's words are taken for distinct
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        sorted_hashes = hashes[order]
        lengths = np.array([len(x) for x in ids])
        second = place[np.concatenate(ids)]
        learned = np.repeat(np.array([held is False for _, held in texts]), lengths)
        counts = np.bincount(second[learned], minlength=len(words)).astype(np.uint64)
        rank = np.argsort(-np.bincount(second, minlength=len(words)), kind="stable").astype(np.uint32)
        ranked = np.empty_like(rank)
        ranked[rank] = np.arange(len(rank), dtype=np.uint32)
        out.append((number, RANKS, 0, None, None, 0, shut(rank), None))
        begin = 0
        for k in range(0, len(texts), DOCS_A_ROW):
            some = texts[k:k + DOCS_A_ROW]
            end = begin + int(lengths[k:k + DOCS_A_ROW].sum())
            facts = [[doc_id or 0 for doc_id, _ in some], [2 if doc_id is None else int(held) for doc_id, held in some], lengths[k:k + DOCS_A_ROW]]
            out.append((number, DOC, k // DOCS_A_ROW, None, None, len(some), shut(ranked[second[begin:end]]),
                        shut(np.concatenate(facts).astype(np.int64))))
            begin = end
        keys, _, pair = distinct(pair_keys(sorted_hashes, context_of(second, lengths, int(place[table[START]])), second, width))
        pairs = np.bincount(pair[learned], minlength=len(keys)).astype(np.uint64)
        for kind, k, c, w in ((WORDS, sorted_hashes, counts, 64), (PAIRS, keys, pairs, width)):
            bounds = bucket_bounds(k, w, bits)
            for b in range(1 << bits):
                x, y = bounds[b], bounds[b + 1]
                if y > x:
                    out.append((number, kind, b, None, None, int(y - x), shut_sorted(k[x:y]), shut(c[x:y])))
        return pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in out], schema)

    schema = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("held", pa.bool_()),
                        ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24

        class Numbered(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = k = len(self)
                return k

        texts, ids, size = [], [], 0
        table = Numbered({START: 0, END: 1})
        for batch in batches:
            for doc_id, text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = (text or "").encode("utf-8", "replace").lower().split()
                own.append(END)
                texts.append((doc_id, held))
                ids.append(np.array(list(map(table.__getitem__, own)), np.uint32))
                size += len(own)
                if size >= PART_TOKENS:
                    yield rows(number, texts, table, ids)
                    texts, ids, size, number = [], [], 0, number + 1
                    table = Numbered({START: 0, END: 1})
        if texts:
            yield rows(number, texts, table, ids)

    return docs.mapInArrow(run, ROW)


def _merged(frame: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    frame = frame.sort_values("part", kind="stable")
    rows = list(frame.itertuples(index=False))
    keys = np.concatenate([opened_sorted(r.a) for r in rows])
    found, where = np.unique(keys, return_inverse=True)
    return rows, found, where


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES).astype({"doc_id": "Int64", "held": "boolean"})


def totals(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket of words or pairs: each part's totals, whether the part is the first to hold a key, and counts of counts."""
    rows, found, where = _merged(frame)
    kind, bucket = int(rows[0].kind), int(rows[0].bucket)
    total = np.zeros(len(found), np.uint64)
    np.add.at(total, where, np.concatenate([opened(r.b, np.uint64) for r in rows]))
    seen, out, begin = np.zeros(len(found), bool), [], 0
    for r in rows:
        own = where[begin:begin + r.n]
        begin += r.n
        mine = ~seen[own]
        seen[own] = True
        out.append((r.part, WORD_TOTALS if kind == WORDS else PAIR_TOTALS, bucket, None, None, r.n, shut(total[own]),
                    zstandard.compress(np.packbits(mine).tobytes(), 3)))
    low = np.bincount(np.minimum(total, DISCOUNTED + 2).astype(np.int64), minlength=DISCOUNTED + 3)
    out.append((-1, HISTOGRAM, kind, None, None, 0, json.dumps([int(total.sum()), *map(int, low)]).encode(), None))
    return _frame(out)


def discounts(counted: list[int]) -> np.ndarray:
    """By count from 0 to ``DISCOUNTED``: Katz's factors; 1 where Good-Turing gives none between 0 and 1."""
    out = np.ones(DISCOUNTED + 1)
    n = counted
    if n[1] and n[DISCOUNTED + 1]:
        tail = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
        for r in range(1, DISCOUNTED + 1):
            if n[r] and n[r + 1] and tail < 1:
                d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail)
                out[r] = d if 0 < d < 1 else 1
    return out


class Singles:
    """Probabilities of single words; they and the unknown word's sum to 1."""

    def __init__(self, histogram: list[int]):
        self.tokens, counted = histogram[0], histogram[1:]
        self.types = sum(counted[1:])
        self.discount = discounts(counted)
        freed = sum(r * counted[r] * (1 - self.discount[r]) for r in range(1, DISCOUNTED + 1))
        self.unknown = max(freed, 0.5) / (self.tokens + 0.5) if self.tokens and freed < 0.5 else (freed / self.tokens if self.tokens else 1.0)
        self.scale = (1 - self.unknown) / (1 - freed / self.tokens) if self.tokens > freed else 0.0

    def of(self, counts: np.ndarray) -> np.ndarray:
        d = self.discount[np.minimum(counts, DISCOUNTED).astype(np.int64)]
        d = np.where(counts > DISCOUNTED, 1, d)
        return np.where(counts > 0, self.scale * d * counts / max(1, self.tokens), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def _discounted(counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
    return counts * np.where(counts > DISCOUNTED, 1, discount[np.minimum(counts, DISCOUNTED).astype(np.int64)])


def score(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = docs.sparkSession
    box = Isolated(docs)
    inner = box.df.select(box["doc_id"].cast("long").alias("doc_id"), box["text"].alias("text"),
                          (fold(box["doc_id"], FOLDS) == HELD_OUT).alias("held"))
    size = inner.agg(F.sum(F.length("text"))).first()[0] or 0  # characters; words are fewer
    width = min(63, max(24, math.ceil(math.log2(size / 4 + 2)) + SPARE_BITS))
    bits = math.ceil(math.log2(max(2, partitions(spark))))
    path, sums_path = scratch_path(spark, "katz-parts"), scratch_path(spark, "katz-sums")
    own = materialise(parts(inner, width, bits), "katz-parts", path, by=("kind",))
    counted = materialise(own.where(F.col("kind").isin(WORDS, PAIRS)).groupBy("kind", "bucket").applyInPandas(totals, ROW), "katz-totals")
    discard(spark, f"{path}/kind={PAIRS}")

    histograms = {WORDS: [0] * (DISCOUNTED + 4), PAIRS: [0] * (DISCOUNTED + 4)}
    for r in counted.where(F.col("kind") == HISTOGRAM).select("bucket", "a").toLocalIterator():
        histograms[r["bucket"]] = [x + y for x, y in zip(histograms[r["bucket"]], json.loads(bytes(r["a"])), strict=True)]
    singles = Singles(histograms[WORDS])
    discount = discounts(histograms[PAIRS][1:])
    answers = counted.where(F.col("kind") != HISTOGRAM)

    def context_sums(frame: pd.DataFrame) -> pd.DataFrame:
        """By context word of the part: pairs, discounted pairs and single-word probability, of the pairs that it is first to hold."""
        part = Part(frame, width)
        chance = singles.of(part.totals(WORD_TOTALS).astype(np.float64))
        count = part.totals(PAIR_TOTALS).astype(np.float64)
        first = np.concatenate([np.unpackbits(np.frombuffer(zstandard.decompress(r.b), np.uint8), count=r.n) for r in part.by[PAIR_TOTALS]]) > 0
        use = first & (count > 0)
        context, word = part.first[part.at[use]], part.second[part.at[use]]
        sums = [np.bincount(context, x, len(part.hashes)) for x in (count[use], _discounted(count[use], discount), chance[word])]
        out, begin = [], 0
        for r in part.by[WORDS]:
            own = shut_sums(*(s[begin:begin + r.n] for s in sums))
            begin += r.n
            out.append((r.part, SUMS, r.bucket, None, None, r.n, own, None))
        return _frame(out)

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        rows, found, where = _merged(frame[frame["kind"] == WORDS])
        sums = {r.part: opened_sums(r.a) for r in frame[frame["kind"] == SUMS].itertuples(index=False)}
        given = np.concatenate([sums[r.part] for r in rows], axis=1)
        total = [np.bincount(where, x, len(found)) for x in given]
        out, begin = [], 0
        for r in rows:
            at = where[begin:begin + r.n]
            begin += r.n
            out.append((r.part, SUM_TOTALS, r.bucket, None, None, r.n, shut_sums(*(t[at] for t in total)), None))
        return _frame(out)

    def scored(frame: pd.DataFrame) -> pd.DataFrame:
        part = Part(frame, width)
        word_count = part.totals(WORD_TOTALS).astype(np.float64)
        chance = singles.of(word_count)
        pairs, kept, covered = np.concatenate([opened_sums(r.a) for r in part.by[SUM_TOTALS]], axis=1)
        # What the seen pairs of a context leave, at least half a count; the seen ones are scaled to the rest.
        known = pairs > 0
        safe = np.where(known, pairs, 1)
        left = np.where(known, np.maximum(1 - kept / safe, 0.5 / (safe + 1)), 1)
        scale = np.where(known, (1 - left) / np.where(known, kept / safe, 1), 0)
        backoff = np.where(known, left / np.maximum(1 - covered, 1e-12), 1)
        count = part.totals(PAIR_TOTALS).astype(np.float64)
        context, word = part.first[part.at], part.second[part.at]
        seen = scale[context] * _discounted(count, discount) / safe[context]
        log = np.log10(np.where(count > 0, seen, backoff[context] * chance[word]))
        of = np.repeat(np.arange(len(part.lengths)), part.lengths)
        n = len(part.lengths)
        lost = part.marks == 2  # no id
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(part.ids.copy(), lost),
            "held_out": pd.arrays.BooleanArray(part.marks == 1, lost),
            "n_tokens": part.lengths.astype(np.int64),
            "n_known": np.bincount(of, word_count[part.second] > 0, n).astype(np.int64),
            "train_tokens": np.int64(singles.tokens),
            "base_score": np.bincount(of, singles.base(word_count)[part.second], n),
            "score": np.bincount(of, log[part.pair], n),
        })

    held = own.where(F.col("kind").isin(DOC, WORDS, RANKS))
    sums = materialise(held.union(answers).groupBy("part").applyInPandas(context_sums, ROW), "katz-sums", sums_path)
    contexts = materialise(own.where(F.col("kind") == WORDS).union(sums).groupBy("bucket").applyInPandas(summed, ROW), "katz-contexts")
    discard(spark, sums_path)
    return held.union(answers).union(contexts).groupBy("part").applyInPandas(
        scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
