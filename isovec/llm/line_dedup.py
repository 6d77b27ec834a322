"""Fuzzy line deduplication (operator 6): of each component of near-equal lines one stays.

1. A task reads its documents once, in *parts* of ``PART_CHARS`` characters. A
   part's distinct lines of at least ``SHINGLE`` characters are signed: the MinHash
   of ``BANDS * ROWS`` values over their character shingles is cut into bands, each
   of which gives a key of 48 bits. A part's keys are sorted, dealt into buckets
   and kept as compressed arrays, beside its compressed lines and the facts of each:
   the number of its shingles and a sketch of 512 bits.
   A shorter line is like its equals only.
2. A bucket merges the keys of all parts and tells each part which of its keys
   stand for several different lines; a tag of 16 bits and the bits of the length
   tell lines apart, so that at most one in 65,536 pairs passes for equal there.
   Of those keys alone a part sends the lines' facts to the buckets.
3. There the lines of a key meet. Of two lines the numbers of shingles, and the
   sketches, bound the similarity from above, which rules out most pairs that are not
   alike. The pairs that are left get their texts, and nothing else does; the exact
   Jaccard similarity of the shingle sets decides, and what is alike is joined.
   A key of more than ``BLOCK_LINES`` lines, or of more than ``PAIRS_A_LINE`` such
   pairs a line, gives a pair of each line with the key's pivot, one of its lines, in place of
   all. Its lines that still belong to several components then meet in blocks of
   ``BLOCK_LINES``, two blocks at a time, by sketches first; those of different
   components that the sketches leave are compared. So every pair of lines of a key is
   compared, ruled out by a bound or already connected.
4. Components are joined by distributed union-find. The line that comes first, by
   document id and number, stays.

At similarity 0.8 a pair shares some band with probability 0.9992. A word or two
changed in a line costs few of its shingles of 5 characters. Lines that are not
alike share some of them by chance; five values a band keep those apart. Blocks
that meet are the square of a key's lines over ``BLOCK_LINES``: this is where a key
of very many lines that are *not* alike costs most.

A line is known by 128 bits of XXH3. A line repeated in a billion documents is one
row a part where lines are compared, is counted before it is shuffled, and meets
one row in the join that tells its documents, which splits over tasks. So do the
lines of a hot key where they meet their pivot.

Edge cases: null texts have no lines; lines of nothing but white space stay as
they are, since they part paragraphs; lines of any length are compared whole, long
ones in blocks of fewer lines (``BLOCK_CHARS``); of equal lines the first stays;
rows of null id neither lose lines nor make others lose any; rows of one id and
text are one document; lines at one place of rows of one id are not told apart
where both would stay; an empty table gives an empty result; further columns of
the input, also of clashing names, are ignored by ``removed_lines`` and kept by
``filter_documents``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, Isolated, discard, materialise, release, scratch_path
from .graph import UnionFind, connected_components

SHINGLE = 5
ROWS = 5
BANDS = 18
SIMILARITY = 0.8
#: Characters of the lines that a task holds at a time, and of those that it signs at a time.
PART_CHARS = 24_000_000
SIGNED_CHARS = 1_000_000
#: Shingles of a column, and columns whose values are computed together, which should fit a core's cache.
COLUMN = 32
COLUMNS = 2048
ROLLED = 16_384
KEY_BITS = 48
#: Longs of a sketch. Beside a key it is folded to half of them for lines of so many shingles or fewer.
SKETCH = 8
FOLDED = 300
#: Bits of a line's number in its part, and of a part's number in its task. Both are in a line's ``ref``.
LINE_BITS = 23
PART_BITS = 16
#: Keys that a bucket is to merge.
BUCKET_KEYS = 2_000_000
BLOCK_LINES = 512
#: A key of more pairs a line than these has its lines compared by pivot and blocks.
PAIRS_A_LINE = 3
BLOCK_CHARS = 2_000_000
LINES_A_ROW = 4096
#: Lines whose components a task remembers while it compares blocks.
KNOWN = 200_000
#: Groups of more lines are compared by bitmaps in place of sets.
FEW = 6

_SEEDS = np.random.default_rng(20240607)
_MULTIPLIERS = (_SEEDS.integers(0, 1 << 31, BANDS * ROWS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_MASKS = _SEEDS.integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)
_ODD = np.uint64(0x9E3779B97F4A7C15)

ROW = "kind int, part long, bucket int, h binary, doc_id long, line_no int, n long, a binary, b binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("bucket", pa.int32()), ("h", pa.binary()), ("doc_id", pa.int64()), ("line_no", pa.int32()),
                    ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
PLACES, KEYS, HOLDERS, FACTS_OF, LINES, SHARED = range(6)
#: Beside a key: a tag that tells lines apart and the bits of the line's length.
MARK = np.dtype([("tag", "<u2"), ("size", "u1")])
#: Of a line: its number in its part, both marks, how many distinct shingles it has at least and how many more at most (``MOST`` and
#: ``SPARE`` stand for any greater number, too), its sketch.
FACT = np.dtype([("at", "<u4"), ("tag", "<u2"), ("size", "u1"), ("own", "<u2"), ("spare", "u1"), ("sketch", "<u8", SKETCH)])
MOST, SPARE = 65_535, 255
MET = pa.schema([("many", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("blocks", pa.int64())])
FACTS = [*(f"s{k}" for k in range(SKETCH)), "chars"]


def lines_of(text: str | None) -> Iterator[tuple[int, str]]:
    """The lines that take part, with their numbers."""
    for k, line in enumerate((text or "").split("\n")):
        if line.strip(WHITE_SPACE):
            yield k, line


def shingles(line: str) -> set[str]:
    """A line shorter than one is its own."""
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolled(points: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the shingle that starts at every code point but the last ones."""
    out = np.empty(len(points) - SHINGLE + 1, np.uint32)
    for at in range(0, len(out), ROLLED):
        value = np.zeros(min(ROLLED, len(out) - at), np.uint64)
        for k in range(SHINGLE):
            value *= _ODD
            value += points[at + k:at + k + len(value)]
        out[at:at + len(value)] = _mixed(value) >> np.uint64(32)
    return out


def least_values(short: np.ndarray, first: np.ndarray, own: np.ndarray) -> np.ndarray:
    """MinHash values (value, line) of lines whose ``own`` shingles begin at ``first``.

    Lines are laid out in columns of ``COLUMN`` shingles, the last one filled up
    with its last shingle, so that a minimum is taken over many columns at once."""
    columns = -(-own // COLUMN)
    begin = np.cumsum(columns) - columns
    line = np.repeat(np.arange(len(own)), columns)
    start = first[line] + (np.arange(len(line)) - begin[line]) * COLUMN
    last = first[line] + own[line] - 1
    out = np.empty((BANDS * ROWS, len(line)), np.uint32)
    for k in range(0, len(line), COLUMNS):
        held = short[np.minimum(start[k:k + COLUMNS] + np.arange(COLUMN)[:, None], last[k:k + COLUMNS])]
        work = np.empty_like(held)
        for v in range(BANDS * ROWS):
            np.bitwise_xor(held, _MASKS[v], out=work)
            np.multiply(work, _MULTIPLIERS[v], out=work)
            np.minimum.reduce(work, axis=0, out=out[v, k:k + COLUMNS])
    return np.minimum.reduceat(out, begin, axis=1)


def sketched(lines: list[str], short: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``SKETCH`` longs a line, of ``SHINGLE`` characters or more, and how many distinct hashes (``short``) its shingles have.

    A bit is the parity of the number of its distinct shingles that hash there. The bits
    in which two sketches differ are the odd ones among the shingles that only one line
    has, so never more than those."""
    if short is None:
        short = rolled(np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32))
    own = np.array([len(x) for x in lines]) - SHINGLE + 1
    number = np.arange(len(lines) + 1)
    value = short[np.arange(int(own.sum())) + np.repeat(number[:-1] * (SHINGLE - 1), own)].astype(np.int64)
    value |= np.repeat(number[:-1] << 32, own)
    value.sort()
    value = value[np.append(True, value[1:] != value[:-1])]
    distinct = np.diff(np.searchsorted(value, number << 32))
    bit = (np.repeat(number[:-1] * (64 * SKETCH), distinct)) + (value & 0xFFFFFFFF) % (64 * SKETCH)
    odd = np.bincount(bit, minlength=64 * SKETCH * len(lines)).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).reshape(-1, SKETCH), distinct


def sketches(lines: list[str]) -> np.ndarray:
    return sketched(lines)[0]


def folded(bits: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The sketches, of which some have their second half added to the first, whose bits are parities then, too."""
    half = SKETCH // 2
    out = bits.copy()
    out[which, :half] ^= out[which, half:]
    out[which, half:] = 0
    return out


def ruled_out(differ, chars):
    """Whether two lines that differ in so many bits, of so many characters together, cannot reach ``SIMILARITY``.

    Of sets of ``m`` elements together, those in only one of them are at most ``m *
    (1 - s) / (1 + s)`` if the similarity reaches ``s``. Works on arrays and columns."""
    return differ * (1 + SIMILARITY) > (chars - 2 * (SHINGLE - 1)) * (1 - SIMILARITY) + 1e-6


def at_most(facts: np.ndarray) -> np.ndarray:
    """Bounds of the numbers of distinct shingles from above."""
    return np.where((facts["own"] == MOST) | (facts["spare"] == SPARE), 1 << 40, facts["own"].astype(np.int64) + facts["spare"])


def unlike(facts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether lines ``i`` and ``j``, of no smaller ``own`` than ``i``, cannot reach ``SIMILARITY``: by the numbers of their distinct shingles, or by their sketches."""
    x, y = facts[i], facts[j]
    less, more = at_most(x), at_most(y)
    bits = folded(x["sketch"] ^ y["sketch"], np.minimum(x["own"], y["own"]) <= FOLDED)
    differ = np.bitwise_count(bits).sum(1, dtype=np.int64)
    return (less < SIMILARITY * y["own"] - 1e-6) | (differ * (1 + SIMILARITY) > (less + more) * (1 - SIMILARITY) + 1e-6)


def band_keys(lines: list[str], short: np.ndarray | None = None) -> np.ndarray:
    """A key of ``KEY_BITS`` a line and band, for lines of ``SHINGLE`` characters or more."""
    if short is None:
        short = rolled(np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32))
    lengths = np.array([len(x) for x in lines])
    least = least_values(short, np.cumsum(lengths) - lengths, lengths - SHINGLE + 1)
    out = np.empty((len(lines), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(lines), b + 1, np.uint64)
        for row in least[b * ROWS:(b + 1) * ROWS]:
            key = _mixed(key * _ODD + row)
        out[:, b] = key >> np.uint64(64 - KEY_BITS)
    return out


def shut(x: np.ndarray) -> bytes:
    """Compressed by byte planes, which keeps small numbers small."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def opened(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, SCHEMA)


class Part:
    """Distinct lines of some documents, in order of arrival."""

    def __init__(self, number: int, bits: int):
        self.number, self.bits = number, bits
        self.index: dict[bytes, int] = {}
        self.lines: list[str] = []
        self.keys: list[np.ndarray] = []
        self.facts: list[np.ndarray] = []
        self.signed = self.chars = self.waiting = 0

    def add(self, h: bytes, line: str) -> None:
        if h not in self.index and len(line) >= SHINGLE:
            self.index[h] = len(self.lines)
            self.lines.append(line)
            self.chars += len(line)
            self.waiting += len(line)
            if self.waiting >= SIGNED_CHARS:
                self.sign()

    def sign(self) -> None:
        if self.signed < len(self.lines):
            lines = self.lines[self.signed:]
            short = rolled(np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32))
            self.keys.append(band_keys(lines, short))
            bits, own = sketched(lines, short)
            facts = np.empty(len(lines), FACT)
            facts["at"] = np.arange(self.signed, len(self.lines))
            facts["size"] = [len(x).bit_length() for x in lines]
            facts["own"] = np.minimum(own, MOST)
            facts["spare"] = np.minimum(np.array([len(x) for x in lines]) - SHINGLE + 1 - own, SPARE)
            facts["sketch"] = folded(bits.view(np.uint64), facts["own"] <= FOLDED)
            self.facts.append(facts)
            self.signed, self.waiting = len(self.lines), 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The keys by bucket, which line holds each, the facts of the lines, and the lines."""
        self.sign()
        if not self.lines:
            return
        hashes = list(self.index)
        facts = np.concatenate(self.facts)
        facts["tag"] = np.frombuffer(b"".join(h[:2] for h in hashes), "<u2")
        marks = np.empty(len(facts), MARK)
        marks["tag"], marks["size"] = facts["tag"], facts["size"]
        keys = np.concatenate(self.keys).ravel()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        holder = (order // BANDS).astype(np.uint32)
        edges = np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(KEY_BITS - self.bits)
        bounds = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        out = []
        for b, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if y > x:
                out.append({"kind": KEYS, "part": self.number, "bucket": b, "n": y - x, "a": shut(np.diff(keys[x:y], prepend=np.uint64(0))), "b": shut(marks[holder[x:y]])})
                out.append({"kind": HOLDERS, "part": self.number, "bucket": b, "n": y - x, "a": shut(holder[x:y])})
        out.append({"kind": FACTS_OF, "part": self.number, "n": len(facts), "a": shut(facts)})
        yield _rows(out)
        for k in range(0, len(hashes), LINES_A_ROW):
            text = "\n".join(self.lines[k:k + LINES_A_ROW]).encode("utf-8", "replace")
            yield _rows([{"kind": LINES, "part": self.number, "bucket": k // LINES_A_ROW, "n": len(hashes[k:k + LINES_A_ROW]),
                          "a": zstandard.compress(text, 3), "b": b"".join(hashes[k:k + LINES_A_ROW])}])


def parts(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of all parts, and one of kind ``PLACES`` for every line that takes part: ``h``, ``doc_id``, ``line_no``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # a part is large: what an earlier operator left would stand beside it
        number = TaskContext.get().partitionId() << PART_BITS
        part = Part(number, bits)
        for batch in batches:
            h, ids, numbers = [], [], []

            def places() -> pa.RecordBatch:
                n = len(h)
                return pa.RecordBatch.from_arrays(
                    [pa.array([PLACES] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(h, pa.binary()), pa.array(ids, pa.int64()),
                     pa.array(numbers, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=SCHEMA)

            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, line in lines_of(text):
                    own = xxhash.xxh3_128_digest(line.encode("utf-8", "replace"))
                    h.append(own)
                    ids.append(i)
                    numbers.append(k)
                    part.add(own, line)
                    if part.chars >= PART_CHARS:
                        yield from part.rows()
                        number += 1
                        part = Part(number, bits)
            yield places()
        yield from part.rows()
        part = None
        release()

    return docs.mapInArrow(run, ROW)


def _merged(table: pa.Table, kind: np.dtype) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """Of one bucket: the parts' rows in order, their keys, and what stands beside the keys."""
    rows = sorted(table.select(["part", "bucket", "n", "a", "b"]).to_pylist(), key=lambda r: r["part"])
    return (rows, np.concatenate([np.cumsum(opened(r["a"], np.uint64), dtype=np.uint64) for r in rows]), np.concatenate([opened(r["b"], kind) for r in rows]))


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket's keys: which of each part stand for several lines."""
    rows, keys, marks = _merged(table, MARK)
    order = np.argsort(keys, kind="stable")
    ordered, tags = keys[order], (marks["tag"].astype(np.uint32) << np.uint32(8) | marks["size"])[order]
    new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    held = np.diff(np.append(new, len(keys)))
    several = np.empty(len(keys), bool)
    several[order] = np.repeat(np.minimum.reduceat(tags, new) != np.maximum.reduceat(tags, new), held)
    begins = np.cumsum([0, *(r["n"] for r in rows)])
    out = []
    for r, x, y in zip(rows, begins, begins[1:], strict=False):
        at = np.flatnonzero(several[x:y])
        if len(at):
            out.append({"kind": SHARED, "part": r["part"], "bucket": r["bucket"], "n": len(at), "a": shut(at.astype(np.uint32)),
                        "b": shut(np.diff(keys[x + at], prepend=np.uint64(0)))})
    return pa.Table.from_pylist(out, SCHEMA)


def _given(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Of a part: its shared keys by bucket, with the facts of the lines that hold them."""
    place = {r["bucket"]: r["a"] for r in rows if r["kind"] == HOLDERS}
    facts = next(opened(r["a"], FACT) for r in rows if r["kind"] == FACTS_OF)
    for r in rows:
        if r["kind"] == SHARED:
            own = opened(place[r["bucket"]], np.uint32)[opened(r["a"], np.uint32)]
            yield _rows([{"kind": SHARED, "part": r["part"], "bucket": r["bucket"], "n": r["n"], "a": r["b"], "b": shut(facts[own])}])


def candidates(told: DataFrame) -> DataFrame:
    """From the rows of parts of kinds ``HOLDERS``, ``FACTS_OF``, ``SHARED``: a row for each part and bucket with shared keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[-1]["part"] != row["part"]:
                    yield from _given(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from _given(rows)

    return told.select("kind", "part", "bucket", "n", "a", "b").repartition("part").sortWithinPartitions("part").mapInArrow(run, ROW)


def pairs_of(keys: np.ndarray, facts: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the lines (``refs``) that hold each key: the pairs that may be alike, and the lines of the keys whose pairs are too many.

    Gives ``a``, ``b`` of the pairs, and of those lines ``ref``, the key's pivot, ``key`` and ``blocks``.
    They are paired with the pivot; whether they are like each other is still to be found."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    held = np.diff(np.append(new, len(keys)))
    order = order[np.repeat(held > 1, held)]
    del ordered, new, held
    # By key, then number of shingles. Of a line that several parts have the first of them stays.
    keys, facts, refs = keys[order], facts[order], refs[order]
    mark = facts["own"].astype(np.uint64) << np.uint64(24) | facts["tag"].astype(np.uint64) << np.uint64(8) | facts["size"]
    order = np.lexsort((mark, keys))
    keys, facts, refs, mark = keys[order], facts[order], refs[order], mark[order]
    if len(keys):
        other = np.append(True, (keys[1:] != keys[:-1]) | (mark[1:] != mark[:-1]) | (facts["sketch"][1:] != facts["sketch"][:-1]).any(1))
        keys, facts, refs = keys[other], facts[other], refs[other]
    n = len(keys)
    new = np.flatnonzero(np.append(np.ones(min(n, 1), bool), keys[1:] != keys[:-1]))
    held = np.diff(np.append(new, n))
    group = np.repeat(np.arange(len(new)), held)
    end = (new + held)[group]
    own, most = facts["own"], at_most(facts)

    many = held > BLOCK_LINES
    count, first, second = np.zeros(len(new), np.int64), [], []
    i, step = np.flatnonzero(~many[group]), 1
    while len(i):
        i = i[(i + step < end[i]) & ~many[group[i]]]
        i = i[most[i] >= SIMILARITY * own[i + step] - 1e-6]  # those further on have no fewer
        near = i[~unlike(facts, i, i + step)]
        first.append(near)
        second.append(near + step)
        count += np.bincount(group[near], minlength=len(new))
        many = (held > BLOCK_LINES) | (count > PAIRS_A_LINE * held)
        step += 1
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (first, second))
    some = ~many[group[i]]
    i, j = i[some], j[some]

    member = np.flatnonzero(many[group])
    pivot = (new + held // 2)[group[member]]
    low, high = np.minimum(member, pivot), np.maximum(member, pivot)
    star = (low < high) & ~unlike(facts, low, high)
    chars = np.add.reduceat(np.left_shift(1, facts["size"].astype(np.int64)), new) if n else np.empty(0, np.int64)
    blocks = np.maximum(-(-held // BLOCK_LINES), -(-chars // BLOCK_CHARS))
    a, b = refs[np.append(i, low[star])], refs[np.append(j, high[star])]
    return np.maximum(a, b), np.minimum(a, b), refs[member], refs[pivot], keys[member].astype(np.int64), blocks[group[member]]


def _met(table: pa.Table) -> pa.Table:
    """Of one bucket's shared keys: pairs ``a``, ``b`` of lines, and with ``many`` set lines ``a`` of a ``key`` whose pivot is ``b``."""
    rows, keys, facts = _merged(table, FACT)
    refs = np.repeat(np.array([r["part"] for r in rows], np.int64) << LINE_BITS, [r["n"] for r in rows]) + facts["at"]
    a, b, member, pivot, key, blocks = pairs_of(keys, facts, refs)
    none = pa.nulls(len(a), pa.int64())
    return pa.concat_tables([
        pa.Table.from_arrays([pa.array(np.zeros(len(a), bool)), pa.array(a), pa.array(b), none, none], schema=MET),
        pa.Table.from_arrays([pa.array(np.ones(len(member), bool)), pa.array(member), pa.array(pivot), pa.array(key), pa.array(blocks)], schema=MET)])


def _batches(lines: list[str]) -> Iterator[list[str]]:
    """The lines in order, about ``SIGNED_CHARS`` characters at a time."""
    held, size = [], 0
    for line in lines:
        held.append(line)
        size += len(line)
        if size >= SIGNED_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def wanted_lines(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """``ref``, ``h``, ``line`` of the lines ``ref``, and ``FACTS`` of those with ``many`` set, from a part's rows of kind ``LINES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                every = zstandard.decompress(row["a"]).split(b"\n")
                many = set(row["many_at"])
                for some in ([k for k in row["at"] if k not in many], row["many_at"]):
                    facts = [pa.nulls(len(some), pa.int64())] * len(FACTS)
                    own = [every[k] for k in some]
                    if some and some[0] in many:
                        plain = [x.decode() for x in own]
                        bits = np.concatenate([sketches(x) for x in _batches(plain)])
                        facts = [*(pa.array(np.ascontiguousarray(c)) for c in bits.T), pa.array([len(x) for x in plain], pa.int64())]
                    first = (row["part"] << LINE_BITS) + row["bucket"] * LINES_A_ROW
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([first + k for k in some], pa.int64()), pa.array([row["b"][16 * k:16 * k + 16] for k in some], pa.binary()), pa.array(own, pa.binary()), *facts],
                        names=["ref", "h", "line", *FACTS])

    number = F.col("ref").bitwiseAND(F.lit((1 << LINE_BITS) - 1))
    at = F.pmod(number, F.lit(LINES_A_ROW)).cast("int")
    by = (wanted.groupBy(F.shiftright("ref", LINE_BITS).alias("part"), F.floor(number / LINES_A_ROW).cast("int").alias("bucket"))
          .agg(F.collect_set(at).alias("at"), F.collect_set(F.when(F.col("many"), at)).alias("many_at")))
    return (lines.select("part", "bucket", "a", "b").join(by, ["part", "bucket"]).select("part", "bucket", "a", "b", "at", "many_at")
            .mapInArrow(run, "ref long, h binary, line binary, " + ", ".join(f"{c} long" for c in FACTS)))


def codes(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each line, of ``SHINGLE`` characters or more, as sorted numbers that no two shingles share."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32)
    present = np.zeros(0x110000, bool)
    present[points] = True
    chars = np.flatnonzero(present)
    if len(chars) ** SHINGLE < 1 << 64:
        rank = np.zeros(0x110000, np.uint16)
        rank[chars] = np.arange(len(chars))
        digits = rank[points].astype(np.uint64)
        value = digits[:len(digits) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            value *= np.uint64(len(chars))
            value += digits[k:k + len(value)]
    else:
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(points, SHINGLE)).view(f"V{4 * SHINGLE}").ravel()
        value = np.unique(windows, return_inverse=True)[1].astype(np.uint64)
    out, at = [], 0
    for line in lines:
        own = value[at:at + len(line) - SHINGLE + 1]
        own.sort()
        out.append(own[np.append(True, own[1:] != own[:-1])])
        at += len(line)
    return out


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches ``SIMILARITY``."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < SIMILARITY * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def compare(sets: list[np.ndarray], root: list, block: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect just what all links of sets of different roots (and blocks) would."""
    names = {r: k for k, r in enumerate(dict.fromkeys(root))}
    label = np.array([names[r] for r in root])
    found = []
    if len(sets) <= FEW:
        for i in range(1, len(sets)):
            for j in range(i):
                if label[i] != label[j] and (block is None or block[i] != block[j]) and alike(sets[i], sets[j]):
                    found.append((i, j))
                    label[label == label[j]] = label[i]
        return found
    # A bit for every shingle that several of the sets have: what two of them share is counted exactly.
    sizes = np.array([len(x) for x in sets])
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    width = -(-(int(number[-1]) + 1) // 64) * 64
    packed = np.empty((len(sets), max(64, width) // 8), np.uint8)
    at = 0
    for i, n in enumerate(sizes.tolist()):
        own = which[at:at + n]
        at += n
        row = np.zeros(max(64, width), bool)
        row[number[own[times[own] > 1]]] = True
        packed[i] = np.packbits(row)
    packed = packed.view(np.uint64)
    parted = None if block is None else np.array(block)
    for i in range(1, len(sets)):
        apart = label[:i] != label[i]
        if parted is not None:
            apart &= parted[:i] != parted[i]
        near = np.flatnonzero(apart & (np.minimum(sizes[:i], sizes[i]) >= SIMILARITY * np.maximum(sizes[:i], sizes[i])))
        if not len(near):
            continue
        both = np.bitwise_count(packed[near] & packed[i]).sum(1, dtype=np.int64)
        for j in near[both >= SIMILARITY * (sizes[near] + sizes[i] - both)].tolist():
            if label[j] != label[i]:
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows that agree in the first ``width`` columns, from batches sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for key, some in groupby(rows, key=lambda r: r[:width]):
            if held and held[0][:width] != key:
                yield held
                held = []
            held += some
    if held:
        yield held


def _linked(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def pair_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a``, ``b``: the lines of the pairs whose exact similarity reaches ``SIMILARITY``, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            texts = dict(zip(a, x, strict=True)) | dict(zip(b, y, strict=True))
            at = 0
            while at < len(a):
                some, size = {}, 0
                end = at
                while end < len(a) and size < SIGNED_CHARS:
                    for h in (a[end], b[end]):
                        if h not in some:
                            some[h] = texts[h].decode()
                            size += len(some[h])
                    end += 1
                sets = dict(zip(some, codes(list(some.values())), strict=True))
                good = [k for k in range(at, end) if alike(sets[a[k]], sets[b[k]])]
                yield _linked([a[k] for k in good], [b[k] for k in good])
                at = end

    left = texts.select(F.col("ref").alias("a"), F.col("h").alias("left"), F.col("line").alias("x"))
    right = texts.select(F.col("ref").alias("b"), F.col("h").alias("right"), F.col("line").alias("y"))
    return pairs.join(left, "a").join(right, "b").where("left <> right").select("left", "right", "x", "y").mapInArrow(run, "a binary, b binary")


NEAR = pa.schema([("key", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("h", pa.binary()), ("root", pa.binary()), ("block", pa.int64())])


def near_lines(meeting: DataFrame) -> DataFrame:
    """Of the lines that meet, those that have a line of another ``root`` there which their sketches do not rule out."""
    keys = ["key", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for group in _groups(batches, 3):
            pivot = {r[3] for r in group if r[6]}  # compared with all others already
            own = list({r[3]: r for r in group if r[3] not in pivot}.values())  # a line of several parts comes several times
            if len(own) < 2:
                continue
            names: dict[bytes, int] = {}
            root = np.array([names.setdefault(r[4], len(names)) for r in own])
            facts = np.array([r[7:] for r in own], np.int64)
            bits, chars = facts[:, :SKETCH].astype(np.uint64), facts[:, SKETCH]  # of a negative number the magnitude's bits would be counted
            apart = root[:, None] != root
            if group[0][1] != group[0][2]:
                block = np.array([r[5] for r in own])
                apart &= block[:, None] != block
            differ = sum(np.bitwise_count(x[:, None] ^ x).astype(np.int64) for x in bits.T)
            apart &= ~ruled_out(differ, chars[:, None] + chars)
            found += [own[k][:6] for k in np.flatnonzero(apart.any(1)).tolist()]
            if len(found) > LINES_A_ROW:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), NEAR.types, strict=True)], schema=NEAR)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), NEAR.types, strict=True)], schema=NEAR)

    held = meeting.select(*keys, "h", "root", "block", "pivot", *FACTS).repartition(*keys).sortWithinPartitions(*keys)
    return held.mapInArrow(run, "key long, x long, y long, h binary, root binary, block long")


def block_links(meeting: DataFrame) -> DataFrame:
    """``a``, ``b``: links between lines ``h``, ``line`` of different ``root`` that meet, those of blocks ``x`` and ``y`` of a ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = UnionFind()  # what this task has found need not be compared in its further groups
        waiting: list[tuple[dict, bool]] = []
        size = 0

        def settled() -> Iterator[pa.RecordBatch]:
            nonlocal known
            texts = {h: r[4].decode() for own, _ in waiting for h, r in own.items()}
            sets = dict(zip(texts, codes(list(texts.values())), strict=True)) if texts else {}
            a, b = [], []
            for own, parted in waiting:
                h = list(own)
                root = [known.find(r[5]) for r in own.values()]
                if len(set(root)) > 1:
                    for i, j in compare([sets[x] for x in h], root, [r[6] for r in own.values()] if parted else None):
                        a.append(h[i])
                        b.append(h[j])
                        known.union(root[i], root[j])
            if len(known.parent) > KNOWN:
                known = UnionFind()
            yield _linked(a, b)

        for group in _groups(batches, 3):
            own = {r[3]: r for r in group}
            if len({r[5] for r in own.values()}) > 1:
                waiting.append((own, group[0][1] != group[0][2]))
                size += sum(len(r[4]) for r in own.values())
                if size >= SIGNED_CHARS:
                    yield from settled()
                    waiting, size = [], 0
        yield from settled()

    keys = ["key", "x", "y"]
    return meeting.select(*keys, "h", "line", "root", "block").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary")


def line_links(own: DataFrame, path: str) -> DataFrame:
    """``node``, ``root`` of distinct lines that are like others, from the rows of all parts, of which all but the places are deleted."""
    spark = own.sparkSession
    shared_path, met_path, pairs_path, texts_path, alike_path = (scratch_path(spark, f"line-{x}") for x in ("shared", "met", "pairs", "texts", "alike"))
    shared = materialise(own.where(F.col("kind") == KEYS).groupBy("bucket").applyInArrow(_shared, ROW), "line-shared", shared_path)
    discard(spark, f"{path}/kind={KEYS}")
    told = candidates(own.where(F.col("kind").isin(HOLDERS, FACTS_OF)).union(shared))
    met = materialise(told.groupBy("bucket").applyInArrow(_met, "many boolean, a long, b long, key long, blocks long"), "line-met", met_path, by=("many",))
    for gone in (f"{path}/kind={HOLDERS}", f"{path}/kind={FACTS_OF}", shared_path):
        discard(spark, gone)
    pairs = materialise(met.where("NOT many").select("a", "b").distinct(), "line-pairs", pairs_path)
    members = met.where("many").select(F.col("a").alias("ref"), (F.col("a") == F.col("b")).alias("pivot"), "key", "blocks")
    wanted = (pairs.select(F.explode(F.array("a", "b")).alias("ref"), F.lit(False).alias("many"))
              .union(members.select("ref", F.lit(True))))
    texts = materialise(wanted_lines(wanted, own.where(F.col("kind") == LINES)), "line-texts", texts_path)
    discard(spark, f"{path}/kind={LINES}")
    # Links are written: union-find in the same task would need a second Python worker, that stays.
    linked = materialise(pair_links(pairs, texts), "line-alike", alike_path)
    for gone in (pairs_path, f"{met_path}/many=false"):
        discard(spark, gone)
    if not members.isEmpty():
        linked = linked.union(member_links(members, texts, connected_components(linked, "line-links")))
    found = connected_components(linked, "line-links")
    for gone in (met_path, texts_path, alike_path):
        discard(spark, gone)
    return found


def member_links(members: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between lines of keys that many lines share and that ``roots`` does not connect."""
    spark = members.sparkSession
    held = members.join(texts.select("ref", "h", *FACTS), "ref")
    marked = held.join(roots, held["h"] == roots["node"], "left").select("key", "blocks", "pivot", "h", F.coalesce("root", "h").alias("root"), *FACTS)
    apart = marked.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    block = F.pmod(F.xxhash64("h"), F.col("blocks"))
    meeting = (marked.join(apart, "key").withColumn("block", block)
               .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
               .withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}))
    path = scratch_path(spark, "line-meeting")
    near = materialise(near_lines(meeting), "line-meeting", path).join(texts.select("h", "line").where(F.col(FACTS[0]).isNotNull()), "h")
    links = materialise(block_links(near), "line-blocks")
    discard(spark, path)
    return links


def removals(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no``, ``kept_in``: every line that goes, and the document that keeps its like."""
    spark = docs.sparkSession
    box = Isolated(docs)
    texts = box.df.select(box["doc_id"].cast("long").alias("doc_id"), box["text"].alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    breaks = texts.agg(F.count("*"), F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))))).first()
    keys = BANDS * (breaks[0] + (breaks[1] or 0))
    bits = min(30, max(1, (keys // BUCKET_KEYS).bit_length()))
    path = scratch_path(spark, "line-parts")
    own = materialise(parts(texts, bits), "line-parts", path, by=("kind",))
    roots = line_links(own, path)

    seen = own.where(F.col("kind") == PLACES).select("h", "doc_id", "line_no")
    place = F.struct("doc_id", "line_no")
    lines = materialise(seen.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")), "line-distinct")
    nodes = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = lines.join(nodes, lines["h"] == nodes["node"]).select("h", "first", "root")
    kept = linked.groupBy("root").agg(F.min("first").alias("kept"))
    of = linked.join(kept, "root").select("h", "kept")
    alone = lines.where("n > 1").join(nodes, lines["h"] == nodes["node"], "left_anti").select("h", F.col("first").alias("kept"))
    return (seen.join(of.union(alone), "h").where((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("line_no") != F.col("kept.line_no")))
            .select("doc_id", "line_no", F.col("kept.doc_id").alias("kept_in")))


def _by_document(docs: DataFrame) -> DataFrame:
    return removals(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("line_no", "kept_in"))).alias("gone"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_lines``, ``n_kept``, ``removed_lines``
    (their numbers from 0) and ``kept_in`` (for each, the document that keeps it)."""
    gone = materialise(_by_document(docs), "line-gone")
    box = Isolated(docs)
    counted = box.df.select(box["doc_id"].cast("long").alias("doc_id"),
                            F.when(box["text"].isNull(), 0).otherwise(F.size(F.split(box["text"], "\n"))).alias("n_lines"))
    none = F.array().cast("array<struct<line_no:int,kept_in:bigint>>")
    return (counted.join(gone, "doc_id", "left").withColumn("gone", F.coalesce("gone", none))
            .select("doc_id", "n_lines", (F.col("n_lines") - F.size("gone")).alias("n_kept"),
                    F.col("gone.line_no").alias("removed_lines"), F.col("gone.kept_in").alias("kept_in")))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents without the lines that go; one of which nothing but white space is left goes itself.

    ``n_chars``, where there is such a column, follows the text."""
    gone = materialise(_by_document(docs).select(F.col("doc_id").alias("gone_id"), F.col("gone.line_no").alias("gone_lines")), "line-gone")
    box = Isolated(docs)
    kept = F.array_join(F.filter(F.split(box["text"], "\n"), lambda _, k: ~F.array_contains("gone_lines", k)), "\n")
    joined = (box.df.join(gone, box["doc_id"].cast("long") == gone["gone_id"], "left")
              .withColumn("left_text", F.when(F.col("gone_lines").isNull(), box["text"]).otherwise(kept))
              .where(F.col("gone_lines").isNull() | F.col("left_text").rlike("[^\\x20\\x09-\\x0D]")))
    if "n_chars" in [x.lower() for x in box.names]:
        target = box.inner[[x.lower() for x in box.names].index("n_chars")]
        joined = joined.withColumn(target, F.when(F.col("gone_lines").isNull(), F.col(target)).otherwise(F.length("left_text").cast(docs.schema[box.inner.index(target)].dataType)))
    return box.replaced(joined, "text", F.col("left_text"))
