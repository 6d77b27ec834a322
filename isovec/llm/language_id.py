"""Language identification (operator 10) by cross-parsing entropy.

Labelled text of each language is turned into a suffix automaton. A text is
parsed greedily into the longest phrases that occur in a language's text; with
``p`` phrases over ``n`` characters and ``m`` characters of language text, the
cross-parsing entropy is ``p * log2(m) / n``. A letter that the language's text
does not have counts as two phrases, one to say so and the letter itself. The
language of the least entropy wins; equal ones go to the alphabetically first.

Texts are parsed whole, in blocks of ``BLOCK`` characters of which each starts a
new phrase, so that one long text is as quick as many short ones: the blocks of
a batch advance together, one character a step. The transitions of all automata
stand in one hash table of two places a key, whose size follows the number of
transitions and not that of letters: every letter of the fitted texts takes part.

The automata are fitted on a bounded sample: for each language the whole texts of
``FIT_ROWS`` labelled rows, those first in the order of a hash of their id.
Everything else covers all rows.

Edge cases: null texts and texts without a letter are ``und`` with score 0; rows
of null language teach nothing; no labelled row at all makes every text ``und``;
repeated rows get equal predictions, and labelled ones
may stand several times among the fitted rows; languages of equal entropy go to the
alphabetically first; texts of any length are parsed whole; an empty table gives an empty result;
further columns of the input, also of clashing names, are ignored by
``identify`` and kept by ``filter_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Isolated, fold, keep

FIT_ROWS = 16
BLOCK = 1024
BATCH_CHARS = 1_000_000
#: Texts that are Python strings at a time.
BATCH_ROWS = 512
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


def sample(docs: DataFrame, doc_id: Column, text: Column, lang: Column) -> dict[str, str]:
    """The bounded fitting text by language.

    Only ids, digests and languages are ranked; the texts of the chosen rows, at
    most ``FIT_ROWS`` a language, are then read.
    """
    labelled = docs.select(doc_id.alias("id"), text.alias("text"), lang.alias("lang"), F.xxhash64(text).alias("mark")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & (fold(F.col("id"), FOLDS) != HELD_OUT))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "mark")
    chosen = labelled.select("id", "mark", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIT_ROWS).collect()
    if not chosen:
        return {}
    rank = {(r["lang"], r["id"], r["mark"]): r["r"] for r in chosen}
    rows = (labelled.where(F.col("id").isin([r["id"] for r in chosen]) & F.col("mark").isin([r["mark"] for r in chosen]))
            .dropDuplicates(["id", "lang", "mark"]).collect())
    texts: dict[str, list] = {}
    for r in rows:
        if (key := (r["lang"], r["id"], r["mark"])) in rank:
            texts.setdefault(r["lang"], []).append((rank[key], r["text"]))
    return {k: " ".join(t for _, t in sorted(v)) for k, v in sorted(texts.items())}


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """By code point of the basic plane: the lower-case letter, or a space."""
    out = np.full(65536, 32, np.int32)
    for c in range(65536):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 65536 else c
    return out


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points; a run of anything else is one space."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = _folded()[np.minimum(points, 65535)]
    if (high := points > 65535).any():
        kinds, where = np.unique(points[high], return_inverse=True)
        low[high] = np.array([k if chr(k).isalpha() else 32 for k in kinds.tolist()], np.int32)[where]
    space = low == 32
    return low[~(space & np.concatenate(([False], space[:-1])))]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state; 0 is the root. Every walk from the root spells a substring."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


class Sparse:
    """A fixed map of numbers, looked up many at a time. A key stands in one of two places, to which cuckoo hashing moves it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        for attempt in range(1000):
            rng = np.random.default_rng(attempt)
            self.odd = (rng.integers(1, 1 << 62, 2).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
            held = np.full((2, 1 << int(64 - self.shift)), -1, np.int64)  # which key stands where
            waiting, side = np.arange(len(keys)), 0
            for _ in range(200):
                if not len(waiting):
                    break
                at = self._place(keys[waiting], side)
                out = held[side, at]
                held[side, at] = waiting  # of several, the last stays
                lost = waiting[held[side, at] != waiting]
                waiting, side = np.unique(np.concatenate([out[out >= 0], lost])), 1 - side
            else:
                continue
            break
        self.keys = np.where(held >= 0, keys[held] if len(keys) else -1, -1)
        self.values = np.where(held >= 0, values[held] if len(keys) else -1, -1).astype(np.int32)

    def _place(self, keys: np.ndarray, side: int) -> np.ndarray:
        return ((keys.view(np.uint64) * self.odd[side]) >> self.shift).view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that are not there."""
        a, b = self._place(keys, 0), self._place(keys, 1)
        return np.where(self.keys[0][a] == keys, self.values[0][a], np.where(self.keys[1][b] == keys, self.values[1][b], -1))


class Parser:
    """The automata of all languages, and the parse of many blocks at a time."""

    def __init__(self, texts: tuple[tuple[str, str], ...]):
        self.langs = [k for k, _ in texts]
        refs = [letters(t) for _, t in texts]
        self.bits = np.array([np.log2(max(2, len(r))) for r in refs])
        seen = np.unique(np.concatenate([*refs, np.array([32])]))
        self.known = seen[seen != 32]
        self.size = len(self.known) + 2  # 0: a letter of no language's text, 1: space
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[self.known] = np.arange(2, self.size)
        self.class_of[32] = 1
        roots, keys, values, total = [], [], [], 0
        for r in refs:  # one automaton at a time: as dictionaries they are large
            roots.append(total)
            automaton = suffix_automaton(self.classes(r).tolist())
            keys.append(np.fromiter(((state + total) * self.size + c for state, row in enumerate(automaton) for c in row), np.int64))
            values.append(np.fromiter((to + total for row in automaton for to in row.values()), np.int64))
            total += len(automaton)
            del automaton
        self.roots = np.array(roots, np.int64)
        none = [np.empty(0, np.int64)]
        self.step = Sparse(np.concatenate(keys or none), np.concatenate(values or none))
        first = self.step.of(self.roots[:, None] * self.size + np.arange(self.size))
        self.first = np.where(first < 0, self.roots[:, None], first)

    def classes(self, symbols: np.ndarray) -> np.ndarray:
        return self.class_of[symbols]

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases by language and block, for blocks given by start and length."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        root = self.roots[:, None]
        state = np.repeat(root, len(starts), 1)
        count = np.zeros(state.shape, np.int32)
        live = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
        for j, n in enumerate(live.tolist()):
            c = symbols[starts[:n] + j]
            at = state[:, :n]
            to = self.step.of(at * self.size + c)
            ends = to < 0
            now = np.where(ends, self.first[:, c], to)
            # A phrase ends; a letter that the language never has costs two, one to say so and the letter.
            count[:, :n] += ends & (at != root)
            count[:, :n] += 2 * (now == root)
            state[:, :n] = now
        count += state != root
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            symbols = letters(text or "")
            if (symbols != 32).any():
                held.append((i, symbols))
                size += len(symbols)
            if held and (size >= BATCH_CHARS or i == len(texts) - 1):
                self._settle(held, langs, scores)
                held, size = [], 0
        if held:
            self._settle(held, langs, scores)
        return langs, scores

    def _settle(self, held: list[tuple[int, np.ndarray]], langs: list[str], scores: list[float]) -> None:
        lengths = np.array([len(s) for _, s in held])
        blocks = -(-lengths // BLOCK)
        of = np.repeat(np.arange(len(held)), blocks)
        place = (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        count = self.phrases(self.classes(np.concatenate([s for _, s in held])),
                             np.repeat(np.cumsum(lengths) - lengths, blocks) + place,
                             np.minimum(BLOCK, lengths[of] - place))
        total = np.stack([np.bincount(of, row, len(held)) for row in count])
        entropy = total * self.bits[:, None] / lengths
        best = entropy.argmin(0)
        least = entropy.min(0)
        second = np.partition(entropy, 1, 0)[1] if len(self.langs) > 1 else None
        sure = second / np.maximum(least + second, 1e-300) if second is not None else np.ones(len(held))
        for k, (i, _) in enumerate(held):
            langs[i], scores[i] = self.langs[best[k]], float(sure[k])


def classify(df: DataFrame, text: str, fitted: dict[str, str], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language and its score. Only texts go to Python, and only predictions come back."""
    texts = tuple(fitted.items())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = keep(("language", texts), lambda: Parser(texts))
        for batch in batches:
            langs, scores = [], []
            for at in range(0, len(batch), BATCH_ROWS):
                some = p.predict(batch.slice(at, BATCH_ROWS).to_pylist())
                langs += some[0]
                scores += some[1]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Called nondeterministic so that no rule of the optimizer copies the call.
    found = F.arrow_udf(run, "lang string, score double").asNondeterministic()
    return df.withColumn("_found", found(F.col(text))).select(*df.columns, F.col("_found.lang").alias(pred), F.col("_found.score").alias(score))


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``."""
    box = Isolated(docs)
    fitted = sample(box.df, box["doc_id"], box["text"], box["lang"])
    inner = box.df.select(box["doc_id"].alias("doc_id"), box["text"].alias("text"))
    found = classify(inner, "text", fitted)
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def filter_documents(docs: DataFrame, min_score: float = 0.505) -> DataFrame:
    """The rows whose language is known: not ``und``, and set apart from the second best by ``min_score``."""
    box = Isolated(docs)
    fitted = sample(box.df, box["doc_id"], box["text"], box["lang"])
    text = box.inner[[x.lower() for x in box.names].index("text")]
    found = classify(box.df, text, fitted, "_pred", "_score")
    return box.restore(found.where((F.col("_pred") != UNKNOWN) & (F.col("_score") >= min_score)))
