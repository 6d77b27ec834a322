"""Each operator against brute force on a small fixture, and its edge cases."""

import hashlib
import math
import random
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

pytest.importorskip("isovec.llm")
from isovec.llm import (  # noqa: E402
    common, katz, language_id, line_dedup, packing, quality_classifier, quality_rules, sentencepiece_codec, simhash, token_counts, units, weighted_minhash)
from isovec.llm.graph import connected_components  # noqa: E402
from isovec.llm.queries import tokenizer_path  # noqa: E402

EN = "the of and to in house river stone garden window morning paper water letter singing bridge forest quiet winter market".split()
DE = "der die das und ist haus fluss garten fenster morgen papier wasser brief brücke wald ruhig winter markt straße über".split()
EDGES = [(1000, None), (1001, ""), (1002, " \n\t "), (None, "the house and the river"), (None, None), (1003, "漢字 😀 <|endoftext|> é"), (1004, "word"),
         (1004, "word"), (1005, "long " * 30000)]


def text(rng, words, lines=3):
    return "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(8, 25))) + "." for _ in range(lines))


def corpus():
    rng = random.Random(5)
    rows = [(i, text(rng, EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(40)]
    rows += [(100 + k, rows[k][1], rows[k][2]) for k in range(3)]  # copies
    rows += [(200 + k, rows[k][1] + " more", rows[k][2]) for k in range(3)]  # near copies
    return rows


@pytest.fixture(scope="module")
def rows():
    return [*corpus(), *((i, t, None) for i, t in EDGES)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with what operators add, and one repeated but for its case."""
    data = [(i, t, lang, "s", len(t or ""), 1, 2, 3) for i, t, lang in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, h int, score int, words int").repartition(2).cache()


def known(found):
    return {r["doc_id"]: r for r in found.collect() if r["doc_id"] is not None}


def words(t):
    return (t or "").encode().split()


def test_quality_rules(docs, rows):
    found = known(quality_rules.quality_rules(docs))
    for i, t, _ in rows:
        if i is None:
            continue
        ws, ls = words(t), [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
        seen = Counter(tuple(ws[k:k + 8]) for k in range(len(ws) - 7))
        repeated = {k + j for k in range(len(ws) - 7) if seen[tuple(ws[k:k + 8])] > 1 for j in range(8)}
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (
            len(ws), sum(len(w.decode()) for w in ws), len(repeated), len(ls) - len(set(ls)))
        assert r["base_failed"] == (len(ws) < 20 or 100 * len(repeated) > 30 * len(ws))
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and set(known(kept)) == {i for i, r in found.items() if r["kept"]}
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_quality_rules_long_text(spark):
    """A clean text is not rejected for its length."""
    rng = random.Random(4)
    long = "\n".join(" ".join(rng.choice(EN) + f"{rng.randrange(9999)}" if k % 4 else "the" for k in range(20)) for _ in range(5100))
    found = known(quality_rules.quality_rules(spark.createDataFrame([(1, long)], "doc_id long, text string")))
    assert found[1]["n_words"] == 102000 and found[1]["kept"]


def test_language_id(docs, rows):
    found = known(language_id.identify(docs))
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows if lang)
    assert found[1000]["lang_pred"] == found[1002]["lang_pred"] == "und"
    assert language_id.identify(docs.limit(0)).count() == 0


def test_language_id_letters():
    """Every letter of the fitted texts takes part, however many there are; equal languages go to the first by name."""
    rng = random.Random(3)

    def text_of(k, n):
        return "".join(chr(0x4E00 + 1500 * k + rng.randrange(1500)) for _ in range(n))

    p = language_id.Parser(tuple((f"l{k}", " ".join(text_of(k, 400) for _ in range(16))) for k in range(3)))
    texts = [(f"l{k}", text_of(k, 60)) for k in range(3) for _ in range(50)]
    assert p.predict([t for _, t in texts])[0] == [k for k, _ in texts]
    same = language_id.Parser((("a", "river stone"), ("b", "river stone")))
    assert same.predict(["stone", "###", None, "river" * 1000]) == (["a", "und", "und", "a"], [0.5, 0.0, 0.0, 0.5])
    keys = np.array(rng.sample(range(1 << 40), 5000), np.int64)
    table = language_id.Sparse(keys, np.arange(5000))
    assert (table.of(keys) == np.arange(5000)).all() and (table.of(keys + (1 << 41)) == -1).all()


def test_automaton():
    ref, t = "abracadabra", "cadabrazabrac"
    p = language_id.Parser((("x", ref),))
    s = language_id.letters(t)
    got = p.phrases(p.classes(s), np.array([0]), np.array([len(s)]))[0, 0]
    n, k = 0, 0
    while k < len(t):
        m = max([j for j in range(1, len(t) - k + 1) if t[k:k + j] in ref], default=0)
        k, n = k + max(1, m), n + (1 if m else 2)
    assert got == n


def test_quality_classifier(spark, docs):
    rng = random.Random(1)
    good = [(i, text(rng, EN)) for i in range(200)]
    bad = [(500 + i, " ".join(w + "###" for w in rng.choices(EN, k=40))) for i in range(100)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:100]], "doc_id long, quality int")
    found = known(quality_classifier.classify(table, labels))
    assert np.mean([found[i]["predicted"] for i, _ in good]) > 0.95 and np.mean([found[i]["predicted"] for i, _ in bad]) < 0.05
    rest = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert len(rest) == docs.count() and all(r["score"] == 0.5 for r in rest)


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    found = known(token_counts.count_tokens(docs, path))
    small = token_counts.Counter(whole, huge=64, chunk=50, overlap=4)
    for i, t, _ in rows:
        if i is not None:
            n = len(whole.encode(t or "", add_special_tokens=False).ids)
            assert found[i]["n_tokens"] == n and found[i]["n_bytes"] == len((t or "").encode())
            if len(t or "") < 5000:
                assert small.count(t) == n
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0
    for t in ("  a  b \n\n c\t d ", "a <|endoftext|> b", "é" * 300 + " b " * 90, "\n \n" * 90, "x" * 400):
        assert small.count(t) == len(whole.encode(t, add_special_tokens=False).ids)
    assert small.widened


def test_token_counts_without_spaces():
    """Boundaries other than single spaces, and none at all; the work grows with the text and not with its square."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(6)
    atoms = ["漢字", "😀", "'s", "'", "don't", "foo", " ", "  ", "\n", "\n\n", "é", "<|endoftext|>", "\t", "1", "½", "Ⅷ", ".", "!", "_", "|", "<", ">"]
    counters = [token_counts.Counter(whole, huge=1, chunk=c, overlap=o) for c, o in ((8, 2), (20, 4), (33, 16))]
    for _ in range(600):
        t = "".join(rng.choices(atoms, k=rng.randint(5, 60)))
        assert {c.count(t) for c in counters} == {len(whole.encode(t, add_special_tokens=False).ids)}
    counter, encoded = token_counts.Counter(whole), []
    plain = counter.starts
    counter.starts = lambda text, at, end: encoded.append(end - at) or plain(text, at, end)
    t = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(160_000))
    right = counter.count(t) == len(whole.encode(t, add_special_tokens=False).ids)
    assert right and sum(encoded) < (1 + 4 / 3) * len(t)  # chunks that grow fourfold up to the text


def test_sentencepiece_strings():
    """Against the library: outer and double spaces, rare letters, markers and names of pieces, in random order and with what is remembered."""
    path = tokenizer_path("piece_bpe_32k.model")
    rng = random.Random(1)
    atoms = ["漢字", "😀", "١", "foo", " ", "  ", "\n", "▁", "▁▁", " a", "é", "<s>", "<unk>", "<0x0A>", "\t", "x y", "the", "</s>", "\u3000", "\xa0", "###"]
    texts = ["漢字 ", "😀 ", "١ ", "漢字", " ", "  ", "▁", "a▁", "▁a", "a  ▁b", *("".join(rng.choices(atoms, k=rng.randint(1, 9))) for _ in range(2000))]
    rng.shuffle(texts)
    codec, lib = sentencepiece_codec.Codec(path), sentencepiece_codec.library(path)
    for k in range(0, len(texts), 37):
        some = texts[k:k + 37]
        own = codec.encode(some)
        assert own == [np.array(x, "<u4").tobytes() for x in lib.encode(some)]
        assert [codec.decode(x).decode() for x in own] == [codec.tokenizer.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in own]


def test_sentencepiece_unigram():
    """A unigram model with byte fallback, white space that is stripped, and pieces that no text gives, written here as a protobuf."""
    import struct

    import sentencepiece

    def field(number, kind, data):
        return bytes([*varint(number << 3 | kind), *(varint(len(data)) if kind == 2 else b""), *data])

    def varint(n):
        return bytes([n & 127 | 128, *varint(n >> 7)]) if n > 127 else bytes([n])

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{b:02X}>", 0, 6) for b in range(256)), ("▁", -3, 1), ("▁the", -2, 1), ("the", -4, 1),
              *((c, -5 - k / 8, 1) for k, c in enumerate("abcdehnrstu<>k")), ("an", -4.5, 1), ("▁an", -4.2, 1), ("th", -4.9, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, varint(t))) for p, s, t in pieces)
    data += field(2, 2, field(3, 0, varint(1)) + field(35, 0, varint(1)) + field(40, 0, varint(0)))
    data += field(3, 2, field(3, 0, varint(1)) + field(4, 0, varint(1)) + field(5, 0, varint(1)))
    lib = sentencepiece.SentencePieceProcessor(model_proto=data)
    tokenizer = sentencepiece_codec.build(sentencepiece_codec.parse(data))
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choices(["the", "an", " ", "  ", "<unk>", "<s>", "é", "b", "sun", "漢"], k=rng.randint(1, 8)))
        assert tokenizer.encode(t, add_special_tokens=False).ids == lib.encode(t), t


def test_sentencepiece(docs):
    path = tokenizer_path("piece_bpe_32k.model")
    found = sentencepiece_codec.verify(docs, path).collect()
    assert len(found) == docs.count() and all(r["parity"] and r["round_trip"] for r in found)
    ids = sentencepiece_codec.encode(docs.where("doc_id < 5"), path)
    back = known(sentencepiece_codec.decode(ids, path))
    assert {i: r["text"] for i, r in back.items()} == {r["doc_id"]: r["text"] for r in docs.where("doc_id < 5").collect()}
    assert sentencepiece_codec.decode(ids.selectExpr("doc_id", "CAST(NULL AS array<int>) AS ids"), path).where("text IS NOT NULL").count() == 0
    assert sentencepiece_codec.verify(docs.limit(0), path).count() == 0


def test_weighted_minhash(docs, rows):
    found = known(weighted_minhash.fingerprint(docs))
    order = sorted({i: t or "" for i, t, _ in rows if i is not None}.items(), reverse=True)
    off = []
    for k, (i, t) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edit = t[:len(t) - half] + follow[:half]
        a, b = Counter(words(t)), Counter(words(edit))
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        off.append(r["near_edited"] - (sum((a & b).values()) / sum((a | b).values()) if a | b else 1))
    assert abs(np.mean(off)) < 0.04 and np.std(off) < 0.15
    assert found[0]["fingerprint"] == found[100]["fingerprint"] and found[1000]["near_next"] == 0
    assert weighted_minhash.fingerprint(docs.limit(0)).count() == 0


def test_weighted_minhash_error(spark):
    """The error of the likeness is that of 64 samples by the binomial; half as many have 1.41 times it."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices([*EN, *(f"{w}s" for w in EN), *DE], k=60)) for _ in range(600)]
    found = known(weighted_minhash.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    off, due = [], []
    for i, t in enumerate(texts):
        follow, half = texts[i - 1], len(t) // 2
        a, b = Counter(words(t)), Counter(words(t[:len(t) - half] + follow[:half]))
        j = sum((a & b).values()) / sum((a | b).values())
        off.append((found[i]["near_edited"] - j) ** 2)
        due.append(j * (1 - j) / 64)
    assert sum(off) < 1.2 ** 2 * sum(due)


def fingerprint(t):
    ws = [w.decode() for w in (t or "").encode().lower().split()]
    parts = [" ".join(ws[k:k + 3]) for k in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("crowd", [64, 1])
def test_simhash(docs, rows, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    every = simhash.near_duplicates(docs)
    assert Counter(r["doc_id"] for r in every.collect()) == Counter(i for i, _, _ in rows)  # repeated rows too
    found = known(every)
    fps = {i: fingerprint(t) for i, t, _ in rows if i is not None}
    root = {i: i for i in fps}
    for _ in fps:  # labels spread until they settle
        for i in fps:
            root[i] = min(root[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2)
    assert {i: (int(r["fingerprint"], 16), r["component_id"]) for i, r in found.items()} == {i: (fps[i], root[i]) for i in fps}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "x long, y long")).collect()}
    root = {x: x for p in links for x in p}
    while True:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
        if not changed:
            break
    assert got == {x: r for x, r in root.items() if x != r}


def test_line_dedup(docs, rows):
    found = known(line_dedup.removed_lines(docs))
    held = [(i, k, x) for i, t in sorted({(i, t) for i, t, _ in rows if i is not None}, key=str) for k, x in line_dedup.lines_of(t)]
    held.sort()
    root = list(range(len(held)))
    sets = [line_dedup.shingles(x) for _, _, x in held]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(held)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {(i, k): d for i, r in found.items() for k, d in zip(r["removed_lines"], r["kept_in"], strict=True)} == {
        held[a][:2]: held[find(a)][0] for a in range(len(held)) if find(a) != a}
    assert line_dedup.removed_lines(docs.limit(0)).count() == 0
    kept = line_dedup.filter_documents(docs)
    assert kept.columns == docs.columns and 100 not in known(kept) and 5 in known(kept)


def test_line_compare():
    """Blocks by bitmaps and small groups give the components of all pairs; lines of other alphabets too."""
    rng = random.Random(12)
    base = ["".join(rng.choices("abcdefgh ", k=80)) for _ in range(4)] + ["".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(60)) for _ in range(150)]
    lines = list(dict.fromkeys(x[:k] + "#" * rng.randrange(3) + x[k + 2:] for x in base for k in (3, 20, 41, 50)))
    sets = line_dedup.codes(lines)
    assert [len(x) for x in sets] == [len(line_dedup.shingles(x)) for x in lines]

    def roots(links, n):
        u = line_dedup.UnionFind()
        for a, b in links:
            u.union(a, b)
        return [u.find(k) for k in range(n)]

    def true(some):
        own = [line_dedup.shingles(lines[k]) for k in some]
        return [(a, b) for a in range(len(own)) for b in range(a) if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])]

    for some in (range(40), range(0, 5), range(100, 300)):
        assert roots(line_dedup.compare([sets[k] for k in some], list(some)), len(some)) == roots(true(some), len(some))
    block = [k % 2 for k in range(40)]
    assert roots(line_dedup.compare(sets[:40], list(range(40)), block), 40) == roots([(a, b) for a, b in true(range(40)) if (a + b) % 2], 40)


def test_line_dedup_blocks(spark, monkeypatch):
    """Many lines of one key in small blocks: all that are alike by chains are found, across blocks too."""
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 3)
    monkeypatch.setattr(line_dedup, "PART_CHARS", 400)
    rng = random.Random(2)
    line = " ".join(rng.choice(EN) for _ in range(14))
    lines = [line]
    while len(lines) < 30:
        k = rng.randrange(len(line) - 3)
        line = line[:k] + rng.choice("xyz") + line[k + 1:]
        lines.append(line)
    sets = [line_dedup.shingles(x) for x in lines]
    root = list(range(30))
    for _ in range(30):
        for a in range(30):
            root[a] = min(root[b] for b in range(30) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    found = known(line_dedup.removed_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)))
    assert {i: r["kept_in"] for i, r in found.items()} == {i: [root[i]] if root[i] != i else [] for i in range(30)}


def test_line_dedup_short_edits(spark):
    """One letter or word edited in lines of 40 to 100 characters, against the similarity of their 5-character shingles."""
    rng = random.Random(8)
    data, like = [], {}
    for i in range(60):
        line = ""
        while len(line) < 40 + i:
            line += "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) + " "
        line = line[:40 + i]
        k = rng.randrange(10, 25)
        letter = line[:k] + "0" + line[k + 1:]
        ws = line.split(" ")
        ws[len(ws) // 2] = "edit"
        data += [(i, line), (100 + i, letter), (200 + i, " ".join(ws))]
        sets = [{x[j:j + 5] for j in range(len(x) - 4)} for x in (line, letter, " ".join(ws))]
        near = [len(a & b) >= 0.8 * len(a | b) for a, b in ((sets[0], sets[1]), (sets[0], sets[2]), (sets[1], sets[2]))]
        like[100 + i] = near[0] or near[1] and near[2]
        like[200 + i] = near[1] or near[0] and near[2]
    found = known(line_dedup.removed_lines(spark.createDataFrame(data, "doc_id long, text string")))
    assert {i: r["removed_lines"] for i, r in found.items() if i >= 100} == {i: [0] if x else [] for i, x in like.items()}
    assert sum(like[100 + i] for i in range(60)) > 45 and sum(like[200 + i] for i in range(60)) > 10


def test_line_dedup_short_lines(spark):
    """Lines under 16 characters, of under 5 too: of equal ones the first stays, blank ones stay, a copy goes whole."""
    long = "the river runs past the old stone bridge in the morning"
    data = [(1, f"And ornd.\n\n{long}\nLes."), (2, f"And ornd.\n\n{long}\nLes."), (3, "Les.\nA line of 1 own.\n \nLes!\nab"), (4, "ab\nAnd ornd.\nab c"),
            (5, None), (6, "\n\n")]
    table = spark.createDataFrame(data, "doc_id long, text string")
    found = known(line_dedup.removed_lines(table))
    assert {i: dict(zip(r["removed_lines"], r["kept_in"], strict=True)) for i, r in found.items()} == {
        1: {}, 2: {0: 1, 2: 1, 3: 1}, 3: {0: 1}, 4: {0: 3, 1: 1}, 5: {}, 6: {}}
    assert {i: r["text"] for i, r in known(line_dedup.filter_documents(table)).items()} == {
        1: data[0][1], 3: "A line of 1 own.\n \nLes!\nab", 4: "ab c", 5: None, 6: "\n\n"}


def test_katz(docs, rows, monkeypatch):
    monkeypatch.setattr(katz, "PART_TOKENS", 300)
    found = known(katz.score(docs))
    single, pair, texts = Counter(), Counter(), {}
    for i, t, _ in rows:
        ws = [*(t or "").encode().lower().split(), katz.END]
        texts[i] = ws
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            single.update(ws)
            pair.update(zip([katz.START, *ws[:-1]], ws, strict=True))
    total = sum(single.values())
    low = lambda c: [0, *(sum(x == r for x in c.values()) for r in range(1, 7)), sum(x > 6 for x in c.values())]
    model, d2 = katz.Singles([total, *low(single)]), katz.discounts(low(pair))
    p1 = lambda w: float(model.of(np.array([single[w]], float))[0])
    cut = lambda c: c * (d2[c] if c <= 5 else 1)
    seen = {}
    for (v, w), c in pair.items():
        x = seen.setdefault(v, [0, 0, 0])
        seen[v] = [x[0] + c, x[1] + cut(c), x[2] + p1(w)]

    def p(v, w):
        if v not in seen:
            return p1(w)
        n, kept, covered = seen[v]
        left = max(1 - kept / n, 0.5 / (n + 1))
        return (1 - left) * cut(pair[v, w]) / kept if pair[v, w] else left / (1 - covered) * p1(w)

    for i, ws in texts.items():
        if i is not None:
            r = found[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(single[w] > 0 for w in ws), total)
            assert r["score"] == pytest.approx(sum(math.log10(p(v, w)) for v, w in zip([katz.START, *ws[:-1]], ws, strict=True)))
            assert r["base_score"] == pytest.approx(sum(math.log10((single[w] + 0.5) / (total + 0.5 * (len(single) + 1))) for w in ws))
    for v in (b"the", katz.START, b"nowhere"):
        assert sum(p(v, w) for w in single) + p(v, b"unknown word") == pytest.approx(1)
    assert katz.score(docs.limit(0)).count() == 0


def test_packing(docs, rows, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SHARD", 25)
    path = tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    found = packing.pack(docs, path).collect()
    expected = Counter()
    for i, t, _ in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            own = ids[k:k + 4096]
            expected[i, k // 4096, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    bins = {}
    for r in sorted(found, key=lambda r: r["offset"]):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 4096 and len(bins) <= -(-sum(r["length"] for r in found) // 4096) + 2
    assert packing.pack(docs.limit(0), path).count() == 0


def test_line_sketches():
    """Sketches never rule out a pair that is alike, and rule out most of the others."""
    rng = random.Random(1)
    lines = []
    for _ in range(50):
        line = "".join(rng.choices("abcdef ", k=rng.randint(5, 200)))
        lines.append(line)
        for _ in range(5):
            at = rng.sample(range(len(line)), rng.randint(1, 3))
            lines.append("".join("é" if k in at else c for k, c in enumerate(line)))
    bits = line_dedup.sketches(lines).view(np.uint64)
    sets = [line_dedup.shingles(x) for x in lines]
    out = unlike = 0
    for i in range(len(lines)):
        for j in range(i):
            differ = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            gone = line_dedup.ruled_out(differ, len(lines[i]) + len(lines[j]))
            assert differ <= len(sets[i] ^ sets[j])
            like = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            assert not (like and gone)
            out, unlike = out + bool(gone), unlike + (not like)
    assert out > 0.9 * unlike


def test_line_pairs(monkeypatch):
    """Lines that share a key meet by their facts alone: no pair that is alike is lost, few others are left, copies in several parts count once."""
    rng = random.Random(4)
    lines = ["ab" * 60, "ab" * 61, "a" * 70_000, "a" * 90_000, "abcde" * 30]
    for _ in range(40):
        line = "".join(rng.choices("abcdef ", k=rng.randint(5, 300)))
        lines += [line, *("".join("é" if k in rng.sample(range(len(line)), 2) else c for k, c in enumerate(line)) for _ in range(2))]
    lines = list(dict.fromkeys(lines))
    sets = [line_dedup.shingles(x) for x in lines]
    like = {(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    monkeypatch.setattr(line_dedup, "band_keys", lambda x, short=None: np.full((len(x), line_dedup.BANDS), 7, np.uint64))

    def given(number):
        part = line_dedup.Part(number, 1)
        for k, x in enumerate(lines):
            part.add(k.to_bytes(16, "little"), x)
        rows = [r for batch in part.rows() for r in batch.to_pylist()]
        shared = line_dedup._shared(pa.Table.from_pylist([r for r in rows if r["kind"] == line_dedup.KEYS], line_dedup.SCHEMA)).to_pylist()
        return [r for batch in line_dedup._given([*rows, *shared]) for r in batch.to_pylist()]

    table = pa.Table.from_pylist([*given(0), *given(1 << 16)], line_dedup.SCHEMA)
    for few in (1000, 0):
        monkeypatch.setattr(line_dedup, "PAIRS_A_LINE", few)
        found = line_dedup._met(table).to_pylist()
        pairs = {(r["a"], r["b"]) for r in found if not r["many"]}
        members = [(r["a"], r["b"]) for r in found if r["many"]]
        if few:
            assert like <= pairs and not members and len(pairs) < len(like) + 0.05 * len(lines) ** 2 / 2
        else:  # all lines, with one pivot that is compared with all that may be like it
            pivot = members[0][1]
            assert sorted(members) == [(k, pivot) for k in range(len(lines))]
            assert {x for x in like if pivot in x} <= pairs and all(pivot in x for x in pairs)


def test_packing_evolves():
    """Where best fit is not enough: triplets that fill 300 bins, and lengths for which four or fewer share a bin."""
    rng = random.Random(1)
    triplets = []
    while len(triplets) < 900:
        a = rng.randrange(1100, 2000)
        b = rng.randrange(900, (4096 - a) * 2 // 3)
        if 4096 - a - b > 600:
            triplets += [a, b, 4096 - a - b]
    for lengths, most in ((np.array(triplets), 305), (np.array([rng.randrange(800, 1700) for _ in range(900)]), None)):
        least = packing.least_bins(lengths)
        best_fit = packing.fill(lengths, np.full(900, -1), np.argsort(-lengths, kind="stable"))
        bins = [packing.evolve(lengths, [], seed) for seed in (1, 2)]
        again = packing.evolve(lengths, bins, 3)
        for x in (*bins, again):
            assert np.bincount(x, lengths).max() <= 4096 and set(x) == set(range(x.max() + 1))
        assert least <= again.max() + 1 <= min(x.max() + 1 for x in bins) <= best_fit.max() + 1 - 10
        assert again.max() + 1 <= (most or least + 2)
    full = np.array([4096] * 5 + [2048] * 6)
    assert packing.evolve(full, [], 1).max() + 1 == 8
    assert packing.least_bins(np.array([2100] * 7)) == 7


def test_language_id_sends_texts_only(docs, rows):
    """Nothing but texts crosses to Python, as Python strings a few at a time, and rows come out whole."""
    plan = language_id.filter_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    kept = language_id.filter_documents(docs, 0.0).collect()
    assert Counter(tuple(r)[:3] for r in kept) == Counter(r for r in rows if any(c.isalpha() for c in r[1] or ""))


def test_worker_keeps_one(monkeypatch):
    """What another operator left goes before the next one's is made."""
    monkeypatch.setattr(common, "_kept", {})
    alive = []
    first = common.keep(("a", 1), lambda: {1, 2})
    assert common.keep(("a", 1), lambda: {3}) is first
    gone = weakref.ref(common.keep(("b", 1), type("Model", (), {})))
    del first
    common.keep(("c", 1), lambda: alive.append(gone() is None) or 5)
    assert alive == [True] and list(common._kept) == [("c", 1)]
    assert packing.encoder(tokenizer_path("word_bpe_49k.json")) is packing.encoder(tokenizer_path("word_bpe_49k.json"))
    assert [k[0] for k in common._kept] == ["packing"]


def test_packing_encoder(monkeypatch):
    """Plain units get the library's ids without its normalizer, one word once for all its cases and ends; the rest takes the library's way."""
    path, asked, library_units = tokenizer_path("word_bpe_49k.json"), [], units.encode_units
    monkeypatch.setattr(packing, "encode_units", lambda t, some, mark: asked.extend(some) or library_units(t, some, mark))
    e, library = packing.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(4)
    pieces = [*packing.LETTERS, *packing.PUNCTUATION, "'s", "'LL", "İ", "́", "ª", "µ", "ß", "Σ", "漢", "😀", "7", "٣", " ", "\t", "\r\n", "\x85", "<|endoftext|>",
              "<|startoftext|>", "the", "River", "STRASSE", "Ĳ", "ŉ", "ſ", "Ÿ"]
    texts = ["".join(rng.choices([*pieces, " ", "\n"], [1] * len(pieces) + [80, 20], k=rng.randint(0, 60))) for _ in range(1500)]
    texts += [f"{a}{b}" for a in ("House", "ÉCOLE", "don't", "s") for b in ("", "'", ".'s", "$$$", "?!", "'S", "-a", "...")] + [f"a{c}b {c} {c}." for c in map(chr, range(0x250))]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    asked.clear()
    e.encode("Garden garden, GARDEN. gârden! Gârden $$$")
    assert set(asked) <= {"", ",", ".", "!", "$$$"} and "garden" in e.words and "Garden" not in e.words
