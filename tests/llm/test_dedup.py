"""Operators 1, 2 and 3 against brute force, with nulls, empty and long texts, repeats, clashing columns and empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from paperloom.llm import chunks, jaccard, suffix

COLUMNS = "doc_id long, text string, lang string, kept string, k1 string, spans string"


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "clash", "clash", "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def corpus(seed=1, n=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgéß") for _ in range(r.randint(1, 9))) for _ in range(300)]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passages = [sentence(k) for k in (18, 25, 40, 60)]
    texts = [None, "", " \n\t", "one", "one two", "One  two", "x" * 700, "ab" * 400, sentence(4000)]
    for _ in range(n):
        parts = [sentence(r.randint(3, 80))] + [r.choice(passages) for _ in range(r.randint(0, 2))] + [sentence(r.randint(0, 40))]
        r.shuffle(parts)
        texts.append(" ".join(parts))
    for t in texts[9:25]:
        w = t.split(" ")
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    texts += texts[9:14] + [texts[10].upper()]
    return texts


def brute_spans(texts, length):
    first, out = {}, {}
    for d, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in first:
                gone[i : i + length] = b"\1" * length
            else:
                first[s] = (d, i)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("how", [{}, {"hot_group": 2, "block": 1000}], ids=["whole", "hot groups"])
def test_suffix_dedup_is_brute_force(spark, how):
    texts = corpus()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.dedup(frame(spark, texts), **how).collect()}
    assert got == brute_spans(texts, 100)


def test_bytes_and_not_hashes_decide(spark, monkeypatch):
    """With hashes that hardly tell anything apart, texts meet that differ, and the result is the same."""
    real = suffix.stretches

    def coarse(*args):
        k1, k2, a, n = real(*args)
        return k1 & np.uint64(3), k2 & np.uint64(1), a, n

    monkeypatch.setattr(suffix, "stretches", coarse)
    texts = corpus(4, 15)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.dedup(frame(spark, texts), hot_group=10_000, block=4000).collect()}
    assert got == brute_spans(texts, 100)


def test_texts_beyond_a_slab(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SLAB", 1 << 12)
    suffix.powers.cache_clear()
    texts = [t for t in corpus(5, 10)] + ["".join(random.Random(2).choice("abc d") for _ in range(9000))] * 2
    rows = []
    for text, ends, ids, offsets in suffix.slabs(list(range(len(texts))), [(t or "").encode() for t in texts], 100):
        k1, k2, a, n = suffix.stretches(text, ends)
        which = np.searchsorted(ends, a, side="right")
        rows += [(int(ids[w]), int(x - (ends[w - 1] if w else 0) + offsets[w]), int(c)) for w, x, c in zip(which, a, n, strict=True)]
    windows = sorted((d, p) for d, at, n in rows for p in range(at, at + n))
    assert windows == [(d, p) for d, t in enumerate(texts) for p in range(max(0, len((t or "").encode()) - 99))]
    suffix.powers.cache_clear()


def test_suffix_array_and_common_prefixes():
    r = random.Random(1)
    for alphabet in (b"ab", b"abcd", bytes(range(1, 256))):  # behind the end zero bytes count
        for _ in range(60):
            text = bytes(r.choice(alphabet) for _ in range(r.randint(1, 300)))
            order, w = suffix.suffix_array(np.frombuffer(text, np.uint8))
            cut = [text[i : i + 100] for i in order]
            assert sorted(order.tolist()) == list(range(len(text))) and cut == sorted(cut)
            common = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))  # noqa: E731, B905
            assert suffix.common_prefixes(order, w).tolist() == [common(x, y) for x, y in zip(cut, cut[1:])]  # noqa: B905


@pytest.mark.parametrize("run", [1, 100])
def test_chunks_cover_texts_and_only_repeats_go(spark, run):
    texts = corpus(3)
    first, expected = set(), {}
    for d, t in enumerate(texts):
        b, a, gone = (t or "").encode(), 0, bytearray(len((t or "").encode()))
        ends = chunks.cuts(np.frombuffer(b, np.uint8)) if b else []
        assert (ends[-1] if ends else 0) == len(b) and ends == sorted(set(ends))
        for e in ends:
            if b[a:e] in first:
                gone[a:e] = b"\1" * (e - a)
            first.add(b[a:e])
            a = e
        for m in list(re.finditer(b"\1+", bytes(gone))):
            if len(m[0]) < min(run, len(b)):
                gone[m.start() : m.end()] = b"\0" * len(m[0])
        expected[d] = (len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    assert {r["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in chunks.dedup(frame(spark, texts), run=run).collect()} == expected


def test_short_repeats_go_by_default(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    line = "Sign up for our letter, read it on Sundays and share it with your friends and your neighbours"  # two cuts fall in it
    texts = [" ".join(word() for _ in range(30)) + f"\n{line}\n" + " ".join(word() for _ in range(30)) for _ in range(20)]
    first, kept, short = set(), {}, 0
    for d, t in enumerate(texts):
        b, a, kept[d] = t.encode(), 0, b""
        for e in chunks.cuts(np.frombuffer(b, np.uint8)):
            kept[d] += b"" if b[a:e] in first else b[a:e]
            first.add(b[a:e])
            a = e
        short += 0 < len(b) - len(kept[d]) < 100
    assert short > 10
    assert {x["doc_id"]: bytes(x["kept"]) for x in chunks.dedup(frame(spark, texts)).collect()} == kept


def test_chunks_resist_insertions():
    r = random.Random(4)
    text = bytes(r.choice(b"abcdefgh ") for _ in range(20_000))

    def parts(b):
        ends = chunks.cuts(np.frombuffer(b, np.uint8))
        return {b[a:e] for a, e in zip([0, *ends[:-1]], ends, strict=True)}

    a, b = parts(text), parts(text[:9000] + b"!" + text[9000:])
    assert len(a - b) <= 6


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    own = list(range(len(texts)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                own[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("tile", [512, 3])
def test_jaccard_join_is_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "CHUNK", 2 * tile)
    r = random.Random(9)
    texts = corpus(7, 30) + ["a b c d", "a b c d e", "a b c d e f g h i j k", "a b c d e f g h i j"]
    base = [f"w{k}" for k in range(120)]
    for _ in range(40):  # a chain of near copies, not all of which are similar to each other
        base[r.randrange(len(base))] = f"n{r.random()}"
        texts.append(" ".join(base))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.join(frame(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_links_are_brute_force(spark):
    r = random.Random(10)
    texts = corpus(8, 20)
    base = [f"w{k}" for k in range(90)]
    for _ in range(25):
        base[r.randrange(len(base))] = f"n{r.random()}"
        texts.append(" ".join(base))
    links, classes = jaccard.similar_pairs(frame(spark, texts))
    of = {x["doc_id"]: x["class_id"] for x in classes.collect()}
    sets = [shingles(t) for t in texts]
    assert of == {i: min(j for j, t in enumerate(sets) if t == s and (s or i == j)) for i, s in enumerate(sets)}
    heads = sorted(set(of.values()))
    want = {(a, b) for a in heads for b in heads if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {(min(x), max(x)) for x in links.collect()} == want and len(want) > 20


def test_similar_sizes_share_a_tile(spark):
    n = [*range(1, 4000), 12_345, 99_999, 1_000_000]
    members = spark.createDataFrame([(1, i, x, 0) for i, m in enumerate(n) for x in (m,)], "token long, doc_id long, n long, pos int")
    band = {(x["n"], x["upper"]): x["band"] for x in jaccard.banded(members, 80).collect()}
    for small in n[:3000]:
        for large in {small, small * 5 // 4}:
            assert band[small, 0] in (band[large, 0], band[large, 1])


@pytest.mark.parametrize("op", [suffix.dedup, chunks.dedup, jaccard.join], ids=["suffix", "chunks", "jaccard"])
def test_empty_table_null_and_repeated_ids(spark, op):
    assert op(frame(spark, [])).collect() == []
    assert op(frame(spark, [None, ""])).count() == 2
    got = op(frame(spark, ["b " * 80, "a " * 80, "c", None], [1, 1, None, 2])).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2]
