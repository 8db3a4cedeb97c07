"""Operators 4 to 10 against brute force, round trips or held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from paperloom.llm import decontaminate, licenses, packing, quality, sharding, tokens, topk

P = pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, shard string, bin string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", "clash", "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)], COLUMNS).repartition(3)


def prose(seed, n, words=120):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgéÀ") for _ in range(r.randint(1, 9))) + r.choice(["", "", ",", ".", "!!"]) for _ in range(800)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, words))) for _ in range(n)]


ODD = [None, "", " ", "\n\n", "it's they've O'Neil's 'S x_y__z 12345 ²³½ café İstanbul ΣΑΣ", "a b\x1c\x1dc", "<|endoftext|> foo<|startoftext|>bar", "日本語 テキスト", "a" * 3000, "Ǆ ﬁ ñ×÷ 🙂👍🏽", "é ́"]


# ---------------------------------------------------------------- 4


def brute_licenses(text, dice=licenses.DICE):
    words, out = licenses.normal_words(text or ""), []
    probes = defaultdict(list)
    for name, _, _, gram, place in licenses.index(licenses.TEMPLATES, dice):
        probes[name].append((gram, place))
    for name, template in licenses.TEMPLATES.items():
        t = licenses.normal_words(template)
        grams = set(zip(t, t[1:], strict=False))
        hits = {}
        for s in {p - q for g, q in probes[name] for p in range(len(words) - 1) if f"{words[p]} {words[p + 1]}" == g}:
            a, b = max(0, s), min(len(words), s + len(t))
            own = set(zip(words[a:b], words[a + 1 : b], strict=False))
            d = 2 * len(own & grams) / (len(own) + len(grams))
            if d >= dice:
                hits[a] = max(hits.get(a, (0,)), (d, b - a))
        for a, (d, n) in hits.items():
            if not any(abs(x - a) < len(t) and (-y[0], x) < (-d, a) for x, y in hits.items()):
                out.append((name, a, n, round(d, 9)))
    return sorted(out)


def test_license_scan_is_brute_force(spark):
    r, texts = random.Random(2), [None, "", "mit", "license"]
    for t in licenses.TEMPLATES.values():
        w = t.split()
        texts += [t, t.upper(), f"some words here\n{t}\nand more words", " ".join(w[: len(w) // 2]), " ".join(w[2:]), " ".join([*w[:3], "oddly", *w[3:]]), f"{t} {t}"]
        for _ in range(3):
            x = w.copy()
            x[r.randrange(len(x))] = "changed"
            texts.append("before it " + " ".join(x) + " after it")
    got = defaultdict(list)
    for x in licenses.scan(frame(spark, texts)).collect():
        got[x["doc_id"]].append((x["license"], x["start_word"], x["n_words"], round(x["dice"], 9)))
    assert {k: sorted(v) for k, v in got.items()} == {i: h for i, t in enumerate(texts) if (h := brute_licenses(t))}


def brute_stretches(text, dice=licenses.DICE):
    """All stretches of all lengths, the best first (then the shortest, then the earliest); what overlaps a better one goes."""
    words, out = licenses.normal_words(text or ""), []
    for name, template in licenses.TEMPLATES.items():
        t = licenses.normal_words(template)
        grams, hits = set(zip(t, t[1:], strict=False)), []
        for a in range(len(words)):
            own = set()
            for b in range(a + 2, len(words) + 1):
                own.add((words[b - 2], words[b - 1]))
                if (d := 2 * len(own & grams) / (len(own) + len(grams))) >= dice:
                    hits.append((-d, b - a, a))
        kept = []
        for d, n, a in sorted(hits):
            if all(a >= y + m or y >= a + n for y, m in kept):
                kept.append((a, n))
                out.append((name, a, n, round(-d, 9)))
    return sorted(out)


def test_license_scan_of_every_length_is_brute_force(spark):
    gpl = "This work is licensed under the terms of the GNU General Public License, version 3"
    r, texts = random.Random(7), [None, "", "mit", "mit license " * 30, f"It says: {gpl}, as it stands.", f"{gpl}. {gpl}; some words. {licenses.TEMPLATES['GPL-3.0-line']}"]
    w = licenses.TEMPLATES["BSD-2-or-3-Clause"].split()
    texts.append("start " + " ".join([*w[:10], "which", "we", "did", "not", "want", "here", *w[10:]]) + " end")
    w = licenses.TEMPLATES["Apache-2.0-line"].split()
    texts.append(" ".join([*w[:3], *["foo"] * 200, *w[3:]]))
    for t in licenses.TEMPLATES.values():
        w = t.split()
        texts += [t, f"{t} {t}", f"{t} and {' '.join(w[1:])}", " ".join(w[: len(w) * 3 // 4])]
        for k in (1, 2, 5):
            x = w.copy()
            for _ in range(k):
                at = r.randrange(len(x))
                x[at : at + r.randint(0, 1)] = r.sample(["of", "the", "oddly", "license", "to"], r.randint(0, 2))
            texts.append("words before it " + " ".join(x) + " and after it " + " ".join(w[r.randint(0, 3) :]))
    got = defaultdict(list)
    for x in licenses.scan(frame(spark, texts), every_length=True).collect():
        got[x["doc_id"]].append((x["license"], x["start_word"], x["n_words"], round(x["dice"], 9)))
    want = {i: h for i, t in enumerate(texts) if (h := brute_stretches(t))}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert [x[0] for x in want[4]] == ["GPL-3.0-line"] and not brute_licenses(texts[4])
    assert [x[0] for x in want[6]] == ["BSD-2-or-3-Clause"] and not brute_licenses(texts[6])


# ---------------------------------------------------------------- 5


def test_ids_are_those_of_tokenizers():
    enc = packing.WordEncoder(P.path("word_bpe_49k.json"))
    r = random.Random(3)
    texts = [t or "" for t in ODD] + prose(4, 40) + ["".join(r.choice("aB'srevm d.,!_-1²×éİ ́\n\t<|>Σß") for _ in range(r.randint(1, 60))) for _ in range(200)]
    for t, ids in zip(texts, enc.encode_all(texts), strict=True):
        assert ids.tolist() == enc.whole.encode(t, add_special_tokens=False).ids, t


def test_packing_round_trip(spark):
    texts = ODD + prose(5, 300) + [" ".join(prose(6, 60))] * 3
    docs = frame(spark, texts)
    got = packing.pack(docs, P.path("word_bpe_49k.json"), window=256, step=8, ids=True).collect()
    enc = packing.WordEncoder(P.path("word_bpe_49k.json"))
    whole = {i: [*e.tolist(), 2] for i, e in enumerate(enc.encode_all([t or "" for t in texts]))}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for x in got:
        by_doc[x["doc_id"]].append(x)
        by_seq[x["sequence_id"]].append(x)
        assert x["doc_tokens"] == len(whole[x["doc_id"]]) and x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes())
    for i, ids in whole.items():
        parts = sorted(by_doc[i], key=lambda x: x["start"])
        assert [t for x in parts for t in x["ids"]] == ids and [x["start"] for x in parts] == list(np.cumsum([0, *[x["length"] for x in parts]])[:-1])
    for parts in by_seq.values():
        parts.sort(key=lambda x: x["offset"])
        assert [x["offset"] for x in parts] == list(np.cumsum([0, *[x["length"] for x in parts]])[:-1]) and sum(x["length"] for x in parts) <= 256
    assert sum(map(len, whole.values())) / (256 * len(by_seq)) > 0.93
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_solver_places_most_pieces():
    r = np.random.default_rng(4)
    lengths = np.minimum(255, np.maximum(1, r.lognormal(3, 1, 20_000).astype(int)))
    histogram = np.bincount(lengths - 1, minlength=256)
    left = histogram.copy()
    packing.solved(left)
    assert (left >= 0).all() and left.sum() < 0.05 * histogram.sum()
    assert sum(n for _, n in packing.plan(histogram)) * 256 < 1.02 * (histogram * np.arange(1, 257)).sum()


def test_short_pieces_are_bundled(spark):
    docs = frame(spark, [""] * 3000 + ["a"] * 1000 + ["b c"] * 500)
    got = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    assert len(got) == 4500 and len({x["sequence_id"] for x in got}) == 2
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).collect() == []


def test_plan_uses_every_piece_once():
    r = np.random.default_rng(1)
    for _ in range(5):
        histogram = r.integers(0, 50, 32) * (r.random(32) < 0.7)
        used = np.zeros(32, np.int64)
        for fill, n in packing.plan(histogram):
            assert sum(fill) <= 32 and n > 0
            for b in fill:
                used[b - 1] += n
        assert (used == histogram).all()


# ---------------------------------------------------------------- 6


def test_leaks_are_found_and_scores_are_bm25(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "WORDS", 500)
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    items = [" ".join(s.capitalize() for s in prose(k, 1, 60)) + ". " + " ".join(prose(100 + k, 1, 12)) + "." for k in range(30)]
    texts = prose(8, 60, 400) + [None, ""]
    planted = {i: (i * 7) % 30 for i in range(0, 60, 4)}
    for d, i in planted.items():
        texts[d] += " " + items[i] + " " + prose(900 + d, 1, 300)[0]
    bench = spark.createDataFrame([*enumerate(items), (99, None), (None, "x y"), (98, " ...")], "item_id long, text string")
    got = decontaminate.find_leaks(frame(spark, texts), bench).collect()
    def overlap(part, words):
        """Part of a list's five-word runs, or of its whole if shorter, that the words hold."""
        size = min(5, len(part))
        runs = lambda w: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        return len(runs(part) & runs(words)) / len(runs(part)) if part else 1.0

    wordy = {i: decontaminate.split_words(t) for i, t in enumerate(items)}
    half = max(32, *map(len, wordy.values()))
    frequency = Counter(w for v in wordy.values() for w in set(v))
    mean = sum(map(len, wordy.values())) / len(wordy)

    def score(i, held):
        weight = {w: math.log(1 + (30 - frequency[w] + 0.5) / (frequency[w] + 0.5)) * wordy[i].count(w) * 2.2 / (wordy[i].count(w) + 1.2 * (0.25 + 0.75 * len(wordy[i]) / mean)) for w in set(wordy[i])}
        return sum(x for w, x in weight.items() if w in held) / sum(weight.values())

    want = {}
    for d, t in enumerate(texts):
        words = decontaminate.split_words(t or "")
        for a in range(0, max(1, len(words) - half), half):
            passage = words[a : a + 2 * half]
            for i in range(30):
                if words and score(i, set(passage)) >= 0.6:
                    sentences = [w for x in re.split(r"(?<=[.!?])\s+", items[i].strip()) if (w := decontaminate.split_words(x))]
                    q, r = overlap([w for x in sentences[:-1] for w in x], passage), overlap(sentences[-1], passage)
                    want[d, i] = want.get((d, i), False) or (q >= 0.8 and r >= 0.8)
    assert {(x["doc_id"], x["item_id"]): x["leak"] for x in got} == want
    assert {d for (d, _), leak in want.items() if leak} >= planted.keys() and not all(want.values())
    parts = decontaminate.find_leaks(frame(spark, texts), bench, items=7).collect()
    assert sorted((x["doc_id"], x["item_id"], round(x["score"], 9), x["leak"]) for x in parts) == sorted((x["doc_id"], x["item_id"], round(x["score"], 9), x["leak"]) for x in got)
    index = decontaminate.Index(list(range(30)), items)
    lists = [decontaminate.split_words(x) for x in texts if x][:25]
    for threshold in (0.2, 0.6):
        scored = {(k, a, i): score(i, set(w[a : a + 2 * half])) for k, w in enumerate(lists) for a in range(0, max(1, len(w) - half), half) for i in range(30)}
        found = {(k, a, index.ids[i]): x for k, a, i, x in index.search(lists, threshold)}
        assert found.keys() == {k for k, x in scored.items() if x >= threshold} and all(abs(x - scored[k]) < 1e-9 for k, x in found.items())


def test_blocks_are_skipped():
    items = [f"alpha beta gamma delta number{k} mark{k} sign{k}" for k in range(64)]
    index = decontaminate.Index(list(range(64)), items)
    seen = []
    index.scores = lambda b, terms, f=index.scores: seen.append(b) or f(b, terms)
    words = "alpha beta gamma delta number9 mark9 sign9 and more".split()
    assert [x[2] for x in index.search([[w.encode() for w in words]], 0.9)] == [index.ids.index(9)]
    assert seen == [index.ids.index(9) // index.block]


def test_empty_benchmark_and_odd_rows(spark):
    docs = frame(spark, ["a b c d e f", None, "a b c d e f"], [1, None, 1])
    bench = spark.createDataFrame([(1, "a b c d e f"), (1, "x y"), (None, "z"), (2, None)], "item_id long, text string")
    assert decontaminate.find_leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.find_leaks(docs.limit(0), bench).collect() == []
    got = decontaminate.find_leaks(docs, bench).collect()
    assert [(x["doc_id"], x["item_id"], x["leak"]) for x in got] == [(1, 1, True)] * 2


# ---------------------------------------------------------------- 7


def test_top_k_is_brute_force(spark, monkeypatch):
    r = np.random.default_rng(5)
    v = [[float(x) for x in row] for row in r.normal(size=(300, 12))]
    rows = [(i, x) for i, x in enumerate(v)] + [(1000 + i, x) for i, x in enumerate(v[:20])] + [(2000 + i, v[7]) for i in range(30)]
    bad = [(5000, None), (5001, [1.0, None] + [0.0] * 10), (5002, [float("nan")] * 12), (5003, [float("inf")] * 12), (5004, []), (None, v[0]), (5050, [0.0] * 12), (5100, [1.0, 2.0])]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows + bad], "vec_id long, embedding array<double>, rank int")
    got = topk.exact_top(df.where("vec_id % 50 = 0"), df, block=100, query_block=4).collect()
    ok = {i: np.floor(np.array(x) * 256).astype(np.int64) for i, x in rows + [bad[6]]}
    expected = set()
    for q in [i for i in ok if i % 50 == 0]:
        best = sorted(((-int(ok[q] @ x), i) for i, x in ok.items() if i != q))[:5]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(x) for x in got if x["query_id"] != 5100} == expected
    assert not [x for x in got if x["query_id"] == 5100]
    assert topk.exact_top(df.limit(0), df).collect() == []


@pytest.mark.parametrize("largest", [3, 200, 10**6, 10**9])
def test_top_k_over_cells(spark, largest):
    """Several parts, groups and blocks, two lengths, many ties, sums beyond what floating point holds; no row of the plan gathers others, and nothing is broadcast."""
    r = np.random.default_rng(largest)
    v = {i: r.integers(-largest, largest + 1, 3 if i % 7 else 2) for i in range(700)} | {i: np.full(3, largest) for i in range(700, 800)}
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in v.items()], "vec_id long, embedding array<double>").repartition(3)
    out = topk.exact_top(df.where("vec_id % 50 = 0"), df, scale=1, block=40, query_block=5)
    expected = set()
    for q in range(0, 800, 50):
        best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:5]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(x) for x in out.collect()} == expected
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Join" not in plan


def test_top_k_stops_at_the_threshold(monkeypatch):
    r = np.random.default_rng(6)
    v = r.integers(-3, 4, (4000, 8))
    v[1000:1040] = r.integers(60, 90, (40, 8))
    best, scored = topk.Best(np.array([-1, 1005]), v[[1001, 1005]], 5), []
    full = topk.Lists.score
    monkeypatch.setattr(topk.Lists, "score", staticmethod(lambda b, part, queries, ids, vectors: (scored.append(len(ids)), full(b, part, queries, ids, vectors))))
    topk.Lists(np.arange(4000), v).search(best)
    topk.Lists(np.arange(4000, 4000 + 900), v[:900]).search(best)
    assert sum(scored) < 1500  # the second block's largest sum is below the fifth best, so nothing of it is scored
    for own, q, ids, scores in zip((-1, 1005), v[[1001, 1005]], best.ids, best.scores, strict=True):
        assert [*zip(scores.tolist(), ids.tolist(), strict=True)] == [(-s, i) for s, i in sorted((-int(q @ x), i) for i, x in enumerate(v) if i != own)[:5]]


# ---------------------------------------------------------------- 8


@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_counts_by_section(spark, rule):
    import tiktoken

    enc, _ = tokens.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    texts = [*ODD, "one line\n\n\n\ntwo  \n three\n", "🙂\n👍🏽x\n"] + ["\n".join(prose(k, 4, 20)) for k in range(20)]
    got = defaultdict(dict)
    for x in tokens.count_by_section(frame(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, rule=rule).collect():
        got[x["doc_id"]][x["section"]] = x
    for i, t in enumerate(texts):
        t = t or ""
        parts = [got[i][k] for k in range(len(got[i]))]
        assert "".join(t[x["start"] : x["stop"]] for x in parts) == t and all("\n" not in t[x["start"] : x["stop"] - 1] for x in parts)
        ids, at, count = enc.encode_ordinary(t), 0, Counter()
        owner = [k for k, x in enumerate(parts) for _ in t[x["start"] : x["stop"]].encode()]
        chars = [c for c, ch in enumerate(t) for _ in ch.encode()]
        for token in ids:
            n = len(enc.decode_single_token_bytes(token))
            if rule == "most":
                held = Counter(owner[b] for b in {chars[b]: b for b in range(at, at + n)}.values())
                count[max(held, key=lambda k: (held[k], -k))] += 1
            else:
                count[owner[at if rule == "first" else at + n - 1]] += 1
            at += n
        assert [x["n_tokens"] for x in parts] == [count[k] for k in range(len(parts))]
        assert all(x["doc_tokens"] == len(ids) for x in parts)


# ---------------------------------------------------------------- 9


def test_shards_hold_all_rows_in_a_seeded_order(spark):
    texts = prose(11, 500, 30) + ["same"] * 300 + [None, ""]
    docs = frame(spark, texts, list(range(700)) + [5] * 100 + [None, 900])
    out = sharding.shuffle_into_shards(docs, bucket_bytes=4096).collect()
    assert Counter((x["doc_id"], x["text"]) for x in out) == Counter((x["doc_id"], x["text"]) for x in docs.collect())
    slots = defaultdict(list)
    for x in out:
        slots[x["shard"]].append(x["slot"])
    assert len(slots) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    place = {x["position"]: x["doc_id"] or 0 for x in out if x["doc_id"] != 5}
    assert abs(np.corrcoef(list(place), list(place.values()))[0, 1]) < 0.15
    again = sharding.shuffle_into_shards(docs.repartition(3), bucket_bytes=4096).collect()
    assert sorted((x["position"], x["doc_id"] or -1, x["text"] or "") for x in out) == sorted((x["position"], x["doc_id"] or -1, x["text"] or "") for x in again)
    assert sharding.shuffle_into_shards(docs.limit(0)).collect() == []


# ---------------------------------------------------------------- 10


def test_quality_on_held_out_documents(spark):
    r = random.Random(6)
    texts, marks = prose(12, 900, 150), []
    for i, t in enumerate(texts):
        low, toxic = r.random() < 0.1, r.random() < 0.1
        w = t.split()
        if toxic:
            for _ in range(2 + len(w) // 12):
                w.insert(r.randrange(len(w) + 1), r.choice(["vile", "rotten", "filth"]))
        if low:
            w = [x + "***" if k % 2 else x.upper() + "!!" for k, x in enumerate(w)]
        texts[i] = " ".join(w)
        marks.append((i, 0 if low and len(w) > 8 else 1, int(toxic)))
    labels = spark.createDataFrame([m for m in marks if m[0] % 3] + [(5000, 1, 1), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [*texts, None, ""])
    got = {x["doc_id"]: x["keep"] for x in quality.classify(docs, labels).collect()}
    assert sorted(got) == list(range(902)) and got[900] and got[901]
    held_out = [(not got[i], q == 0 or t == 1) for i, q, t in marks if i % 3 == 0]
    right = np.mean([a == b for a, b in held_out])
    recall = np.mean([a for a, b in held_out if b])
    assert right > 0.95 and recall > 0.9
    assert all(x["keep"] for x in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).collect() == []


def test_host_and_path_posteriors_are_brute_force(spark):
    r = random.Random(8)
    texts = prose(13, 400, 60)
    rows = [(i, t + " vile rotten filth vile" * (r.random() < 0.15 + 0.5 * (i % 4 == 1)), None if i % 50 == 7 else f"h{i % 4}", None if i % 31 == 0 else f"p{i % 3}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1, int("vile rotten filth" in t)) for i, t, _, _ in rows if i % 2], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.classify(docs, labels).collect()}
    p = {i: 1 - (1 - x["p_low"]) * (1 - x["p_toxic"]) for i, x in got.items()}
    paths, hosts = defaultdict(list), defaultdict(list)
    for i, _, h, q in rows:
        paths[h, q].append(p[i])
        hosts[h].append(p[i])
    rate = sum(p.values()) / len(p)

    def weight(sites, around):
        over = sum(len(x) * (np.mean(x) - around(k)) ** 2 for k, x in sites.items()) - rate * (1 - rate) * len(sites)
        return min(10_000, max(10, rate * (1 - rate) * len(p) / over - 1)) if over > 0 else 10_000

    k_host = weight(hosts, lambda h: rate)
    host_rate = {h: (sum(x) + k_host * rate) / (len(x) + k_host) for h, x in hosts.items()}
    k_path = weight(paths, lambda k: host_rate[k[0]])
    logit = lambda x: math.log(x / (1 - x))
    for i, _, h, q in rows:
        own = min(1 - 1e-4, max(1e-4, (sum(paths[h, q]) - p[i] + k_path * host_rate[h]) / (len(paths[h, q]) - 1 + k_path)))
        assert abs(got[i]["host_rate"] - host_rate[h]) < 1e-9 and abs(got[i]["path_rate"] - own) < 1e-9
        moved = max(1 / (1 + math.exp(-(logit(min(1 - 1e-13, max(1e-13, got[i][c]))) + logit(own) - logit(rate)))) for c in ("p_low", "p_toxic"))
        assert abs(got[i]["p_fault"] - moved) < 1e-6 and got[i]["keep"] == (got[i]["p_fault"] < 0.5)
    assert len({round(x, 6) for x in host_rate.values()}) > 2


def test_words():
    assert decontaminate.split_words("A1_b «Été» x—y\xa0z") == [b"a1", b"b", "été".encode(), b"x", b"y", b"z"]
