"""Operators 4 to 10 and the pipeline's stages on odd rows: nulls in any column, repeated ids and rows, empty and very long texts, bytes that are not UTF-8, clashing columns, empty tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from paperloom.llm import chunks, decontaminate, licenses, packing, quality, registry, sharding, tokens, topk

P = pytest.importorskip("public_tokenizers")
CLASH = ["words", "license", "bigram", "kind", "bin", "salt", "unit", "rest", "spans", "was_null", "h", "hp", "n", "bad", "copy", "bucket", "held", "doc_tokens", "item_id", "score"]
LINE = "This work is licensed under the GNU General Public License, version 3."
ITEM = "Which stone comes first when all are sorted by weight and colour alone? It is the heavy red stone number nine of all."


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(2)
    long = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(400_000))
    texts = [(1, None), (2, ""), (3, " \n\t"), (None, "no id"), (4, "same row"), (4, "same row"), (5, "b of two"), (5, "a of two"), (5, None), (6, f"{long} {LINE} {long[:1000]} {ITEM} {long[:500]}"), (7, "x" * 300_000)]
    df = spark.createDataFrame([(i, bytearray(t.encode()) if t is not None else None) for i, t in [*texts, (None, None)]] + [(8, bytearray(b"caf\xe9 \xff\xfe \xc3\x28 end"))], "doc_id long, raw binary")
    df = df.selectExpr("doc_id", "cast(raw as string) as text", "cast(null as string) as source", "if(doc_id % 2 = 0, null, 'en') as lang", "cast(null as long) as n_chars", *(f"'clash' as {c}" for c in CLASH))
    return df.repartition(3).cache()


IDS = [1, 2, 3, 4, 5, 6, 7, 8]


def test_licenses(spark, odd):
    for how in (True, False):
        assert [(x["doc_id"], x["license"]) for x in licenses.scan(odd, every_length=how).collect()] == [(6, "GPL-3.0-line")]
    assert licenses.scan(odd.limit(0), every_length=True).collect() == []
    twice = spark.createDataFrame([(1, LINE), (1, "a " + LINE), (2, None)], "doc_id long, text string")
    assert [(x["doc_id"], x["start_word"]) for x in licenses.scan(twice, every_length=True).collect()] == [(1, 0)]


def test_packing(spark, odd):
    got = packing.pack(odd, P.path("word_bpe_49k.json"), ids=True).collect()
    assert Counter(x["doc_id"] for x in got if x["start"] == 0) == Counter(x["doc_id"] for x in odd.select("doc_id").collect())
    assert [x["ids"] for x in got if x["doc_id"] in (1, 2, 3)] == [[2]] * 3
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(b"caf\xe9 \xff\xfe \xc3\x28 end".decode("utf-8", "replace"), add_special_tokens=False).ids
    assert [x["ids"] for x in got if x["doc_id"] == 8] == [[*want, 2]]
    assert sum(x["length"] for x in got if x["doc_id"] == 6) == next(x["doc_tokens"] for x in got if x["doc_id"] == 6) > 400_000


def test_leaks(spark, odd):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (2, ""), (None, "x"), (3, " ".join(f"w{k}" for k in range(5000)))], "item_id long, text string")
    got = decontaminate.find_leaks(odd, bench).where("leak").collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(6, 1)}


def test_tokens(spark, odd):
    got = tokens.count_by_section(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert Counter(x["doc_id"] for x in got if x["section"] == 0) == Counter(x["doc_id"] for x in odd.select("doc_id").collect())
    assert next(x["doc_tokens"] for x in got if x["doc_id"] == 8) > 4
    assert tokens.count_by_section(odd.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


def test_shards(spark, odd):
    got = sharding.shuffle_into_shards(odd).collect()
    assert Counter((x["doc_id"], x["text"]) for x in got) == Counter((x["doc_id"], x["text"]) for x in odd.select("doc_id", "text").collect())
    assert sorted((x["shard"], x["slot"]) for x in got) == [(k, 0) for k in range(13)]


def test_shard_query(spark, tmp_path):
    rows = [(k, "é" * k, "en", "s", k) for k in range(200)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in registry.op9_sharding(spark, str(tmp_path)).collect()}
    assert all((got[i]["size"], got[i]["text_crc32"]) == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = Counter(x["shard"] for x in got.values())
    assert sorted(slots) == list(range(24)) and max(slots.values()) - min(slots.values()) <= 1 and {(x["shard"], x["slot"]) for x in got.values()} == {(s, k) for s, n in slots.items() for k in range(n)}


def test_quality(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, None, None), (None, 0, 1), (99, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels).collect()
    assert sorted(x["doc_id"] for x in got) == IDS and all(0 <= x["p_fault"] <= 1 and x["host_rate"] > 0 for x in got)
    assert {x["doc_id"]: x["keep"] for x in quality.classify(odd, labels.limit(0)).collect()} == dict.fromkeys(IDS, True)


def test_long_words_are_told_apart():
    a, b = (quality.words_of(b"x" * 70 + c)[0] for c in (b"a", b"b"))
    assert a != b and len(a) < 70 and quality.words_of(b"Ab cd") == [b"ab", b"cd"]


def test_top_k(spark):
    v = spark.createDataFrame([(50, [1.0, 2.0]), (50, [1.0, 3.0]), (1, [1.0, 1.0]), (2, None), (None, [5.0, 5.0])], "vec_id long, embedding array<double>").selectExpr("*", "0 as score", "0 as rank", "0 as id", "0 as v")
    got = topk.exact_top(v.where("vec_id % 50 = 0"), v).collect()
    assert [tuple(x) for x in got] == [(50, 1, 1, 256 * 256 + 512 * 256)]


def test_gear_hash_and_cuts_are_as_stated():
    r = random.Random(3)
    for n in (0, 1, 40, 5000):
        text = np.array([r.choice(b"abcdefgh \n") for _ in range(n)], np.uint8)
        h, last, want, hashes = 0, 0, [], []
        for k, b in enumerate(text.tolist(), 1):
            h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
            hashes.append(h)
            if k - last == chunks.MOST or k - last >= chunks.LEAST and h >> (32 - chunks.BITS) == 0:
                want.append(k)
                last = k
        assert chunks.rolling(text).tolist() == hashes and chunks.cuts(text) == want + [n] * (last < n)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages(spark, odd, tables, name, stage):
    got = {x["doc_id"]: x for x in stage(spark, odd, tables).collect()}
    gone = {"decontamination": {6}}.get(name, set())
    assert sorted(got) == [i for i in IDS if i not in gone]
    assert got[1]["text"] is None and got[5]["text"] == "a of two" and got[4]["text"] == "same row" and list(got[4].asDict()) == corpus_pipeline.COLUMNS
    assert stage(spark, odd.limit(0), tables).collect() == []


def test_last_stage(spark, odd, tables):
    assert len({x["sequence_id"] for x in corpus_pipeline.pack(spark, odd, tables).collect()}) > 100
    assert corpus_pipeline.pack(spark, odd.limit(0), tables).collect() == []
