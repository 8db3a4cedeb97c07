"""The pipeline against brute force, stage by stage, on a small directory of tables."""

import random

import pytest

import corpus_pipeline
from paperloom.llm import decontaminate, packing, quality
from tests.llm.test_dedup import brute_components, corpus

P = pytest.importorskip("public_tokenizers")


def plain_cut(docs):
    """Bytes that a string of 100 covers which starts earlier, removed by comparing all strings."""
    seen, out = set(), {}
    for d, t in sorted(docs.items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not any(gone) or left.strip():
            out[d] = t if t is None else left
    return out


def test_pipeline_is_brute_force(spark, tmp_path):
    r = random.Random(3)
    texts = corpus(21, 40)
    items = [f"Which of these words {k} comes first when stones are {k} sorted by weight and colour alone? It is the {k} heavy stone number {k} of all." for k in ("red", "blue", "green")]
    for k, d in enumerate((12, 15, 18, 20)):
        texts[d] += " " + items[k % 3] + " and on it goes"
    toxic = {d for d in range(len(texts)) if r.random() < 0.4 and texts[d] and len(texts[d]) > 100}
    for d in toxic:
        texts[d] += " vile rotten filth" * 6
    rows = [(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, 1, int(d in toxic)) for d in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    verdicts = quality.classify(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    docs = {v["doc_id"]: texts[v["doc_id"]] for v in verdicts if v["keep"]}
    assert not toxic & docs.keys() and len(docs) == len(texts) - len(toxic)
    ids = sorted(docs)
    parts = brute_components([docs[d] for d in ids])
    docs = {d: docs[d] for k, d in enumerate(ids) if parts[k][1] == k}
    docs = plain_cut(docs)
    index, words = decontaminate.Index(list(range(3)), items), decontaminate.split_words
    leaks = {d for d, t in docs.items() if any(decontaminate.shingles(words(i)) <= decontaminate.shingles(words(t or "")) for i in items)}
    found = {d for d, t in docs.items() if any(x[3] >= 0.8 and x[4] >= 0.8 for x in index.leaks([words(t or "")])[0])}
    assert leaks and found >= leaks and len(found) <= len(leaks) + 1
    docs = {d: t for d, t in docs.items() if d not in found}
    enc = packing.WordEncoder(P.path("word_bpe_49k.json"))
    want = {d: len(e) + 1 for d, e in zip(docs, enc.encode_all([t or "" for t in docs.values()]), strict=True)}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"]: x["doc_tokens"] for x in got} == want
    assert sum(x["length"] for x in got) == sum(want.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
