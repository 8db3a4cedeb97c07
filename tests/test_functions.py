"""Golden cases and properties of the sequential text functions, the layout and the transitions."""

import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom import adapters, schemas
from paperloom.functions import markup as M
from paperloom.functions import text as X
from paperloom.operators import headings, jobs, layout, profile, requests
from paperloom.streaming import feed


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("no math", "no math"),
        ("cost $5 to $10", "cost $5 to $10"),
        ("cost $5, area $x^{2}$", "cost $5, area x²"),
        ("$ ( $", "("),
        ("$ 1920*1080 $ px", "1920*1080 px"),
        ("$8mm^{2}$", "8mm²"),
        ("$ ^{\\circ} $C", "°C"),
        ("\\(\\pm0.3\\)", "±0.3"),
        ("\\[\\frac{a}{b}\\]", "a/b"),
        ("$\\alpha + \\beta$", "α + β"),
        ("\\(a \\leq b \\le\\)", "a ≤ b ≤"),
        ("$\\alpha \\beta$", "αβ"),
        ("$$a_{1}+b_{max}$$", "a₁+b_max"),
        ("$\\sqrt{x}$", "√(x)"),
        ("$\\unknown{x}$", "unknownx"),
        ("a $ b", "a $ b"),
    ],
)
def test_latex(text, expected):
    assert M.latex_to_unicode(text) == expected


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="a1 $\\()[]{}^_中文\n", max_size=40))
def test_latex_without_signs_left_is_stable(text):
    once = M.latex_to_unicode(text)
    if "$" not in once and "\\" not in once:
        assert M.latex_to_unicode(once) == once


@settings(deadline=None)
@given(st.lists(st.text(alphabet="中文 a\t", max_size=6), max_size=6))
def test_han_spaces_across_runs(runs):
    got = M.strip_han_spaces_across(runs)
    assert "".join(runs if got is None else got) == M.strip_han_spaces("".join(runs))
    assert got is None or len(got) == len(runs)


def table(body):
    return [line.split(" | ") for line in M.table_to_markdown(f"<table>{body}</table>").strip().split("\n")]


def test_tables():
    assert M.table_to_markdown("no table") == "no table"
    assert M.table_to_markdown("<table></table>") == "<table></table>"
    assert M.table_to_markdown("<table><tr><td>a|b<br>c</td><th> d </th></tr></table>") == "\n\n| a\\|b c | d |\n| --- | --- |\n\n"
    down = M.table_to_markdown('<table><tr><td rowspan="2位">a</td><td>b</td></tr><tr><td>c</td></tr></table>')
    assert down == "\n\n| a | b |\n| --- | --- |\n|   | c |\n\n"
    wide = M.table_to_markdown('<table><tr><td colspan=2>a</td></tr><tr><td>b</td><td>c</td><td>&amp;</td></tr></table>')
    assert wide == "\n\n| a |   |   |\n| --- | --- | --- |\n| b | c | & |\n\n"
    assert len(table('<tr><td colspan="9999">a</td></tr>')[0]) == schemas.MAX_SPAN
    late = M.lay_out(M.parse("<tr><td>a</td><td rowspan=2>b</td></tr><tr><td colspan=2>c</td></tr><tr><td>d</td></tr>").find_all("tr"))
    assert [len(r) for r in late] == [2, 2, 2]  # what a wide cell covered shows a row later


@settings(deadline=None, max_examples=80)
@given(st.lists(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=4), max_size=5))
def test_grid_holds_every_cell(rows):
    html = "".join("<tr>" + "".join(f"<td rowspan={r} colspan={c}>x</td>" for r, c in row) + "</tr>" for row in rows)
    grid = M.lay_out(M.parse(html).find_all("tr"))
    assert len(grid) == len(rows)
    assert sum(c.element is not None for row in grid for c in row) == sum(map(len, rows))
    got = M.word_table(html)
    assert got["n_rows"] == len(rows) and all(s["rowspan"] > 1 or s["colspan"] > 1 for s in got["spans"])


def test_word_table_and_merges():
    got = M.word_table('<table><tr><td rowspan=2 colspan=2>a <b>b</b><img src="i.png"></td><td>c d</td></tr><tr><td>e</td></tr></table>')
    assert got["grid"][0][0] == [("text", "a"), ("text", "b"), ("img", "i.png")] and got["grid"][0][1] == [] and got["fingerprint"] == "abcd"
    assert got["spans"] == [{"row": 0, "col": 0, "rowspan": 2, "colspan": 2}]
    assert M.merge_cells([3, 3], got["spans"]) == [{"row": 0, "col": 0, "grid_span": 2, "deleted": 1, "vertical": "restart"}, {"row": 1, "col": 0, "grid_span": 2, "deleted": 1, "vertical": "continue"}]
    assert M.merge_cells([1], [{"row": 4, "col": 0, "rowspan": 2, "colspan": 1}]) == []
    assert M.match_specs([(1, 1, "a"), (2, 2, "no"), (1, 1, "b")], [(3, 1, "z"), (1, 1, "a"), (1, 1, "b")]) == [1, None, None]


def test_images_and_markdown():
    assert M.image_to_markdown('<img src="a (1).png" alt="Image">') == "\n\n![](a%20%281%29.png)\n\n"
    assert M.image_to_markdown('<img src="x.png" alt="a[b]">') == "\n\n![a\\[b\\]](x.png)\n\n"
    assert "data URI" in M.image_to_markdown('<img src="data:image/png;base64,AAAA">')
    files = {}
    assert ".png)" in M.image_to_markdown('<img src="data:image/png;base64,AAAA">', files) and list(files.values()) == [b"\0\0\0"]
    assert M.pipe_row_breaks("| a\\nb |\nC:\\new\n    | x\\ny |\n```\n| z\\nw |\n```") == "| a<br>b |\nC:\\new\n    | x\\ny |\n```\n| z\\nw |\n```"
    assert M.unwrap_centred('<div style="text-align: center;">x</div>') == "x"
    assert M.rewrite_images("![a](tmp/p.png) ![b](q.png)", {"p.png"}) == "![a](imgs/p.png) ![b](q.png)"
    md = M.process_markdown('中 文 $x^{2}$ <div class="table"><table><tr><td>甲 乙\\n丙</td></tr></table></div> &lt;table&gt; 年&#32;月')
    assert "中文 x²" in md and "| 甲乙<br>丙 |" in md and "<table>" in md and md.endswith("年月")
    assert M.finish_paragraph(["a &amp; 中 ", "文"]) == ["a & 中", "文"]
    assert M.finish_paragraph(["x\\ny"], in_cell=True) == ["x\ny"]


def item(line, x, y, w=40, h=10):
    return {"line": line, "poly": [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]}


def test_reading_order():
    page = pd.DataFrame([item(0, 100, 0), item(1, 0, 2), item(2, 0, 20), item(3, 60, 0, 30, 60), item(4, 100, 21)])
    assert layout.reading_order(page)["line"].tolist() == [1, 3, 0, 2, 4]
    assert layout.reading_order(pd.DataFrame([{"line": 0, "poly": []}])).empty


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 200), st.integers(1, 60)), min_size=1, max_size=12))
def test_reading_order_is_a_permutation(boxes):
    page = pd.DataFrame([item(k, x, y, 20, h) for k, (x, y, h) in enumerate(boxes)])
    got = layout.reading_order(page)
    assert sorted(got["line"]) == list(range(len(boxes))) and got["order"].tolist() == list(range(len(boxes)))


def region(a, b):
    return [[a, 0], [b, 0], [b, 9], [a, 9]]


def test_line_runs():
    assert layout.line_runs("中 文", None, None, 0, 9) == [("中文", 0, 9)]
    even = layout.line_runs("abcd", list("abcd"), [region(k * 10, k * 10 + 10) for k in range(4)], 0, 40)
    assert even == [("abcd", 0, 40)]
    marked = layout.line_runs("1. body", ["1", ". ", "body"], [region(0, 8), region(8, 16), region(60, 100)], 0, 100)
    assert [r[0] for r in marked] == ["1.", "body"] and marked[1][1] == 60
    glued = layout.line_runs("1. body", ["1", ". ", "body"], [region(0, 8), region(8, 16), region(16, 60)], 0, 60)
    assert "".join(r[0] for r in glued).replace(" ", "") == "1.body"
    assert layout.line_runs("ab", ["a", "b"], [region(0, 5), []], 0, 9) == [("ab", 0, 9)]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.tuples(st.text(alphabet="ab中1.", min_size=1, max_size=3), st.integers(0, 30)), min_size=2, max_size=10))
def test_runs_keep_the_text_and_touch(tokens):
    text, x, regions = "".join(t for t, _ in tokens), 0, []
    for t, gap in tokens:
        regions.append(region(x, x + 8 * len(t)))
        x += 8 * len(t) + gap
    runs = layout.line_runs(text, [t for t, _ in tokens], regions, 0, x)
    assert "".join(r[0] for r in runs) == text
    assert all(a[2] <= b[1] for a, b in zip(runs, runs[1:], strict=False)) and all(r[1] < r[2] for r in runs)


def test_ink():
    gray = np.full((40, 60), 255, np.uint8)
    gray[10:20, 5:50] = 0
    assert layout.ink_band(gray, 0, 60, 0, 40) == (10, 20) and layout.ink_columns(gray, 0, 60, 0, 40) == (5, 50)
    assert not layout.is_inverted(gray, 0, 60, 0, 40) and layout.is_inverted(255 - gray, 0, 60, 0, 40)
    assert layout.ink_band(255 - gray, 0, 60, 0, 40, invert=True) == (10, 20)
    assert layout.ink_band(np.full((40, 60), 255, np.uint8), 0, 60, 0, 40) is None and layout.ink_band(gray, 0, 1, 0, 40) is None
    assert layout.downscale(np.zeros((10, 20, 3), np.uint8), 0.5).shape == (5, 10, 3)
    assert layout.pixels_of(bytes(range(12)), 2, 2, 3)[0, 0].tolist() == [2, 1, 0] and layout.gray_of(np.array([[[3, 1, 2]]], np.uint8)).tolist() == [[1]]
    got = layout.placements([{"text": "abcd", **item(0, 5, 10, 45, 10)}], 1.0, adapters.Identity(), gray)
    assert len(got) == 1 and got[0]["x"] == 5 and got[0]["stretch"] <= schemas.STRETCH_PLAIN


def test_columns(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], list(v)).select(c.alias("r")).first()["r"]
    from pyspark.sql import functions as F

    assert one(X.cell_span(F.col("a")), a="00000000000012") == 12 and one(X.cell_span(F.col("a")), a="9" * 40) == 64 and one(X.cell_span(F.col("a")), a="abc") == 1
    assert one(X.download_name(F.col("a")), a='  a/b\\c "d"\t  e..  ') == "a_b_c_'d'_e" and one(X.download_name(F.col("a")), a="...") == "download"
    assert one(X.content_disposition(F.col("a")), a="文件.pdf") == "attachment; filename=\"download.pdf\"; filename*=UTF-8''%E6%96%87%E4%BB%B6.pdf"
    assert one(X.visible_chars(F.col("a")), a=" a　b\x1cc ") == 3
    assert one(X.size_label(F.col("a")), a=1536) == "1.5 KB" and one(X.env_int(F.col("a"), 3), a="x") == 3
    assert [tuple(h) for h in one(X.heading_lines(F.col("a")), a="# A b\ntext\n### C\n#no")] == [(1, "A b"), (3, "C")]
    pdf = lambda b: one(requests.preflight(F.col("a")), a=bytearray(b))
    assert pdf(b"") == pdf(b"%PDF") == pdf(b"GIF89") == "not_pdf" and pdf(b"%PDF-1.7 /Encrypt 5 0 R") == "encrypted_pdf" and pdf(b"%PDF-1.7 x") == "invalid_pdf"
    assert pdf(b"%PDF-1.4 /Root 1 0 R /EncryptMetadata true /Type /Pages /Type /Page ") is None and pdf(b"%PDF-1.4 /Root 1 0 R /Type /Pages /Count 0") == "empty_pdf"
    large = lambda b: one(requests.preflight(F.col("a"), F.lit(200), 100), a=bytearray(b))
    assert large(b"%PDF-1.4 anything") is None and large(b"%PDF-1.4 /Encrypt<<") == "encrypted_pdf" and large(b"%PDF-1.4 /Encrypt 5 0 R" + b" " * 65536) is None
    assert one(requests.preflight(F.when(F.col("a") > 1, F.lit(b""))), a=1) == "invalid_pdf"
    assert tuple(one(requests.gpu_row(F.col("a")), a="RTX, 100, 20\nother")) == ("RTX", 100, 20)
    assert one(jobs.backoff_ms(F.col("a"), F.lit(False)), a=3) == 8000 and one(jobs.backoff_ms(F.col("a"), F.lit(True)), a=0) == 30000
    assert one(jobs.percent(F.col("a"), F.col("b")), a=29, b=100) == 28
    page = spark.createDataFrame([(1, 0, "a" * 50), (1, 1, None)], "doc_id long, page_index int, text string")
    assert profile.profile_struct(profile.page_profile(page)).first()["pages"][1]["chars"] == 0


def test_schema_evolution(spark):
    old = spark.createDataFrame([("a",)], "id string")
    new = schemas.evolve(old, schemas.JOBS, {"engine": "auto", "attempts": 0})
    assert new.first()["engine"] == "auto" and schemas.evolve(new, schemas.JOBS).columns == new.columns


def job_rows(spark, rows):
    return schemas.evolve(spark.createDataFrame(rows, "id string, group_id string, status string, attempts int, heartbeat_at double, created_at double, mode string"), schemas.JOBS)


def test_transitions(spark):
    table = job_rows(spark, [("a", None, "queued", 0, None, 2.0, "pdf"), ("b", None, "queued", 0, None, 1.0, "pdf"), ("c", "g", "cancel_requested", 0, 5.0, 1.0, "word"), ("d", "g", "cancel_requested", 0, 999.0, 1.0, "markdown"), ("e", None, "processing", 2, None, 1.0, "pdf"), ("f", None, "processing", 1, 880.0, 1.0, "pdf")])
    by = lambda df: {r["id"]: (r["status"], r["attempts"]) for r in df.collect()}
    assert by(jobs.claim(table, 10.0))["b"] == ("processing", 0)
    got = by(jobs.reap(table, 1000.0))
    assert got["c"][0] == got["d"][0] == "cancelled" and got["e"] == ("error", 2) and got["f"] == ("processing", 1)
    assert by(jobs.reap(table, 1000.1))["f"] == ("queued", 2)
    assert by(jobs.resolve_group(table, "g", 1.0))["d"][0] == "cancelled" and by(jobs.resolve_group(table, None, 1.0)) == by(table)
    ids = spark.createDataFrame([("a",), ("f",), ("zz",)], "id string")
    state = spark.createDataFrame([("a", "queued"), ("f", "processing")], "job_id string, status string")
    after, progress = jobs.request_cancel(table, state, ids, 1.0)
    assert by(after)["a"][0] == "cancelled" and by(after)["f"][0] == "cancel_requested"
    assert {r["job_id"]: r["status"] for r in progress.collect()} == {"a": "queued", "f": "cancel_requested"}
    left, kept = jobs.remove(table, state, ids)
    assert left.count() == 4 and kept.count() == 0
    more, rows = jobs.enqueue(table, state, spark.createDataFrame([("n", "pdf")], "id string, mode string"), 3.0)
    assert by(more)["n"] == ("queued", 0) and rows.count() == 3
    outcome = by(jobs.handle_outcome(table, spark.createDataFrame([("c", "CANCELLED"), ("e", "TIMEOUT"), ("f", "DRAIN")], "id string, verdict string"), 1.0))
    assert outcome["c"][0] == outcome["d"][0] == "cancelled" and outcome["e"] == ("error", 2) and outcome["f"] == ("queued", 1)
    assert by(jobs.fail(table, ids, "error", "no", 1.0))["a"][0] == "error"
    assert jobs.group_members(table, "g").count() == 2 and jobs.group_members(table, None).count() == 0
    assert jobs.view(jobs.with_progress(table, spark.createDataFrame([("a", 1, 2, "m")], "job_id string, current int, total int, message string"))).where("id = 'a'").first()["progress"]["percent"] == 50


def test_watchdog(spark):
    rows = [
        ("a", "g1", "cancel_requested", 100.0, True, 985.0), ("b", "g1", "done", 990.0, False, None),  # 15 s of grace are not over
        ("c", "g2", "cancel_requested", 999.0, True, 984.0), ("d", "g2", "cancel_requested", 999.0, False, 980.0),
        ("e", "g3", "done", 999.0, True, None), ("f", "g3", "cancel_requested", 999.0, False, 900.0),  # the claimed member isn't to be cancelled
        ("h", None, "processing", 699.0, True, None), ("i", None, "processing", 700.0, True, None), ("j", None, "processing", -801.0, True, None), ("k", None, "processing", -800.0, True, None),
        ("l", "", "processing", None, True, None), ("m", None, "cancel_requested", 600.0, True, 990.0),
    ]
    table = spark.createDataFrame(rows, "id string, group_id string, status string, heartbeat_at double, claimed boolean, cancel_at double")
    state = spark.createDataFrame([("j", "saving", "view"), ("k", "converting", ""), ("h", "processing", "saving")], "job_id string, status string, message string")
    got = {r["watched"]: r["verdict"] for r in jobs.watch_limits(table, state, 1000.0).collect()}
    assert got == {"g1": None, "g2": "CANCELLED", "g3": None, "job:h": "TIMEOUT", "job:i": None, "job:j": "TIMEOUT", "job:k": None, "job:l": None, "job:m": "TIMEOUT"}
    assert {r["verdict"] for r in jobs.watch_limits(table, state, 1000.0, stopping=True).collect()} == {"DRAIN"}


def test_known_heading_levels(spark):
    paragraphs = spark.createDataFrame([(1, 0, "A b", 14.0, True, "left"), (1, 1, "c", 12.0, False, "left"), (1, 2, "d", 12.0, False, "left"), (2, 0, "x", 20.0, True, "left")], "doc_id long, seq int, text string, size double, bold boolean, alignment string")
    known = headings.known_levels(spark.createDataFrame([(1, "## A  b\n# A b")], "doc_id long, text string"))
    assert [tuple(r) for r in headings.heading_levels(paragraphs, known).collect()] == [(1, 0, 2)]
    assert [tuple(r) for r in headings.heading_levels(paragraphs).collect()] == [(1, 0, 1)]


def test_ocr_seam(spark):
    class Engine:
        def recognise(self, images):
            if b"bad" in images:
                raise ValueError
            return [{"rec_texts": [x.decode()]} for x in images]

    pages = spark.createDataFrame([(1, 0, b"a"), (1, 1, b"bad"), (1, 2, b"c")], "doc_id long, page_index int, image binary").coalesce(1)
    assert [r["result"] for r in adapters.recognise(pages, Engine()).orderBy("page_index").collect()] == ['{"rec_texts": ["a"]}', "{}", '{"rec_texts": ["c"]}']

    class Markdown:
        def to_markdown(self, content):
            return content.decode()

    files = spark.createDataFrame([("p", b"x"), ("q", b"\xff")], "path string, content binary")
    assert {r["path"]: r["markdown"] for r in adapters.to_markdown(files, Markdown()).collect()} == {"p": "x", "q": None}


EVENTS = [("a", 0, "enqueue"), ("a", 1, "claim"), ("b", 0, "enqueue"), ("a", 2, "crash"), ("b", 1, "cancel"), ("a", 3, "claim"), ("a", 4, "cancel"), ("a", 5, "stale"), ("c", 0, "enqueue"), ("c", 1, "claim"), ("c", 2, "done"), ("c", 3, "crash"), ("d", 0, "enqueue"), ("d", 1, "claim"), ("d", 2, "drain")]


def test_state_machine():
    status, attempts = feed.step("processing", 2, "crash")
    assert (status, attempts) == ("error", 2) and feed.step("cancel_requested", 0, "crash") == ("queued", 1) and feed.step("cancel_requested", 0, "drain") == ("cancel_requested", 0)


def test_stream_is_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = [(j, s, datetime(2024, 1, 1, 0, 0, s), k) for j, s, k in EVENTS]
    for k in range(0, len(log), 6):
        spark.createDataFrame(log[k : k + 6], feed.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(feed.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = feed.job_states(stream).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("changes").collect())
    want = sorted(tuple(r) for r in feed.job_states_batch(spark.createDataFrame(log, feed.EVENT)).collect())
    final = {}
    for j, _, _, s, _ in got:
        final[j] = s
    assert got == want and final == {"a": "cancelled", "b": "cancelled", "c": "done", "d": "queued"}


def test_batch_walks_jobs_over_batches(spark):
    """One long job among short ones, in batches of three rows: as pandas folds each job; the plan has no call of Python for each job."""
    rng = random.Random(4)
    kinds = ["enqueue", "claim", "promote", "drain", "stale", "crash", "cancel", "done"]
    log = [(j, s, datetime(2024, 1, 1), "enqueue" if s == 0 else rng.choice(kinds[1:7])) for j, n in [("", 9), ("long", 200), (None, 5), *((f"j{k}", 1 + k % 4) for k in range(60))] for s in range(n)]
    rng.shuffle(log)
    want = []
    for j in {r[0] for r in log}:
        want += [(j, *c) for c in feed.fold(pd.DataFrame([(s, k) for x, s, _, k in log if x == j], columns=["seq", "kind"]))]
    key = lambda r: (r[0] is None, r[0] or "", r[1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = feed.job_states_batch(spark.createDataFrame([*log, ("long", None, None, "enqueue"), ("none", None, None, "enqueue")], feed.EVENT))
        assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_change_feed_and_rates(spark, tmp_path):
    rows = [("a", "processing", 1.0), ("a", "done", 2.0), ("b", "queued", 1.0)]
    spark.createDataFrame(rows, "id string, status string, updated_at double").write.parquet(str(tmp_path / "jobs"))
    seen = []
    stream = spark.readStream.schema("id string, status string, updated_at double").parquet(str(tmp_path / "jobs"))
    q = feed.change_feed(stream, lambda n, active, ended: seen.append(([r["id"] for r in active.collect()], [r["id"] for r in ended.collect()]))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen == [(["b"], ["a"])]
    beats = spark.createDataFrame([("k", datetime(2024, 1, 1, 0, 0, 1)), ("k", datetime(2024, 1, 1, 0, 0, 2))], "key string, ts timestamp")
    assert feed.request_rates(beats, 1).first()["refused"] == 1
    assert feed.stalls(beats.withColumnRenamed("key", "group")).first()["beats"] == 2
