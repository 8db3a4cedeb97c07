"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import math
import os

import pytest

from paperloom.plans import catalogue

duckdb = pytest.importorskip("duckdb")
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted([tuple(norm(r[i]) for i in order) for r in data])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    got = rows(df.columns, df.collect())
    assert got
    if name in catalogue.ORACLE:
        cur = duck.execute(catalogue.ORACLE[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, cur.fetchall())


def test_download_names_read_whole_texts(spark, tmp_path):
    rows = [(1, " " * 300 + "report.pdf", "en", "s", 310), (2, "\x01" * 350 + "a" * 250, "en", "s", 600), (3, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["name"] for r in catalogue.QUERIES["download_names"](spark, str(tmp_path)).collect()}
    assert got == {1: "report.pdf", 2: "a" * 200, 3: None}


def against_sql(spark, name, table, path):
    """The rows of a query and of its SQL over one table."""
    df = catalogue.QUERIES[name](spark, str(path))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
    cur = con.execute(catalogue.ORACLE[name])
    return rows(df.columns, df.collect()), rows([c[0] for c in cur.description], cur.fetchall())


def test_clean_markdown_keeps_cut_entities(spark, tmp_path):
    pages = ["<title>a &amp;&amp;&amp</title> &copy; 5$ &amp;lt; &lt;b&gt;", "<title>&quot;x&quot</title>&middot;&am", "&nbsp;&#38;&copy", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got, want = against_sql(spark, "clean_markdown", "pages", tmp_path)
    assert got == want and "&&&amp</title> © 5 &lt; <b>" in str(got)


def test_job_state_changes_on_odd_events(spark, tmp_path):
    events = [(0, 5, "signup"), (1, 5, "view"), (None, 5, "signup"), (None, None, "signup"), (2, None, "signup"), (3, None, "error"), (70, None, "signup"), (-70, 6, "signup"), (-69, 6, None), (4, 5, None), (64, 5, "signup")]
    spark.createDataFrame([(i, None, u, t) for i, u, t in events], "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got, want = against_sql(spark, "job_state_changes", "events", tmp_path)
    assert got == want and len(got) == 8
