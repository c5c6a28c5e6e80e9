"""The core queries against their SQL in DuckDB, and small hand-made cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from heddle.functions import text, urls
from heddle.plans import pages, registry
from heddle.sources import html_dom
from heddle.streaming import collab
from tests.conftest import SF

TABLES = "events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.collect()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in found.fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


PAGE = """<html><head><title>T</title></head><body><p>one<p>two <b>bold</b></p>
<div style="display: none"><a href="/x">gone</a></div><button>Buy now</button><span class=price>$ 9.90</span>
<ul><li>a<li>b</ul><input type=checkbox aria-label="Agree"><script>var x = "<p>";</script><a href="/n">News</a></body>"""


def test_tree_of_a_page(spark):
    pages = spark.createDataFrame([(1, PAGE, "x"), (2, None, "y"), (3, "", "z"), (4, "<b><<p></b", "q")], "page_id long, html string, text string")
    rows = [r for r in html_dom.sem_nodes(pages, "news").collect() if r["page_id"] == 1]
    by = {(r["role"], r["label"]): r for r in rows}
    assert ("text", "one") in by and ("text", "two bold") in by
    assert ("cta", "Buy now") in by and ("price", "$ 9.90") in by and ("checkbox", "Agree") in by
    assert not any("gone" in r["label"] for r in rows)
    assert [r["label"] for r in rows if r["tag"] == "li"] == ["a", "b"]
    assert by[("link", "News")]["value"] == "/n" and by[("link", "News")]["relevance"] > 0.7
    dom = html_dom.dom_nodes(pages)
    assert {r["page_id"] for r in dom.select("page_id").distinct().collect()} <= {1, 4}
    assert html_dom.dom_nodes(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("goal", "label", "score"),
    [("add to cart", "ADD to Cart now", 1.0), ("cart add", "add a cart", 1.0), ("add_to", "addto", 1.0), ("a zz", "a b", 0.5), ("", "x", 0.0)],
)
def test_similarity(spark, goal, label, score):
    row = spark.range(1).select(text.text_similarity(F.lit(goal), F.lit(label)).alias("s")).first()
    assert row["s"] == score


def test_expressions_take_nulls(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(
        text.tokens(none), text.risk_severity(none), text.sanitize(none), urls.host(none), urls.resolve(none, F.lit("http://a/b")),
        urls.firewall_level(F.lit("x"), F.lit("")),
    ).first()
    assert list(row)[:4] == [None] * 4 and row[5] == "allow"


def test_whitelist_wins(spark):
    url = F.lit("https://cdn.drift.com/a.png")
    row = spark.range(1).select(urls.firewall_level(url, F.lit("x")), urls.firewall_level(url, F.lit("x"), allowed=("drift.com",))).first()
    assert list(row) == ["l1", "allow"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    stream = collab.event_stream(spark, str(tmp_path / "in"), schema)
    keys = ["user_id", "event_type"]
    got = collab.last_state(collab.drain(collab.latest_per_key(stream, keys), str(tmp_path)), keys)
    want = collab.latest_per_key(events, keys)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_plan_of_a_goal(spark):
    rows: dict = {}
    for r in pages.plan_steps(spark, SF).collect():
        rows.setdefault(r["goal"], {})[r["step"]] = r
    assert set(pages.GOALS) < set(rows)  # and what users asked
    assert [rows["skapa ett konto"][i]["level"] for i in range(6)] == [0, 1, 1, 1, 2, 3]
    assert [rows["overview of the site"][i]["status"] for i in range(4)] == ["ready", "pending", "pending", "pending"]
    assert rows["zzz"][0]["description"].endswith("'zzz'") and rows["zzz"][0]["plan_cost"] == 0.8
    assert len(rows["buy a blue shirt"]) == 7 and rows["read the news"][1]["level"] == 1


def test_works_without_the_llm_folder():
    """The core imports nothing of the subpackage that may be removed."""
    import subprocess
    import sys

    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('heddle.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert 'bm25_documents_topk' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    )
    from tests.conftest import ROOT

    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
