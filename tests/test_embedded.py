"""States within scripts: balanced values, chunks, lists of references, handlers."""

from heddle.functions.embedded import balanced
from heddle.plans import hydration
from tests.conftest import SF


def test_values_end_where_they_balance():
    assert balanced('x{"a": "}{", "b": [1, {"c": "\\"}"}]} more }', 1) == '{"a": "}{", "b": [1, {"c": "\\"}"}]}'
    assert balanced("[1, 2", 0) is None and balanced("{a: 1}", 0) is None and balanced("[NaN]", 0) is None and balanced("7", 0) is None
    assert balanced("[" * 100_000, 0) is None


def test_entries_of_planted_pages(spark):
    got = {}
    for r in hydration.hydration_entries(spark, SF).collect():
        got.setdefault(r["page_id"], {})[r["key"]] = (r["framework"], r["value"])
    pages = {i: -1 - k for k, i in ((next(k for k, p in enumerate(hydration.PAGES) if mark in p), mark) for mark in ("run()", "go();", "plain line", "no records", "Date:2024", "Date:2020", '"post"', "q:container=\"paused\""))}
    assert got[pages["run()"]] == {"r[0]": ("Remix", "1"), "r[1].k": ("Remix", "]")}
    assert got[pages["go();"]] == {"a[0].b.c[0]": ("Nuxt", "1"), "a[0].b.c[1]": ("Nuxt", "2")}
    assert got[pages["plain line"]] == {"title": ("NextFlight", "New"), "n": ("NextFlight", "1"), "_rsc_0[0]": ("NextFlight", "1"), "_rsc_0[1].x": ("NextFlight", "y]"), "_rsc_1": ("NextFlight", "text")}
    assert got[pages["no records"]] == {"": ("NextFlight", "no records")}
    assert got[pages["Date:2024"]] == {"when": ("Nuxt", "2024-05-01"), "big": ("Nuxt", "12n"), "gone": ("Nuxt", "null"), "list[0]": ("Nuxt", "0"), "list[1]": ("Nuxt", "NaN"), "list[2]": ("Nuxt", "3")}
    assert got[pages["Date:2020"]] == {"_1.a": ("Nuxt", "x"), "_2": ("Nuxt", "2020"), "_3[0]": ("Nuxt", "true")}
    assert got[pages['"post"']] == {"post.title": ("SvelteKit", "T")}
    assert got[pages['q:container="paused"']]["_qrl_handlers[1].handler"] == ("Qwik", "./n.js#set") and got[pages['q:container="paused"']]["ctx.a[0]"] == ("Qwik", "1")


def test_levels_beyond_the_depth_stay_text(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "X", "", '{"a": {"b": [1, {"c": {}}]}, "d": null, "e": []}')], "page_id long, framework string, key string, j string")
    states = rows.select("page_id", "framework", "key", F.parse_json("j").alias("state"))
    whole = {r["key"]: r["value"] for r in hydration.flatten(states).collect()}
    assert whole == {"a.b[0]": "1", "d": "null"}
    assert {r["key"]: r["value"] for r in hydration.flatten(states, 2).collect()} == {"a.b": '[1,{"c":{}}]', "d": "null"}
    assert hydration.flatten(states.limit(0)).count() == 0
