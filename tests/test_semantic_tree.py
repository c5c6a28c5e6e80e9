"""The reduced tree against a plain recursion, several values per key, and labels that contain each other."""

import pytest
from pyspark.sql import functions as F

from heddle.functions import text
from heddle.operators import semantic_tree as ops
from heddle.operators.staged import first_unlike
from heddle.plans import forms, trees
from heddle.sources.html_dom import sem_nodes
from tests.conftest import SF


def recursion(rows, category, risky):
    """[(node, parent, depth, label, relevance, action)] of a page's {node: row}."""
    below = {n: [] for n in rows}
    roots = [n for n, r in rows.items() if r["parent_id"] not in rows]
    for n, r in rows.items():
        if r["parent_id"] in rows:
            below[r["parent_id"]].append(n)

    def build(n):
        r = rows[n]
        fits = category == "generic" or r["role"] in ops.ALWAYS or r["role"] in ops.USEFUL.get(category, ())
        if not fits and n not in risky:
            return None
        label = risky.get(n, r["label"])
        children = [c for c in map(build, sorted(below[n])) if c]
        if label == "" and r["tag"] in ops.FRAMES:
            return {"id": n, "label": "", "relevance": 0.0, "action": None, "html_id": None, "role": r["role"], "children": children} if children else None
        kept = [c for c in children if c["relevance"] > 0.15 or c["action"] or c["children"] or c["role"] in ops.FIRM]
        kept = [c["children"][0] if c["label"] == "" and c["action"] is None and len(c["children"]) == 1 and c["html_id"] is None else c for c in kept]
        return {"id": n, "label": label, "relevance": r["relevance"], "action": r["action"], "html_id": r["html_id"], "role": r["role"], "children": kept}

    out = []

    def walk(node, parent, depth):
        out.append((node["id"], parent, depth, node["label"], node["relevance"], node["action"]))
        for c in node["children"]:
            walk(c, node["id"], depth + 1)

    for tree in filter(None, map(build, roots)):
        walk(tree, None, 0)
    return out


@pytest.mark.parametrize("goal", ["read the news", "click the button", "fill the form", "go to the next page", "something"])
def test_reduced_trees_equal_a_recursion(spark, goal):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").filter("page_id < 12")
    nodes = sem_nodes(pages.unionByName(spark.createDataFrame(trees.PLANTED, "page_id long, html string")), goal)
    rows, risky = {}, {}
    found = nodes.withColumn("clean", F.when(text.risk_severity(F.col("label")).isNotNull(), text.sanitize(F.col("label"))))
    for r in found.collect():
        rows.setdefault(r["page_id"], {})[r["node_id"]] = r
        if r["clean"] is not None:
            risky[r["page_id"], r["node_id"]] = r["clean"]
    category = spark.range(1).select(text.goal_category(F.lit(goal))).first()[0]
    want = {(p, *x) for p, held in rows.items() for x in recursion(held, category, {n: c for (q, n), c in risky.items() if q == p})}
    got = ops.reduced_tree(nodes, goal).select("page_id", "node_id", "parent_id", "depth", "label", "relevance", "action").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert 0 < len(want) < sum(map(len, rows.values()))
    assert ops.reduced_tree(nodes.limit(0), goal).count() == 0


def test_marks_go_up_once(spark):
    paths = [[0], [0, 1], [0, 1, 2], [0, 1, 2, 3], [0, 4], [0, 4, 5], [6], [6, 7]]
    frame = spark.createDataFrame([(1, p[-1], p, p[-1] in (1, 3, 5)) for p in paths], "page_id long, node_id long, path array<long>, m boolean")
    got = {r["node_id"] for r in ops.with_marked_below(frame, F.col("m"), "below").filter("below").collect()}
    assert got == {0, 1, 2, 4}


def test_several_values_for_a_key(spark):
    rows = forms.extract_data_multi(spark, SF).filter("page_id = -2").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["key"], r["rank"])):
        got.setdefault(r["key"], []).append((r["value"], r["source_id"]))
    assert all(1 <= len(v) <= 3 for v in got.values()) and sum(map(len, got.values())) > len(got)
    assert got["url"][0] == ("Read more", 2)  # labels, not addresses
    assert got["story_title"][0] == ("Story of a title", 1) and got["version"][0] == ("1.15.0", 4) and got["released"][0] == ("May 2024", 7)
    assert all(r["confidence"] <= 1 for r in rows)


def test_labels_that_contain_each_other(spark):
    import random

    rng = random.Random(1)
    lists = [["abcd", "xabcdx", "bc", "wxyz"], [], ["".join(rng.choices("ab", k=rng.randint(2, 9))) for _ in range(2000)]]
    frame = spark.createDataFrame([(k, [(t,) for t in texts]) for k, texts in enumerate(lists)], "k int, items array<struct<text: string>>")
    for most in (2, 20):
        for r in frame.select("k", first_unlike(F.col("items"), most).alias("kept")).collect():
            kept = []
            for t in lists[r["k"]]:
                if len(kept) < most and not any(t in p or p in t for p in kept):
                    kept.append(t)
            assert [x["text"] for x in r["kept"]] == kept


def plain_markdown(rows):
    """[(node, level)] of the nodes that a recursion writes, whatever their line."""
    below = {n: [] for n in rows}
    roots = []
    for n, r in sorted(rows.items()):
        (below[r["parent_id"]] if r["parent_id"] in rows else roots).append(n)
    out = []

    def write(n, depth):
        out.append((n, depth))
        label = rows[n]["label"].strip()
        for c in below[n]:
            own = rows[c]["label"].strip()
            if own and label and own in label:
                for g in below[c]:
                    write(g, depth + 1)
            else:
                write(c, depth + 1)

    for n in roots:
        write(n, 0)
    return out


def test_markdown_passes_over_labels_within_their_parents(spark):
    page = "<main aria-label=m><h1>Top words</h1><div>a b c<p>a b<b>a<i>a</i></b></p><p>other</p></div><a href=/x>see</a><input name=q value=v><input type=checkbox checked aria-label=on><img alt=pic></main>"
    more = spark.createDataFrame([(-9, page)], "page_id long, html string")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").filter("page_id < 12").unionByName(more)
    nodes = ops.reduced_tree(sem_nodes(pages, "something"), "something")
    rows = {}
    for r in nodes.collect():
        rows.setdefault(r["page_id"], {})[r["node_id"]] = r
    got = {}
    for r in trees.markdown_lines(nodes).collect():
        got.setdefault(r["page_id"], {})[r["node_id"]] = (r["level"], r["line"])
    for page_id, held in rows.items():
        want = dict(plain_markdown(held))
        lines = got.get(page_id, {})
        assert set(lines) <= set(want) and all(lines[n][0] == want[n] for n in lines)
        assert all(n in lines for n in want if held[n]["role"] == "heading" and held[n]["label"].strip())
    text = "".join(line for _, (_, line) in sorted(got[-9].items()))
    assert "## Top words\n\n" in text and "  - [see](click)\n" in text and "  - `q`: v\n" in text and "- [x] on\n" in text


def test_cut_of_short_and_even_lists(spark):
    from heddle.operators.cuts import calibrated, cut_at_gap

    lists = {1: [0.9, 0.1, 0.01], 2: [0.9] * 8, 3: [0.9, 0.8, 0.7, 0.6, 0.55, 0.2, 0.1], 4: [0.9 - 0.05 * i for i in range(12)]}
    frame = spark.createDataFrame([(k, i, x) for k, xs in lists.items() for i, x in enumerate(xs)], "k int, t int, s double")
    got = {}
    for r in cut_at_gap(frame, ["k"], "s", "t", 10).collect():
        got.setdefault(r["k"], []).append(r["reason"])
    assert {k: (len(v), v[0]) for k, v in got.items()} == {1: (3, "too_few_candidates"), 2: (8, "broad"), 3: (5, "relevance_gap"), 4: (10, "broad")}
    one = spark.range(1).select(calibrated(F.lit(0.5), F.lit(0), F.lit(10), F.lit(False)), calibrated(F.lit(0.5), F.lit(20), F.lit(10), F.lit(True))).first()
    assert one[0] == pytest.approx(0.7312, abs=2e-3) and one[1] == 0.99
