"""Hypervectors bit by bit against a plain version, bundles over any split, trees against a recursion."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.functions import hypervectors as hv
from heddle.operators import hypervectors as ops
from heddle.plans import hypervectors as plans
from heddle.sources import html_dom
from heddle.sources.html_dom import sem_nodes
from tests.conftest import SF

TOP = (1 << 64) - 1
TEXTS = [
    "the cat chases the dog", "the dog chases the cat", "", "!", "a b", "Ünïcödé Wörter  und 42 Zahlen", "one", "one two", "one two three",
    "日本語 テキスト", "word " * 60, "x1-y2_z3", " \n\t",
]


def plain_seed(text):
    out, h = [], 0xCBF29CE484222325
    for i in range(32):
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 & TOP
        h = (h ^ i) * 0x100000001B3 & TOP
        out.append(h)
    return as_int(out)


def as_int(words):
    """A vector as one number, whose bit k is bit k % 64 of word k // 64."""
    return sum((w & TOP) << (64 * i) for i, w in enumerate(words))


def plain_permute(v, shift):
    shift %= 2048
    return (v << shift | v >> (2048 - shift)) & ((1 << 2048) - 1)


def plain_bundle(members):
    return sum(1 << k for k in range(2048) if sum(m >> k & 1 for m in members) > len(members) // 2)


def plain_vector(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if len(w.encode()) > 1]
    if not words:
        return plain_seed(text)
    s = [plain_seed(w) for w in words]
    n = len(s)
    parts = [plain_permute(s[i], 3 * i) for i in range(n)]
    parts += [plain_permute(s[i] ^ plain_permute(s[i + 1], 1), 5 * i) for i in range(n - 1)]
    parts += [plain_permute(s[i] ^ plain_permute(s[i + 1], 1) ^ plain_permute(s[i + 2], 2), 7 * i) for i in range(n - 2)]
    return plain_bundle(parts)


def test_seeds_bind_and_permute(spark):
    rows = spark.createDataFrame([(t, s) for t in TEXTS for s in (0, 1, 64, 100, 2047, 2048, 5000)], "text string, shift int")
    out = rows.select("text", "shift", hv.seed("text").alias("v")).withColumn("p", hv.permute(F.col("v"), F.col("shift")))
    out = out.withColumn("back", hv.bind(hv.bind(F.col("v"), F.col("p")), F.col("p"))).withColumn("same", hv.similarity(F.col("v"), F.col("back")))
    for r in out.collect():
        assert as_int(r["v"]) == plain_seed(r["text"]) and as_int(r["p"]) == plain_permute(as_int(r["v"]), r["shift"])
        assert r["back"] == r["v"] and r["same"] == 1.0


def test_texts_equal_the_plain_version(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None, TEXTS[0]]], "text string").repartition(3)
    got = {r["text"]: as_int(r["hv"]) for r in ops.encode(rows).collect()}
    assert got == {t: plain_vector(t) for t in TEXTS}
    assert got[TEXTS[0]] != got[TEXTS[1]]
    assert ops.encode(rows.limit(0)).count() == 0


def test_long_words_are_seeded_in_parts(monkeypatch):
    words = ["a" * n for n in (0, 5, 70, 3, 3, 200)]
    want = hv.seeds(words)
    monkeypatch.setattr(hv, "CHUNK", 90)
    assert (hv.seeds(words) == want).all() and as_int(want[5].tolist()) == plain_seed(words[5])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7])
def test_any_split_gives_the_same_bundle(spark, n):
    rows = spark.createDataFrame([("k", i, f"word{i} and{i}") for i in range(n)] + [("none", 0, None)], "key string, i int, t string")
    vectors = rows.join(ops.encode(rows, "t"), "t", "left")
    want = plain_bundle([plain_vector(f"word{i} and{i}") for i in range(n)])
    whole = ops.bundle(vectors, ["key"]).collect()
    parts = [ops.counts(vectors.filter(F.col("i") % 3 == k), ["key"]) for k in range(3)]
    again = ops.bundled(ops.merged(parts[2].unionAll(parts[0]).unionAll(parts[1]), ["key"]), ["key"]).collect()
    assert [(r["key"], r["members"], as_int(r["hv"])) for r in whole] == [("k", n, want)] == [(r["key"], r["members"], as_int(r["hv"])) for r in again]


def test_components_are_summed_before_they_move(spark):
    """Between the words' vectors and the shuffle stands a partial aggregation; components themselves are not shuffled."""
    plan = ops.encode(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    lines = [x.lstrip(" :+-") for x in plan.split("\n")]
    made = next(i for i, x in enumerate(lines) if x.startswith("Generate"))
    assert lines[made - 2].startswith("HashAggregate") and "partial_sum" in lines[made - 2] and lines[made - 3].startswith("Exchange")


def recursion(nodes):
    """{node: vector} of a page's {node: row}."""
    below = {n: [] for n in nodes}
    roots = []
    for n, r in nodes.items():
        (below[r["parent_id"]] if r["parent_id"] in nodes else roots).append(n)
    out = {}

    def build(n, depth):
        own = plain_permute(plain_vector(nodes[n]["label"]) ^ plain_seed(f"__role_{nodes[n]['role']}"), 7 * depth)
        out[n] = plain_bundle([own, *(build(c, depth + 1) for c in below[n])])
        return out[n]

    for n in roots:
        build(n, 0)
    return out


def test_trees_equal_a_recursion(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").filter("page_id < 3")
    nodes = sem_nodes(pages, plans.GOAL).select("page_id", "node_id", "parent_id", "role", "label")
    loose = spark.createDataFrame([(-1, 5, 4, "text", "no parent here"), (-1, 6, 5, "link", "a child")], nodes.schema)
    nodes = nodes.unionAll(loose)
    rows, want = {}, {}
    for r in nodes.collect():
        rows.setdefault(r["page_id"], {})[r["node_id"]] = r
    for page, held in rows.items():
        want |= {(page, n): v for n, v in recursion(held).items()}
    found = ops.tree_vectors(nodes).collect()
    assert {(r["page_id"], r["node_id"]): as_int(r["hv"]) for r in found} == want and len(found) == len(want)
    assert {(r["node_id"], r["level"]) for r in found if r["page_id"] == -1} == {(5, 0), (6, 1)}
    assert ops.tree_vectors(nodes.limit(0)).count() == 0


def test_pruning_follows_role_and_level(spark):
    kept = {(r["page_id"], r["node_id"]): r for r in plans.hv_pruned(spark, SF).collect()}
    nodes = {(r["page_id"], r["node_id"]): r for r in sem_nodes(spark.read.parquet(f"{SF}/pages.parquet"), plans.GOAL).collect()}
    for r in plans.hv_tree(spark, SF).collect():
        role, key = nodes[r["page_id"], r["node_id"]]["role"], (r["page_id"], r["node_id"])
        least = -1 if r["level"] <= 1 or role in hv.PASSING else 0.1 if role in hv.STRICT else 0.08 if role == "generic" and r["level"] >= 3 else 0.05
        assert (key in kept) == (r["likeness"] >= least)
    assert 0 < len(kept) < len(nodes)


def test_likeness_of_trees_equals_a_recursion(spark):
    """Made page by page where the tree builder leaves the nodes: nothing is shuffled, or written on the way."""
    nodes = sem_nodes(spark.read.parquet(f"{SF}/pages.parquet").filter("page_id < 3"), plans.GOAL)
    found = ops.tree_likeness(nodes.select("page_id", "node_id", "parent_id", "role", "label"), hv.text_vectors(pa.array([["read", "the", "news"]]))[:, 0].view("int64").tolist())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "heddle/" not in plan and plan.count("Scan parquet") == 1
    goal, rows = plain_vector("read the news"), {}
    like = lambda v: 1.0 - 2.0 * (v ^ goal).bit_count() / 2048
    for r in found.collect():
        rows.setdefault(r["page_id"], {})[r["node_id"]] = r
    for held in rows.values():
        whole, inner = recursion(held), {r["parent_id"] for r in held.values()}
        for n, r in held.items():
            assert (r["likeness"], r["text_likeness"], r["leaf"]) == (like(whole[n]), like(plain_vector(r["label"])), n not in inner)
    assert len(rows) == 3


def test_batches_cut_pages_nowhere(spark, monkeypatch):
    """Pages that span batches, and one that follows itself, are made whole."""
    rows = [(page, n, n - 1 if n else None, "text", f"label {n % 5} of") for page in (1, 2, 2, 3) for n in range(7)]
    frame = spark.createDataFrame(rows, "page_id long, node_id long, parent_id long, role string, label string").coalesce(1)
    goal = list(range(32))
    want = [tuple(r) for r in ops.tree_likeness(frame, goal).collect()]
    assert [r[:2] for r in want] == [r[:2] for r in rows] and want[7:14] == want[14:21]
    assert [r[5] for r in want] == [*range(7)] * 4  # levels
    monkeypatch.setattr(ops, "ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert [tuple(r) for r in ops.tree_likeness(frame, goal).collect()] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ops.tree_likeness(frame.limit(0), goal).count() == 0


@pytest.mark.parametrize("texts", [1024, 2])
def test_tallies_equal_the_plain_version(monkeypatch, texts):
    monkeypatch.setattr(hv, "TEXTS", texts)
    lists = [[w for w in re.split(r"[\W_]+", t.lower()) if len(w.encode()) > 1] or [t] for t in [*TEXTS, "ab cd " * 400]]
    got = hv.text_vectors(pa.array(lists, pa.list_(pa.string())))
    assert [as_int(v) for v in got.T.tolist()] == [plain_vector(t) for t in [*TEXTS, "ab cd " * 400]]
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 8, 300):
        rows = rng.integers(0, 1 << 63, (n, 32), np.uint64) | rng.integers(0, 2, (n, 32), np.uint64) << np.uint64(63)
        tally = hv.Tally(1)
        for r in rows:
            tally.add(r[:, None])
        assert as_int(tally.majority(np.array([n]))[:, 0].tolist()) == plain_bundle([as_int(r.tolist()) for r in rows])


def test_word_lists_equal_vector_words(spark):
    odd = [*TEXTS, "ÀB—cd", "İstanbul ΣΑΣ", "कि ख्य x", "Ⅷ ½ ①②", " lead and trail ", "__a__bb"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", hv.vector_words(F.col("t")).alias("w"), hv.spaced_words(F.col("t")).alias("s")).toArrow()
    got = hv.word_lists(rows["s"].combine_chunks(), rows["t"].combine_chunks())
    assert got.to_pylist() == rows["w"].to_pylist() and len(got) == len(odd)


def test_plain_tags_are_read_as_by_the_tolerant_reader(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    pages = [r["html"] for r in rows] + [
        '<DIV Class="A" CLASS="b">x</DIV >y', "<title>a<b>c</title>d", "<script>if(a<b){'</b>'}</script><p>x", "<textarea><b>x</b></textarea>y",
        '<a href="x&amp;y">z', '<p a="1"b="2">q', '<p a="">e', '<br/><p\n x="1">', "</p x><p a='1'>", '<p a="<">', "<!-- <p> --><p>", "a & b < c <p",
    ]
    got, shown = [html_dom.page_rows(1, h) for h in pages], [html_dom.page_rows(1, h, paths=False) for h in pages]
    monkeypatch.setattr(html_dom, "PLAIN", re.compile("(?!)"))
    monkeypatch.setattr(html_dom, "PLAIN_END", re.compile("(?!)"))
    assert got == [html_dom.page_rows(1, h) for h in pages]
    assert shown == [[(*r[:8], False, None) for r in page if r[5] is not None and not r[8]] for page in got]
