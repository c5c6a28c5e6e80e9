"""Late interaction against full precision, the staged ranking against a plain version."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.functions import interaction as fn
from heddle.functions.text import TREE_PRIORITY
from heddle.operators import staged as ops
from heddle.plans import hypervectors, interaction
from heddle.sources.tables import written
from tests.conftest import SF
from tests.test_hypervectors import plain_seed


def plain_unit(word):
    """The vector of a word, in full precision."""
    m = f"<{word}>"
    total = [0] * 64
    for k in range(max(1, len(m) - 2)):
        h = plain_seed(m[k : k + 3]) & (1 << 64) - 1
        total = [t + (1 if h >> j & 1 else -1) for j, t in enumerate(total)]
    norm = math.sqrt(sum(t * t for t in total)) or 1.0
    return [t / norm for t in total]


def plain_score(words, goal, quantised=True):
    if not words or not goal:
        return 0.0
    number = lambda w: [math.floor((x + 1.0) * 127.5) if quantised else x for x in plain_unit(w)]
    own = [number(w) for w in words]
    return sum(max(sum(a * b for a, b in zip(number(g), d, strict=True)) for d in own) for g in goal) / len(goal)


LISTS = [["river", "stone", "rivers"], [], ["a"], ["日本", "été", "stone"], ["x" * 40], ["market", "price", "of", "green", "tea"]]


@pytest.mark.parametrize("chunk", [1 << 17, 2])
def test_scores_equal_a_plain_version(spark, monkeypatch, chunk):
    monkeypatch.setattr(fn, "CHUNK", chunk)
    goals = [["river", "bridge"], ["tea"], []]
    rows = [(w, g) for w in LISTS for g in goals]
    got = fn.best_sums(pa.array([w for w, _ in rows], pa.list_(pa.string())), pa.array([g for _, g in rows], pa.list_(pa.string())))
    assert got.tolist() == [plain_score(w, g) for w, g in rows]
    frame = spark.createDataFrame(rows, "w array<string>, g array<string>")
    assert [r[0] for r in frame.select(fn.late_interaction(F.col("w"), F.col("g"))).collect()] == got.tolist()


def test_eight_bits_keep_the_order():
    """sum(a b) / 127.5 ** 2 - sum(a + b) / 127.5 + 64 is the inner product, but for rounding of a step in each of 64 components."""
    exact = [plain_score(w, ["river", "stone"], quantised=False) for w in LISTS if w]
    coarse = [plain_score(w, ["river", "stone"]) for w in LISTS if w]
    assert np.argmax(exact) == np.argmax(coarse)
    for a, b in (("river", "rivers"), ("stone", "market")):
        x, y = (np.array([math.floor((v + 1.0) * 127.5) for v in plain_unit(w)]) for w in (a, b))
        back = (x * y).sum() / 127.5**2 - (x + y).sum() / 127.5 + 64
        assert back == pytest.approx(np.dot(plain_unit(a), plain_unit(b)), abs=64 * 2 / 127.5)


LABELS = [
    ("", "text"), ("i18n.key", "text"), ("{{x}}", "text"), ("jsonLd.item.image: x", "text"), ("a[0].photo", "data"), ("og:image x", "text"),
    ("see https://a.b/c.png", "data"), ("see https://a.b/c.png", "text"), ("props.a b", "data"), ("app.fooBar.baz", "text"), ("12,5", "text"),
    ("The price is 12 of them", "text"), ("1.2.3x", "text"),
]


def test_labels_without_content(spark):
    got = spark.createDataFrame(LABELS, "label string, role string").select(fn.no_content(F.col("label"), F.col("role"))).collect()
    assert [r[0] for r in got] == [True, True, True, True, True, True, True, False, True, True, True, False, False]


def test_factors(spark):
    long = "word " * 50
    rows = [
        ("navigation", "a", False, 0.20, 0.0, 1.0), ("navigation", "a", True, 0.5, 0.0, 1.0), ("link", "[1]", True, 0.2, 0.0, 1.0),
        ("link", "short", True, 0.5, 0.0, 1.0), ("link", "a link that is longer than thirty", True, 0.7, 0.0, 1.0), ("generic", long, False, 0.6, 0.20, 0.65),
        ("listitem", "Step 1", True, 0.3, 0.0, 1.0), ("text", "has 12 numbers", True, 1.05, 0.0, 1.0), ("text", "nothing here", True, 0.95, 0.0, 1.0),
        ("heading", long, True, 0.95, 0.0, 1.0), ("cell", long * 3, True, 1.10, 0.15, 0.85), ("main", "m", False, 0.7, 0.0, 1.0),
    ]
    frame = spark.createDataFrame([r[:3] for r in rows], "role string, label string, leaf boolean")
    role, label, leaf = (F.col(c) for c in ("role", "label", "leaf"))
    got = frame.select(fn.role_factor(role, label, leaf), fn.wrapper_loss(role, label), fn.length_factor(label, leaf)).collect()
    assert [tuple(r) for r in got] == [r[3:] for r in rows]


def greedy(labels):
    kept, out = [], []
    for i, label in enumerate(labels):
        key = label[:120].strip()
        if len(key.encode()) >= 4:
            words = key.split()
            if any(p in key or key in p for p in kept):
                continue
            if len(words) >= 4 and any(sum(w in p for w in words) / len(words) > 0.7 for p in kept):
                continue
            kept.append(key)
        out.append(i)
    return out


def test_containment_in_rank_order(spark):
    rng = np.random.default_rng(0)
    pool = ["Fact box Group 11", "Group 11", "abc", "abc", "", "one two three four five", "five four three two nine"]
    lists = [pool, [], *[[" ".join(f"w{x}" for x in rng.integers(0, 25, rng.integers(1, 6))) for _ in range(150)] for _ in range(3)]]
    rows = [(k, [(i, label) for i, label in enumerate(labels)]) for k, labels in enumerate(lists)]
    frame = spark.createDataFrame(rows, "k int, items array<struct<i: int, label: string>>")
    got = {r["k"]: [x["i"] for x in r["kept"]] for r in frame.select("k", ops.contained(F.col("items")).alias("kept")).collect()}
    assert got == {k: greedy(labels) for k, labels in enumerate(lists)}


def test_bm25_within_a_page(spark):
    rows = [(1, 0, "read news today"), (1, 1, "news news"), (1, 2, ""), (1, 3, "other words"), (2, 0, "read"), (2, 1, "nothing at all")]
    frame = spark.createDataFrame(rows, "page_id long, node_id long, label string")
    got = {(r["page_id"], r["node_id"]): r["bm25"] for r in ops.bm25_within(frame, "read the news").collect()}
    toks = {k: [w for w in label.split() if len(w) > 2 and w not in ("the", "all")] for *k, label in rows for k in [tuple(k)]}
    for page in (1, 2):
        own = {k: t for k, t in toks.items() if k[0] == page}
        mean = np.mean([len(t) for t in own.values() if t])
        for k, t in own.items():
            want = 0.0
            for term in ("read", "news"):
                df, tf = sum(term in x for x in own.values()), t.count(term)
                if tf:
                    want += math.log((len(own) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
            assert got[k] == pytest.approx(want, abs=1e-8)


def test_expansion_takes_rare_long_words(spark):
    rows = [(1, i, 9.0 - i, label) for i, label in enumerate(["read Market prices", "market garden 1234", "x.y abcd", "market", "tiny", "unseen words"])]
    frame = spark.createDataFrame(rows, "page_id long, node_id long, bm25 double, label string")
    assert [r["more"] for r in ops.expansions(frame, "read prices").collect()] == [["abcd", "garden", "tiny", "market"]]


def test_staged_ranking_equals_a_plain_version(spark):
    nodes = written(hypervectors.trees(spark, SF).filter("page_id < 12"), "some")
    goal = interaction.GOAL
    bm25 = {(r["page_id"], r["node_id"]): r["bm25"] for r in ops.bm25_within(nodes, goal).collect()}
    got, pages = {}, {}
    for r in ops.staged(nodes, goal).orderBy("page_id", "rank").collect():
        got.setdefault(r["page_id"], []).append((r["node_id"], r["score"]))
    for r in nodes.collect():
        pages.setdefault(r["page_id"], []).append(r)
    flags = nodes.select("page_id", "node_id", fn.no_content(F.col("label"), F.col("role")).alias("no"))
    for leaf in (True, False):
        flags = flags.join(nodes.select("page_id", "node_id", fn.role_factor(F.col("role"), F.col("label"), F.lit(leaf)).alias(f"f{leaf}"),
            fn.length_factor(F.col("label"), F.lit(leaf)).alias(f"l{leaf}"), fn.wrapper_loss(F.col("role"), F.col("label")).alias(f"w{leaf}")), ["page_id", "node_id"])
    flags = {(r["page_id"], r["node_id"]): r for r in flags.collect()}
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    seen = 0
    for page, rows in pages.items():
        key = lambda r: (page, r["node_id"])
        hit = any(bm25[key(r)] > 0 for r in rows)
        first = sorted((r for r in rows if not hit or bm25[key(r)] > 0), key=lambda r: (-(bm25[key(r)] if hit else r["likeness"]), r["node_id"]))[:300]

        def least(r):
            if r["level"] <= 1 or r["role"] in ("text", "paragraph", "heading", "link", "button", "cta"):
                return -1
            return 0.1 if r["role"] in ("navigation", "complementary") else 0.08 if r["role"] == "generic" and r["level"] >= 3 else 0.05

        alive = [r for r in first if not hit or r["likeness"] >= least(r)]
        top = sorted(alive, key=lambda r: (-bm25[key(r)], r["node_id"]))[:5]
        long = [w for r in top for w in r["label"].lower().split() if len(w.encode()) >= 4 and not re.search(r"^[0-9]+$|://|\.", w)]
        more = sorted((w for w in set(long) if w not in goal.lower().split()), key=lambda w: (long.count(w), w))[:4]
        raw = {r["node_id"]: plain_score(words(r["label"]), words(" ".join([goal, *more]).strip())) for r in alive}
        s = sorted(raw.values())
        if not s:
            assert page not in got
            continue
        m, iqr = s[len(s) // 2], s[len(s) * 3 // 4] - s[len(s) // 4]
        norm = {n: 0.5 if len(s) == 1 else 1 / (1 + math.exp(-2 * (x - m) / (iqr if iqr > 1e-9 else 1.0))) for n, x in raw.items()}
        inner = {r["parent_id"] for r in rows}
        own, parent = {}, {}
        for r in alive:
            f, leaf = flags[key(r)], r["node_id"] not in inner
            if f["no"]:
                continue
            x = norm[r["node_id"]] * 0.4 + (r["text_likeness"] + 1) / 2 * 0.15 + TREE_PRIORITY.get(r["role"], 0.2) * 0.15 + min(bm25[key(r)] / 3, 1) * 0.3
            own[r["node_id"]] = min(1.0, max(0.0, (x - f[f"w{leaf}"]) * f[f"f{leaf}"] * f[f"l{leaf}"]))
            parent[r["node_id"]] = (r["parent_id"], leaf, r)
        score = {}
        for n, (_, leaf, r) in parent.items():
            best = max([own[c] for c, (p, c_leaf, _) in parent.items() if p == n and c_leaf], default=0.0)
            story = leaf and r["role"] == "link" and 30 <= len(r["label"].encode()) <= 200
            score[n] = round(min(1.0, max(own[n], best * 0.75) * (1.15 if story else 1)), 6)
        order = sorted((n for n in score if score[n] > 0), key=lambda n: (-score[n], n))
        want = [order[i] for i in greedy([parent[n][2]["label"] for n in order])]
        assert [n for n, _ in got.get(page, [])] == want, page
        assert all(abs(score[n] - x) < 2e-6 for n, x in got.get(page, []))
        seen += len(want)
    assert seen > 20


def test_blended_nodes_shuffle_no_labels(spark):
    """One exchange, by page, of rows without labels; the page's values are on no row; nothing is written on the way."""
    found = interaction.blended_nodes(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    dealt = [x for x in plan if " Exchange " in f" {x.lstrip(' :+-*')} "]
    assert len(dealt) == 1 and not any("collect_list" in x or "heddle/" in x for x in plan)
    assert not any("label" in x for x in plan[: plan.index(dealt[0])])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8])
def test_quartiles_are_those_of_the_sorted_values(spark, n):
    rng = np.random.default_rng(n)
    values = [float(x) for x in rng.integers(0, 9, n)]
    got = ops.normalised(spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "page_id long, node_id long, _raw double")).collect()
    s = sorted(values)
    m, iqr = s[n // 2], s[n * 3 // 4] - s[n // 4]
    assert len(got) == n and got[0].asDict().keys() == {"page_id", "node_id", "_raw", "interaction"}
    for r in got:
        want = 0.5 if n == 1 else 1 / (1 + math.exp(-2 * (r["_raw"] - m) / (iqr if iqr > 1e-9 else 1.0)))
        assert r["interaction"] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("block", [1 << 11, 2])
def test_word_vectors_in_blocks(monkeypatch, block):
    monkeypatch.setattr(fn, "BLOCK", block)
    words = ["river", "a", "", "日本", "x" * 300, "stones", "river"]
    assert fn.word_vectors(words).tolist() == [[math.floor((x + 1.0) * 127.5) for x in plain_unit(w)] for w in words]


def test_staged_nodes_move_by_page_only(spark):
    """Pages are read once and their rows meet by page, twice; no join, nothing written on the way."""
    plan = interaction.staged_nodes(spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if x.lstrip(" :+-*").startswith("Exchange")]
    assert len(dealt) == 2 and all("hashpartitioning(page_id" in x for x in dealt)
    assert "Join" not in plan and "heddle/" not in plan and plan.count("Scan parquet") == 1


def test_best_children_and_leaves(spark):
    rows = [(1, 0, None, "r", 0.1), (1, 1, 0, "a", 0.5), (1, 2, 0, "b", 0.7), (1, 3, 2, "c", 0.2), (1, 4, 9, "d", 0.9), (2, 0, None, "e", 0.3), (2, 1, 0, "f", 0.4)]
    frame = ops.with_leaves(spark.createDataFrame(rows, "page_id long, node_id long, parent_id long, label string, own double"))
    got = sorted((r["page_id"], r["node_id"], r["label"], r["leaf"], r["own"], r["_child"]) for r in ops.best_children(frame).collect())
    inner = {(p, up) for p, _, up, _, _ in rows}
    best = lambda p, n: max((own for q, m, up, _, own in rows if (q, up) == (p, n) and (q, m) not in inner), default=None)
    assert got == [(p, n, label, (p, n) not in inner, own, best(p, n)) for p, n, _, label, own in rows]
