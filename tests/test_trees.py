"""Tree queries against plain recursion, and golden rows of forms and extraction."""

from heddle.plans import forms, trees
from heddle.sources import html_dom
from tests.conftest import SF


def page_trees(spark):
    pages = {}
    for r in html_dom.sem_nodes(spark.read.parquet(f"{SF}/pages.parquet"), trees.GOAL).collect():
        pages.setdefault(r["page_id"], {})[r["node_id"]] = r
    for nodes in pages.values():
        below = {n: [] for n in nodes}
        for n in sorted(nodes, reverse=True):
            up = nodes[n]["parent_id"]
            if up in nodes:
                below[up].append(n)
        yield nodes, below


def test_scores_and_pruning_by_recursion(spark):
    scores, kept = {}, {}
    for nodes, below in page_trees(spark):
        best, strong = {}, {}
        for n in sorted(nodes, reverse=True):  # children have larger ids
            r = nodes[n]
            best[n] = max([r["relevance"], *(0.75 * best[c] for c in below[n])])
            firm = r["action"] or r["role"] in ("heading", "link", "price", "cta", "product_card")
            strong[n] = max([2.0 if firm else r["relevance"], *(strong[c] for c in below[n])])
        for n, r in nodes.items():
            boost = 1.15 if r["role"] == "link" and not below[n] and 30 <= len(r["label"].encode()) <= 200 else 1
            scores[r["page_id"], n] = min(1.0, best[n] * boost)
        steps = [0.02, *(0.2 + 0.05 * i for i in range(12))]
        at = next((t for t in steps if sum(s >= t for s in strong.values()) <= 300), steps[-1])
        kept |= {(r["page_id"], n): at for n, r in nodes.items() if strong[n] >= at}
    got = {(r["page_id"], r["node_id"]): r["score"] for r in trees.bottom_up_score(spark, SF).collect()}
    assert got.keys() == scores.keys() and max(abs(got[k] - scores[k]) for k in got) < 1e-5
    assert {(r["page_id"], r["node_id"]) for r in trees.pruned_tree(spark, SF).collect()} == set(kept)
    few = {(r["page_id"], r["node_id"]) for r in trees.pruned_tree(spark, SF, most=20).collect()}
    assert few < set(kept)


def test_children_kept(spark):
    want = {}
    for nodes, below in page_trees(spark):
        for n, r in nodes.items():
            if r["parent_id"] is not None:
                firm = r["action"] or r["role"] in ("heading", "link", "price", "cta", "product_card")
                stays = bool(r["relevance"] > 0.15 or firm or below[n])
                pair = want.setdefault((r["page_id"], r["parent_id"]), [0, 0])
                pair[not stays] += 1
    got = {(r["page_id"], r["parent_id"]): [r["kept"], r["dropped"]] for r in trees.kept_children(spark, SF).collect()}
    assert got == want


def test_form_fields_of_the_planted_form(spark):
    got = {r["key"]: (r["node_id"], r["confidence"], r["selector"]) for r in forms.form_fields(spark, SF).filter("page_id = -1").collect()}
    assert got == {
        "email": (1, 1.0, "input[aria-label='Email address']"),
        "first name": (2, 1.0, "input[aria-label='First name']"),
        "password": (3, 1.0, "input[name='password']"),
        "zip": (None, None, None),  # its field is disabled
        "agree": (6, 1.0, "input[aria-label='I agree to the terms']"),
    }


def test_extraction_from_the_planted_page(spark):
    got = {r["key"]: (r["value"], r["source_id"]) for r in forms.extract_data(spark, SF).filter("page_id = -2").collect()}
    assert got == {
        "story_title": ("Story of a title", 1),
        "url": ("https://a.org/url", 2),
        "price": ("$ 9.90", 3),
        "version": ("1.15.0", 4),
        "released": ("May 2024", 7),
    }
