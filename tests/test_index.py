"""An index after changes against one built anew."""

import random

from heddle.operators.index import TextIndex
from heddle.operators.retrieval import bm25

WORDS = "alpha beta gamma delta epsilon zeta".split()


def test_changes_equal_a_rebuild(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choices(WORDS, k=rng.randint(0, 8))) if rng.random() < 0.9 else None
    queries = spark.createDataFrame([(1, "alpha beta beta"), (2, "zeta"), (3, "unknown"), (4, "")], "item_id long, text string")
    index, state = TextIndex(spark), {}
    key = lambda rows: sorted(tuple(r) for r in rows)
    for turn in range(4):
        changed = {rng.randint(0, 30): text() for _ in range(15)}
        removed = {rng.randint(0, 35) for _ in range(4 if turn else 0)}
        index.apply(spark.createDataFrame(list(changed.items()), "id long, text string"), spark.createDataFrame([(i,) for i in removed], "id long"))
        state = {k: v for k, v in (state | changed).items() if k not in removed}
        if turn == 2:
            index.compact()
            assert len(index.generations) == 1
        docs = spark.createDataFrame([(k, v) for k, v in state.items()], "doc_id long, text string")
        assert key(index.search(queries, 5).collect()) == key(bm25(docs, queries, 5).collect())
        total, _ = index.stats().first()
        assert total == len(state)
        assert {r["id"] for r in index.live("docs").collect()} == set(state)
    assert TextIndex(spark).search(queries, 5).count() == 0


def test_an_id_that_stands_twice(spark):
    index = TextIndex(spark)
    index.apply(spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "alpha")], "id long, text string"))
    index.apply(spark.createDataFrame([(2, "gamma")], "id long, text string"), spark.createDataFrame([(2,), (9,)], "id long"))
    asked = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert [(r["id"]) for r in index.search(asked, 5).collect()] == [1]
    assert {r["term"]: r["df"] for r in index._all("terms").groupBy("term").sum("df").withColumnRenamed("sum(df)", "df").collect() if r["df"]} == {"beta": 1}
