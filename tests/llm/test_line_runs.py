"""The levelled runs: new keys and updates by merge anti-joins, where the runs' side is never shuffled."""

import pytest

from heddle.llm import line_dedup
from tests.llm.test_operators import ODD, SHAPE, brute_lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, first, n):
    return spark.createDataFrame([(i, f"common\nline {i // 2}\nonly {i}") for i in range(first, first + n)], "doc_id long, text string")


def test_a_batch_adds_new_keys_and_updates(spark):
    runs = line_dedup.LineRuns(spark, fanout=9)
    runs.add(rows(spark, 0, 4))
    runs.add(rows(spark, 3, 4))
    first, new, update = (spark.table(n).collect() for n in runs.names())
    assert (len(first), len(new), len(update)) == (7, 5, 3)  # known by then: common, line 1, only 3
    assert {(r["h1"], r["h2"]) for r in new}.isdisjoint((r["h1"], r["h2"]) for r in first)
    assert sorted(r["docs"] for r in update) == [1, 1, 4]
    whole = line_dedup.batch_counts(rows(spark, 0, 4).unionAll(rows(spark, 3, 4)), 1).collect()
    assert {(r["h1"], r["h2"], r["docs"]) for r in runs.totals().collect()} == {(r["h1"], r["h2"], r["docs"]) for r in whole}


def test_runs_are_merged_where_they_lie(spark):
    runs = line_dedup.LineRuns(spark, fanout=3)
    runs.add(rows(spark, 0, 6))
    batch = spark.table(runs._table(line_dedup.batch_counts(rows(spark, 4, 6), 1), "batch"))
    joined = plan(runs.new_keys(batch))
    assert "SortMergeJoin" in joined and "LeftAnti" in joined and "Exchange" not in joined
    for i in range(4):
        runs.add(rows(spark, 5 * i, 7))
    assert len(runs.levels) > 1 and all(len(level) < 3 for level in runs.levels)
    asked = []
    write = runs._table
    runs._table = lambda rows, label: asked.append(plan(rows)) or write(rows, label)
    runs._merge(runs.names(), "all")
    assert asked and all("SortMergeJoin" in p and "FullOuter" in p and "Exchange" not in p for p in asked)


def test_a_table_of_files_is_read_batch_by_batch(spark, tmp_path):
    rows(spark, 0, 60).repartition(12).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    parts = [{r["doc_id"] for r in p.collect()} for p in line_dedup.doubling(docs, 4)]
    assert sum(map(len, parts)) == 60 and set.union(*parts) == set(range(60)) and sum(map(bool, parts)) > 1
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs, min_docs=2, batches=4).collect()}
    assert got == {i: f"only {i}" for i in range(60)}


@pytest.mark.parametrize("files", [1, 40])
def test_no_batch_is_empty_and_a_level_is_compacted(spark, tmp_path, monkeypatch, files):
    rows(spark, 0, 80).repartition(files).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    parts = [{r["doc_id"] for r in p.collect()} for p in line_dedup.doubling(docs, 4)]
    assert all(parts) and sum(map(len, parts)) == 80 and set.union(*parts) == set(range(80))
    merged, joined = [], []
    merge, anti = line_dedup.LineRuns._merge, line_dedup.LineRuns.new_keys
    monkeypatch.setattr(line_dedup.LineRuns, "_merge", lambda self, runs, label: merged.append(label) or merge(self, runs, label))
    monkeypatch.setattr(line_dedup.LineRuns, "new_keys", lambda self, counts: joined.append(len(self.names())) or anti(self, counts))
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs, min_docs=2).collect()}
    assert got == {i: f"only {i}" for i in range(80)}
    assert merged == ["level1", "totals"] and len(joined) == 3


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SHAPE)
    got = sorted(((r["doc_id"], r["text"], r["word"]) for r in line_dedup.line_dedup(odd, min_docs=2, more=("word",)).collect()), key=repr)
    want = [(r[0], "\n".join(t), r[5]) for r, t in zip(ODD, brute_lines([r[1] or "" for r in ODD], 2), strict=True)]
    assert got == sorted(want, key=repr)
