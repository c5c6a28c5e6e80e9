"""Delta-maintained codebooks against SQL and a plain loop that sums everything in every round."""

import hashlib

import duckdb
import numpy as np
import pytest

from heddle.llm import vector_codes as vc
from tests.conftest import SF


def plain(rows, parts, entries, rounds):
    """{row: (code, error)} and the codebooks, all sums made anew in every round; rows are (id, integers)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in rows], object).reshape(len(rows), parts, -1)
    books = [[list(x[i, p]) for i in range(min(entries, len(rows)))] for p in range(parts)]
    near = lambda v, book: min(((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(book)))  # noqa: E731, B905
    for _ in range(rounds):
        for p in range(parts):
            picks = [near(x[i, p], books[p])[1] for i in range(len(rows))]
            for e in set(picks):
                own = [x[i, p] for i, k in enumerate(picks) if k == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]  # noqa: B905
    found = [[near(x[i, p], books[p]) for p in range(parts)] for i in range(len(rows))]
    return [(r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for r, f in zip(rows, found, strict=True)], books


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(vc.OP12_SQL).fetchall()
    names = [c[0] for c in con.description]
    got = vc.op12_delta_lloyd(spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) > 100


@pytest.mark.parametrize("block", [8192, 7])
def test_rounds_equal_a_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(vc, "BLOCK", block)
    rng = np.random.default_rng(3)
    vectors = [(int(i), (rng.normal(size=6) * 3).tolist()) for i in rng.permutation(90)]
    vectors += [(5, vectors[0][1])] * 20 + [(None, [0.5] * 6), (4, [-1.25] * 6), (4, [1.0] * 6)]
    odd = [(1, None), (2, [float("nan")] * 6), (3, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (6, [float("-inf")] * 6), (7, [1.0, 2.0]), (8, []), (9, [1.0] * 5)]
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in vectors + odd], "vec_id long, embedding array<float>, code string, block int")
    got, books = vc.compress(frame.repartition(3), parts=3, entries=8, rounds=4)
    ints = [(a, np.floor(1024 * np.array(b, np.float32).astype(float)).astype(int).tolist()) for a, b in vectors]
    want, plain_books = plain(ints, 3, 8, 4)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got.select("vec_id", "code", "error").collect()), key=key) == sorted(want, key=key)
    assert books.tolist() == plain_books


def test_only_changes_move_and_nothing_else_is_shuffled(spark):
    kept, d = vc.integers(spark.read.parquet(f"{SF}/embeddings.parquet"))
    state = vc.DeltaLloyd(kept, d)
    state.round()
    first = state.books.copy()
    old = {r["block"]: np.frombuffer(r["codes"], np.uint8) for r in spark.table(state.codes).collect()}
    plan = state.held()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" in plan
    assert state.round()
    new = {r["block"]: r for r in spark.table(state.codes).collect()}
    moved = sum(int((np.frombuffer(new[b]["codes"], np.uint8) != old[b]).sum()) for b in old)
    shuffled = [c for r in new.values() for c in r["changes"]]
    assert 0 < moved < sum(map(len, old.values())) and sum(c["n"] for c in shuffled) == 0
    assert 0 < len(shuffled) <= 2 * moved and (state.books != first).any()
    for _ in range(60):
        if not state.round():
            break
    assert not state.round()  # settled: no change, no shuffle
    state.drop()
    assert not spark.catalog.tableExists(state.blocks)


def test_large_components_stay_exact():
    x = np.array([[1 << 27, -(1 << 27)], [3, 4]])
    book = np.array([[(1 << 27) + 1, -(1 << 27)], [1 << 27, -(1 << 27)], [3, 4], [3, 4]])
    pick, far = vc.nearest(x, book)
    assert pick.tolist() == [1, 2] and far.tolist() == [0, 0]
    with pytest.raises(ValueError):
        vc.nearest(np.array([[1 << 40]]), book[:, :1])


def test_empty_table_and_labels(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    got, books = vc.compress(none, more=("label",))
    assert got.count() == 0 and got.columns == ["vec_id", "label", "code", "error"] and books.size == 0
    rows = [(i, [float(i % 3), float(i % 5), 0.0, 1.0], None if i % 2 else 0) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    out = vc.op12_delta_lloyd(spark, str(tmp_path)).collect()
    error = {r["vec_id"]: r["error"] for r in out}
    for r in out:
        assert r["label_error"] == sum(e for i, e in error.items() if i % 2 == r["vec_id"] % 2)
    assert len(out) == 300 and len({r["codebooks_sha256"] for r in out}) == 1


def test_digest_of_codebooks(spark):
    _, books = vc.compress(spark.read.parquet(f"{SF}/embeddings.parquet"))
    want = hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()
    assert vc.op12_delta_lloyd(spark, SF).first()["codebooks_sha256"] == want
