"""The language model: true probabilities, the same whatever the partitions, and its values on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import lm
from tests.conftest import SF
from tests.llm.test_operators import ODD, SHAPE


def scored(table, learn):
    spark = table.sparkSession
    counts = lm.materialise(spark, lm.count_tokens(learn), "counts")
    vocab = lm.vocabulary(counts)
    model = lm.train(learn, vocab)
    return lm.score(table, counts, vocab, model).collect(), vocab, model


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_scores_do_not_depend_on_partitions(docs):
    one, seven = (scored(t, t)[0] for t in (docs.coalesce(1), docs.repartition(7)))
    want = {r["doc_id"]: r["score"] / r["n_tokens"] for r in one}
    assert {r["doc_id"] for r in seven} == set(want)
    assert max(abs(r["score"] / r["n_tokens"] - want[r["doc_id"]]) for r in seven) < 1e-6


def test_scores_are_probabilities_by_a_plain_version(spark, docs):
    learn = docs.filter("doc_id % 2 = 0")
    _, vocab, model = scored(learn.limit(1), learn)
    u1, u2, r, b = (x.astype(np.float64) for x in model)
    rng = np.random.default_rng(0)
    for h1, h2 in rng.integers(0, lm.CLASSES + 1, (5, 2)):
        s = (u1[h1] + u2[h2]) @ r.T + b
        p = np.exp(s - s.max())
        p /= p.sum()
        # over all seen words, and what is left for unseen ones
        words = {w: n for w, n in zip(vocab.words, vocab.counts.tolist(), strict=True)}
        outcome = {w: i if i < lm.OWN else lm.bucket_of(w) for i, w in enumerate(vocab.words)}
        known = sum(p[outcome[w]] * (1.0 if outcome[w] < lm.OWN else (n + 0.5) / vocab.mass[outcome[w]]) for w, n in words.items())
        unseen = sum(p[k] * 0.5 / vocab.mass[k] for k in range(lm.OWN, lm.CLASSES))
        assert len(words) == vocab.distinct and known + unseen == pytest.approx(1, abs=1e-6)
    texts = ["the river and the stone", "", "of unseenwordhere the"]
    counts = spark.createDataFrame([(w, n) for w, n in words.items()], "word binary, n long")
    rows = lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), counts, vocab, model).collect()
    for row in rows:
        total, one, two = 0.0, lm.START, lm.START
        for w in [*texts[row["doc_id"]].encode().split(), b""]:
            o = outcome.get(w, lm.bucket_of(w))
            s = (u1[one] + u2[two]) @ r.T + b
            total += (s[o] - s.max() - np.log(np.exp(s - s.max()).sum())) / np.log(10)
            total += 0 if o < lm.OWN else np.log10((words.get(w, 0) + 0.5) / vocab.mass[o])
            one, two = o, one
        assert row["score"] == pytest.approx(total, abs=1e-4)


def test_values_of_odd_rows(spark, docs):
    odd = spark.createDataFrame(ODD, SHAPE)
    rows, vocab, _ = scored(odd, odd)
    got = {r["doc_id"]: r for r in rows}
    assert {d: r["n_tokens"] for d, r in got.items()} == {1: 1, 2: 1, 3: 9, 4: 30_004, 5: 1}
    assert got[1]["score"] == got[2]["score"] == got[5]["score"] and got[4]["n_known"] == 30_004
    assert sum(r["doc_id"] == 3 for r in rows) == 2
    none = odd.limit(0)
    rows, vocab, _ = scored(odd, none)
    assert (vocab.total, vocab.distinct) == (0, 0) and all(np.isfinite(r["score"]) and r["n_known"] == 0 for r in rows)
    assert scored(none, odd)[0] == []


def test_the_model_beats_the_base_on_held_out_texts(spark):
    out = lm.op4_log_bilinear(spark, SF.replace("0.001", "0.01")).filter("held_out")
    base, score, n = out.agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    print("per token", base / n, score / n)
    assert (score - base) / n > 0.05
