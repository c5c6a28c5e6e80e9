"""Training steps against a plain version, and texts that are coded once for training and scores."""

import numpy as np

from heddle.llm import lm
from tests.conftest import SF


def plain_step(u1, u2, r, b, past, log_noise, noise, one, two, outcome, rate=0.1):
    """The same step over all parameters, in double precision."""
    n = len(outcome)
    q = u1[one] + u2[two]
    good = (q * r[outcome]).sum(axis=1) + b[outcome] - log_noise[outcome]
    bad = q @ r[noise].T + b[noise] - log_noise[noise]
    up, down = -1 / (1 + np.exp(good)) / n, 1 / (1 + np.exp(-bad)) / n
    grads = [np.zeros_like(x) for x in (u1, u2, r, b)]
    gq = up[:, None] * r[outcome] + down @ r[noise]
    np.add.at(grads[0], one, gq)
    np.add.at(grads[1], two, gq)
    np.add.at(grads[2], outcome, up[:, None] * q)
    np.add.at(grads[2], noise, down.T @ q)
    np.add.at(grads[3], outcome, up)
    np.add.at(grads[3], noise, down.sum(axis=0))
    for p, g, s in zip((u1, u2, r, b), grads, past, strict=True):
        s += g * g
        p -= rate * g / np.sqrt(s)


def test_steps_equal_a_plain_version():
    rng = np.random.default_rng(2)
    vocab = lm.Vocabulary(0, 0, [], np.zeros(0, np.int64), rng.random(lm.CLASSES) + 0.01)
    trainer = lm.Trainer(vocab, lm.initial(vocab), 5)
    draws = np.random.default_rng(5)
    want = [x.astype(np.float64) for x in lm.initial(vocab)]
    past = [np.full_like(x, 1e-4) for x in want]
    for n in (lm.BATCH, 700, 1):
        one, two = rng.integers(0, lm.CLASSES + 1, (2, n))
        outcome = np.minimum(rng.zipf(1.4, n), lm.CLASSES) - 1
        noise = np.minimum(np.searchsorted(trainer.cum, draws.random(lm.NOISE)), lm.CLASSES - 1)
        plain_step(*want, past, np.log(lm.NOISE * vocab.mass / vocab.mass.sum()), noise, one, two, outcome)
        trainer.step(np.stack([one, two + lm.CLASSES + 1, outcome + 2 * (lm.CLASSES + 1)]), outcome)
    for x, y in zip(trainer.p, want, strict=True):
        assert x.shape == y.shape and abs(x - y).max() < 1e-4


def test_one_coding_serves_training_and_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("third", (lm.F.col("doc_id") % 3).cast("int"))
    counts = lm.materialise(spark, lm.count_tokens(docs), "counts")
    vocab = lm.vocabulary(counts)
    coded = lm.coded_rows(docs, vocab, "third")
    part = coded.filter("third > 0")
    want, got = lm.train(docs.filter("third > 0"), vocab), lm.train_coded(part, vocab)
    assert all(abs(x - y).max() < 1e-6 for x, y in zip(want, got, strict=True))
    scored = {r["doc_id"]: r for r in lm.score_coded(coded, counts, vocab, got, "third").collect()}
    for r in lm.score(docs, counts, vocab, got).collect():
        one = scored.pop(r["doc_id"])
        assert one["third"] == r["doc_id"] % 3 and abs(one["score"] - r["score"]) < 1e-9 and one["n_known"] == r["n_known"]
    assert not scored
    calls = []
    monkeypatch.setattr(lm, "coded_rows", lambda *a: calls.append(a) or coded_rows(*a))
    lm.op4_log_bilinear(spark, SF).collect()
    assert len(calls) == 1 and "held_out" in calls[0]


coded_rows = lm.coded_rows
