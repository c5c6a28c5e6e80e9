"""The network's tables against a direct convolution, and its bounded sample."""

import numpy as np

from heddle.llm import language_id as lid
from tests.conftest import SF


def direct(net, text):
    """Mean over windows of the logits, by the definition of the layers."""
    raw = text.encode()
    n = max(1, -(-len(raw) // lid.STEP))
    raw = np.frombuffer(raw.ljust(n * lid.STEP + 3, b"\0"), np.uint8)
    out = []
    for k in range(n):
        rows = raw[None, k * lid.STEP : k * lid.STEP + lid.REACH]
        feats = [np.maximum((net.columns(rows, w) @ f + b)[0].max(axis=0), 0) for w, f, b in zip(lid.WIDTHS, net.filters, net.bias, strict=True)]
        out.append(np.concatenate(feats) @ net.out + net.out_bias)
    return np.mean(out, axis=0)


def test_tables_equal_a_direct_convolution():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (64, lid.REACH)).astype(np.uint8)
    net = lid.train(rows, rng.integers(0, 3, 64), ["a", "b", "c"], epochs=1)
    # every text is followed by zero bytes, as the last window of the table form is
    for text in ("", "x", "Ab" * 20, "ümlaut " * 40, "z" * 128, "long text " * 99):
        body = np.frombuffer(text.encode(), np.uint8)
        got = lid.Scorer(net).logits(body, np.array([0, len(body)]))[0]
        assert np.allclose(got, direct(net, text), atol=1e-3)


def test_the_sample_is_bounded_and_covers_every_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    many = docs.unionAll(docs.selectExpr("doc_id + 1000000", "text", "lang", "source", "n_chars"))
    rows, labels, langs = lid.sample_windows(many, 10, 4)
    assert langs == sorted(r["lang"] for r in docs.select("lang").distinct().collect() if r["lang"])
    assert set(labels) == set(range(len(langs))) and len(rows) <= 4 * 25 * len(langs)
    empty = lid.sample_windows(docs.limit(0), 10, 4)
    assert empty[2] == [] and len(empty[0]) == 0
