"""The pipeline's run() against brute force over lists of rows."""

from collections import Counter

import pytest

import corpus_pipeline
from heddle.llm import language_id, packing, pii
from tests.llm.test_operators import brute_groups, brute_lines, brute_sets

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "river stone garden window market letter evening silver bridge forest candle harbour meadow lantern winter".split()


def prose(seed, n=24):
    return " ".join(WORDS[(seed * 7 + i * (seed % 5 + 1) + i * i // 3) % len(WORDS)] + ("s" if (seed >> i % 6) & 1 else "") for i in range(n))


def table():
    rows = [(i, f"{prose(i)}\nShared footer\nown line {prose(i + 100, 6)}", "en", "web", 9) for i in range(1, 13)]
    rows += [(0, f"Shared footer\n{prose(70)}", "en", "zero", 9)]
    rows += [(20, f"{prose(40)}\nonly here\n{prose(41)}", "en", "hot", 9)] * 4
    rows += [(None, f"{prose(50)}\nShared footer", "en", "lost", 9)] * 3 + [(None, prose(51), "en", "other", 9), (None, rows[0][1], None, "copy", 9)]
    rows += [(30, f"write to ann@example.org or +46 70 123 45 67, {prose(60)}", "en", None, 9), (31, rows[1][1], "en", "copy", 9)]
    rows += [(40, None, "en", "a", None), (41, "", "en", "a", 0), (41, "", "en", "a", 0), (42, " 12 \n\n", None, "a", 5), (43, "SHARED footer ", "en", "a", 9)]
    return rows


def brute(spark, rows):
    docs = spark.createDataFrame(rows, SHAPE)
    said = {r["text"]: r["lang_pred"] for r in language_id.identify(docs, language_id.learn(docs), "text").collect()}
    rows = [(d, t, said[t], s) for d, t, _, s in (r[:4] for r in rows) if any(c.isalpha() for c in t or "")]
    yield rows
    rows = [(d, "\n".join(kept), g, s) for (d, _, g, s), kept in zip(rows, brute_lines([r[1] for r in rows], 10), strict=True)]
    yield rows
    # a row without a doc_id is named by its text, after all others
    name = {t: 1000 + i for i, t in enumerate(sorted({r[1] for r in rows if r[0] is None}))}
    names = [name[r[1]] if r[0] is None else r[0] for r in rows]
    group = brute_groups(brute_sets({n: r[1] for n, r in zip(names, rows, strict=True)}, 5))
    rows = [r for n, r in zip(names, rows, strict=True) if group[n] == n]
    yield rows
    found = [pii.base_spans(t) for _, t, _, _ in rows]
    more = pii.field_spans([r[1] for r in rows], found, pii.trained())
    yield [(d, pii.redact(t, sorted(a + b)), g, s) for (d, t, g, s), a, b in zip(rows, found, more, strict=True)]


def test_run_equals_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = table()
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], brute(spark, rows), strict=True):
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), SHAPE)
        got = Counter(map(tuple, docs.collect()))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        n_chars = lambda t: 9 if stage is corpus_pipeline.language_stage else len(t)
        assert got == Counter((d, t, g, s, n_chars(t)) for d, t, g, s in want), stage.__name__
    assert sum(r[0] is None for r in want) == 4 and sum(r[0] == 20 for r in want) == 4
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = Counter((d, len(tok.encode(t, add_special_tokens=False).ids) + 1) for d, t, _, _ in want)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["length"]) for r in out) == size  # all texts are shorter than a sequence


@pytest.mark.parametrize("copies", [4])
def test_run_does_not_multiply_rows(spark, tmp_path, copies):
    rows = [(i, f"{prose(i)}\n{prose(i + 31)}", "en", "a", 9) for i in range(1, 5)] * copies
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    out = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert out == Counter({i: copies for i in range(1, 5)})
