"""Alignment of two tokenizers against a plain version that lists every link."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from heddle.llm import alignment
from heddle.llm.alignment import Alignment, Sides
from tests.conftest import SF

ODD = [
    (1, "plain words, 12.5 % of them"), (2, None), (3, ""), (4, "<|endoftext|> <s> </s> <0x41> ▁"), (5, "<|endoftext|> <s>"),
    (6, "日本語 Ångström \U0001f600‍\U0001f468"), (7, "tab\tnew\nline  two spaces"), (None, "plain words"), (8, "plain words"), (8, "plain words"),
    (9, "▁under"), (10, "é ﬁ Ⅳ"), (11, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 3), (12, " "), (13, "a\x00b"),
]


def plain(rows):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)], every link a tuple."""
    sides = Sides.public()
    first = Tokenizer.from_file(sides.a)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=sides.b)
    shown = {v: k for k, v in alignment.byte_of().items()}
    back = {c: b for b, c in shown.items()}
    made = []
    for doc, text in rows:
        a_ids, b_ids, groups = [], [], []
        if text:
            a_ids = first.encode(" " + text, add_special_tokens=False).ids
            b_ids = second.encode(text)
            a = [bytes(back[c] for c in first.id_to_token(i)) for i in a_ids]
            b = [bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
            if not b"".join(a) == b"".join(b) == (" " + text).encode():
                a_ids, b_ids = [], []
            ends = [np.cumsum([len(x) for x in side]).tolist() if ids else [] for side, ids in ((a, a_ids), (b, b_ids))]
            both = sorted(set(ends[0]) & set(ends[1]))
            groups = [([i for i, e in zip(ids, end, strict=True) if lo < e <= hi]) for lo, hi in zip([0, *both], both, strict=False) for ids, end in ((a_ids, ends[0]), (b_ids, ends[1]))]
            groups = list(zip(groups[::2], groups[1::2], strict=True))
        made.append((doc, a_ids, b_ids, groups, [(x, y) for g in groups for x in g[0] for y in g[1]]))
    count = Counter(p for m in made for p in set(m[4]))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    text = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
    return [(d, len(a), len(b), len(g), len(k), sum(count[p] == best[p[0]] for p in k), sum(count[p] for p in k), text(g)) for d, a, b, g, k in made], count, best


KEY = lambda r: tuple((v is None, str(v)) for v in r)


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts_equal_the_plain_version(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(alignment, "CHUNK", 60)
        monkeypatch.setattr(alignment, "PAIRS", 3)
    rows = ODD + [(100 + i, f"common words {i % 7} and {'x' * (i % 5)} more") for i in range(40)]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, block int, stripe string").repartition(3)
    found = Alignment(frame, Sides.public(), stripes=3 if small else 64, digest=False, fan=2 if small else 256)
    want, count, best = plain(rows)
    assert sum(r[1] > 0 for r in want) > 45 and sum(r[1] == 0 for r in want) >= 4
    assert sorted(map(tuple, found.documents().collect()), key=KEY) == sorted(want, key=KEY)
    pairs = {(r["a"], r["b"]): (r["docs"], r["best"]) for r in found.pairs().collect()}
    assert pairs == {p: (n, n == best[p[0]]) for p, n in count.items()}
    assert found.parts > 1 or not small


def test_query_equals_the_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in plain(docs)[0]]
    got = alignment.op11_striped_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_table(spark):
    found = Alignment(spark.createDataFrame([], "doc_id long, text string"), Sides.public())
    assert found.documents().count() == 0 and found.pairs().count() == 0


def test_a_group_without_common_ends_stays_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS", 1000)
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 300, 5000), rng.integers(0, 200, 4000)
    zero = np.zeros(1, np.int64)
    total, largest, seen = 0, 0, set()
    for _, x, y, n in alignment.linked(np.repeat(zero, 5000), a, np.repeat(zero, 4000), b, 1, 1000):
        total, largest = total + int(n.sum()), max(largest, len(x))
        seen |= set(zip(x.tolist(), y.tolist(), strict=True))
    assert total == 5000 * 4000 and largest <= 1200 and len(seen) == len(set(a)) * len(set(b))
