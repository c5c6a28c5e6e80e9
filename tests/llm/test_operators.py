"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import ann, bpe, gif, language_id, line_dedup, lm, near_dup, packing, pii, quality, words
from tests.conftest import SF

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, word string"
ODD = [
    (1, None, None, None, None, "x"),
    (2, "", "en", "a", 0, None),
    (3, "one two three four five six\nshared line\n", "en", "a", 30, "y"),
    (3, "one two three four five six\nshared line\n", "en", "a", 30, "y"),
    (4, "lang " * 30_000 + "<|endoftext|> ümlaut Σίσυφος", "de", "b", 150_000, ""),
    (5, "\n\n \t\n", "fr", "b", 4, "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and a further column that clashes with inner names."""
    return spark.createDataFrame(ODD, SHAPE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def texts_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


# --- packing -------------------------------------------------------------------------------------


def test_packing_places_every_token_once(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_vocabulary(docs).collect()
    want = {d: [*tok.encode(t, add_special_tokens=False).ids, 2] for d, t in texts_of(docs).items()}
    seen, room = {d: 0 for d in want}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == seen[r["doc_id"]] and 0 < r["length"] == len(ids) <= 1024
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += len(ids)
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {d: len(i) for d, i in want.items()}
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(room) <= -(-sum(map(len, want.values())) // 1024) * 1.02 + 2


def test_packing_odd_rows(odd, none):
    rows = packing.pack_vocabulary(odd).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] in (1, 2)) == 2
    assert sum(r["piece"] == 0 for r in rows) == len(ODD)
    assert packing.pack_vocabulary(none).count() == 0


def test_pricing_is_the_best_multiset():
    values = np.array([-1, 0.3, 0.5, -1, 1.1, 1.2])
    best = packing.price(values, 9)
    assert sum(k * n for k, n in best.items()) <= 9
    options = [a * 0.3 + b * 0.5 + c * 1.1 + d * 1.2 for a in range(10) for b in range(5) for c in range(3) for d in range(2) if a + 2 * b + 4 * c + 5 * d <= 9]
    assert sum(values[k] * n for k, n in best.items()) == pytest.approx(max(options))


# --- BPE -----------------------------------------------------------------------------------------


def test_bpe_equals_the_library(docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    for table in (docs, odd):
        want = texts_of(table)
        for r in bpe.encode_documents(table, path, size=500).collect():
            ids = tok.encode(want[r["doc_id"]], add_special_tokens=False).ids
            assert r["ids"] == ids
            assert r["decoded"] == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(none, path).count() == 0


def test_transducer_shares_suffixes_and_finds_words():
    held = {w.encode(): [i, i + 1] for i, w in enumerate(["walking", "talking", "walked", "talked", "a"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(held))
    found = lexicon.find([*held, b"walk", b"zebra", b""])
    assert (found[-3:] == -1).all()
    assert [lexicon.output(k).tolist() for k in found[:5]] == list(held.values())
    assert len(lexicon.key) < sum(map(len, held))


# --- language model --------------------------------------------------------------------------------


def test_lm_base_score_and_normalisation(docs, odd, none):
    train = {d: t for d, t in texts_of(docs).items() if zlib.crc32(str(d).encode()) % 5 != 1}
    count = {}
    for t in train.values():
        for w in [*t.encode().lower().split(), b""]:
            count[w] = count.get(w, 0) + 1
    total, distinct = sum(count.values()), len(count)
    out = lm.op4_log_bilinear(docs.sparkSession, SF).collect()
    everything = texts_of(docs)
    for r in out:
        ws = [*everything[r["doc_id"]].encode().lower().split(), b""]
        base = sum(np.log10((count.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in count for w in ws), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    spark = docs.sparkSession
    for table in (odd, none):
        counts = spark.createDataFrame(lm.count_tokens(table).collect() or [], "word binary, n long")
        vocab = lm.vocabulary(counts)
        rows = lm.score(table, counts, vocab, lm.train(table, vocab)).collect()
        assert len(rows) == table.count() and all(np.isfinite(r["score"]) for r in rows)


# --- personal data ---------------------------------------------------------------------------------

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
)


def brute_spans(text):
    out = []
    for k, (_, pattern, ok) in enumerate(PATTERNS):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(out)


def test_pii_base_equals_plain_patterns(docs, odd, none):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("0123456789.+-() @ab\n") for _ in range(40))
        assert pii.base_spans(text) == brute_spans(text)
    for table in (docs, odd):
        want = texts_of(table)
        for r in pii.find_pii(table).collect():
            spans = brute_spans(want[r["doc_id"]])
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
            assert r["base_sha256"] == hashlib.sha256(pii.join_spans(spans).encode()).hexdigest()
            assert set(pii.join_spans(spans).split(",")) - {""} <= set(r["spans"].split(","))
    assert pii.find_pii(none).count() == 0


def test_field_finds_held_out_spans():
    field, rows = pii.trained(), pii.labelled(300, seed=99)
    found = pii.field_spans([t for t, _ in rows], [[] for _ in rows], field)
    hit = sum(bool(set(f) & set(s)) for f, (_, s) in zip(found, rows, strict=True) if s)
    false = sum(bool(f) for f, (_, s) in zip(found, rows, strict=True) if not s)
    assert hit >= 0.85 * sum(bool(s) for _, s in rows) and false <= 0.1 * len(rows)


# --- near duplicates ---------------------------------------------------------------------------------


def brute_sets(texts, k):
    out = {}
    for d, t in texts.items():
        ws = t.encode().lower().split()
        out[d] = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())
    return out


def brute_groups(sets):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups_equal_all_pairs(docs, k):
    sets = brute_sets(texts_of(docs), k)
    want = brute_groups(sets)
    for r in near_dup.near_groups(docs, words=k).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])


def test_near_groups_of_chains_and_odd_rows(spark, odd, none):
    base = [f"w{i}" for i in range(40)]
    chain = [(i, " ".join(base[i : i + 30])) for i in range(8)]  # neighbours differ in one word at either end
    rows = spark.createDataFrame([*chain, (50, "short"), (51, "SHORT"), (52, None), (53, "")], "doc_id long, text string")
    want = brute_groups(brute_sets(texts_of(rows), 2))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_groups(rows, words=2).collect()}
    assert got == want and got[51] == 50 and got[7] == 0
    assert near_dup.near_groups(odd, words=2).count() == len(ODD)
    assert near_dup.near_groups(none).count() == 0


def test_every_sketch_coordinate_fills_and_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    b = np.concatenate([a[:250], rng.integers(0, 1 << 60, 50).astype(np.uint64)])
    c = near_dup.sketch(np.concatenate([a, b, a[:1]]), np.array([0, 300, 600, 601]), 512)
    assert (c != np.uint64(2**64 - 1)).all()
    assert (c[0] == c[1]).mean() == pytest.approx(250 / 350, abs=0.08)


# --- line dedup --------------------------------------------------------------------------------------


def brute_lines(texts, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = {}
    for t in texts:
        for k in {key(x) for x in t.split("\n")} - {""}:
            seen[k] = seen.get(k, 0) + 1
    return [[x for x in t.split("\n") if seen.get(key(x), 0) < least] for t in texts]


def test_line_dedup_equals_brute_force(spark, docs, none):
    texts = texts_of(docs)
    want = dict(zip(texts, brute_lines(texts.values(), 3), strict=True))
    for r in line_dedup.line_dedup(docs, min_docs=3, batches=5).collect():
        kept = want[r["doc_id"]]
        assert r["text"] == "\n".join(kept)
        assert r["n_dropped"] == r["n_lines"] - len(kept)
    rows = spark.createDataFrame([(i, " A line \nown " + str(i)) for i in range(12)] + [(20, None), (21, "a LINE")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(rows).collect()}
    assert got[3] == "own 3" and got[20] == "" and got[21] == ""
    assert line_dedup.line_dedup(none).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for i in range(4):
        runs.add(spark.createDataFrame([(i, f"common\nline {i}")], "doc_id long, text string"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert sorted(r["docs"] for r in runs.totals().collect()) == [1, 1, 1, 1, 4]


# --- language id -------------------------------------------------------------------------------------


def test_language_is_right_on_held_out_texts(docs, odd, none):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    texts = texts_of(docs)
    out = language_id.op8_byte_cnn(docs.sparkSession, SF).collect()
    held = [r for r in out if r["held_out"] and lang[r["doc_id"]] and len(texts[r["doc_id"]]) > 40]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.9
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", texts[r["doc_id"]])) for r in out)
    net = language_id.learn(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, net).collect()}
    assert got[1] == got[2] == got[5] == "und"
    assert language_id.identify(none, None).count() == 0


# --- nearest neighbours ------------------------------------------------------------------------------


def test_recall_of_the_tree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 24)) + rng.normal(size=(40, 24))[rng.integers(0, 40, 6000)] * 2
    x[::50] = x[0]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(7000, None), (7020, [0.0] * 24), (7040, [float("nan")] * 24)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.neighbours(table, F.col("vec_id") % 60 == 0, k=10).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 6000, 60))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        best = sorted((i for i in range(6000) if i != q), key=lambda i: (-s[i], i))[:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        hit += len(set(best) & {v for _, v, _ in found})
        assert all(score == pytest.approx(s[v]) for _, v, score in found)
    assert hit >= 0.9 * 10 * len(got)


# --- media -------------------------------------------------------------------------------------------


def test_gif_round_trip(docs, odd, none):
    for table in (docs, odd):
        want = texts_of(table)
        for r in gif.payload_table(table).collect():
            raw = want[r["doc_id"]].encode()
            payload = raw + bytes(-len(raw) % 64 if raw else 64)
            assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
            assert r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert gif.payload_table(none).count() == 0
    noise = np.random.default_rng(0).integers(0, 256, 64 * 500).astype(np.uint8).tobytes()
    assert gif.read_payload(gif.encode(noise)) == noise
    assert len(gif.decode(gif.encode(noise))) == 1


# --- quality -----------------------------------------------------------------------------------------


def test_quality_follows_the_labels(docs, odd, none, spark):
    rows = quality.classify(docs)
    got = {r["doc_id"]: r["score"] for r in rows.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [got[d] for d, q in labels.items() if q == 1 and d in got]
    bad = [got[d] for d, q in labels.items() if q == 0 and d in got]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.7
    assert quality.classify(odd).count() == len(ODD)
    assert quality.classify(none).count() == 0


def test_word_hashes_follow_words():
    body = np.frombuffer(b"Ab cd\nab  CD", np.uint8)
    h, first = words.word_hashes(body, np.array([0, 6, 12]))
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1] and first.tolist() == [0, 2, 4]
