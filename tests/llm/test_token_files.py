"""Token files against the tokenizers library, for every width, and random access against the whole."""

import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from heddle.llm import token_files
from tests.conftest import SF


@pytest.mark.parametrize("width", [1, 2, 7, 15, 16, 17, 31, 32])
def test_bits_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << width, n).astype(np.uint32)
        packed = token_files.pack_bits(ids, width)
        assert len(packed) == -(-n // 64) * width * 8
        plain = "".join(format(int(i), f"0{width}b")[::-1] for i in ids)
        bits = "".join(format(b, "08b")[::-1] for b in packed)
        assert bits[: len(plain)] == plain and "1" not in bits[len(plain) :]
        assert (token_files.unpack_bits(packed, width, 0, n) == ids).all()
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (token_files.unpack_bits(packed, width, a, b) == ids[a:b]).all()


def test_width_is_the_least():
    assert [token_files.bits_for(n) for n in (0, 1, 2, 50_256, 65_535, 65_536)] == [1, 1, 2, 16, 16, 17]


ODD = [
    (7, "zwei Wörter <|endoftext|> 日本"), (3, None), (3, ""), (None, "no name"), (5, "same"), (5, "same"), (5, "other"),
    (1, "very long " * 40_000), (9, "\x00 \n\t"),
]


def plain(rows):
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_library(spark):
    got = [tuple(r) for r in token_files.op13_bit_packed(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(got) == plain(sorted(map(tuple, docs)))


def test_odd_rows_and_random_access(spark, tmp_path):
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in ODD], "doc_id long, text string, ids string, start int").repartition(3)
    to = f"file://{tmp_path}/files"
    token_files.write_token_files(rows, to, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), block_ids=8)
    found = token_files.read_documents(spark, to).orderBy("start").collect()
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in found]
    assert [r[0] for r in got] == [None, 1, 3, 3, 5, 5, 5, 7, 9]
    by_crc = {(r[0], r[2], r[3]) for r in plain(ODD)}
    assert {(r[0], r[2], r[3]) for r in got} == by_crc
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    whole = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in found])
    for a, n in ((0, 5), (17, 300), (len(whole) - 9, 9), (len(whole) - 2, 50), (len(whole), 4)):
        part = token_files.read_range(spark, to, a, n).orderBy("start").collect()
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in part]) if part else whole[:0]
        assert (ids == whole[a : a + n]).all()


def test_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(rows, f"file://{tmp_path}/none", path("byte_bpe_50k.json"))
    assert token_files.read_documents(spark, f"file://{tmp_path}/none").count() == 0
