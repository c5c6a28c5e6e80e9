"""Cross-tokenizer alignment by id-striped dense count matrices.

Each text is encoded by two tokenizers. Byte offsets where a token of both ends cut the text into groups; every token of
A in a group is linked with every token of B in it. Ids of A are dealt into ``STRIPES`` stripes (id modulo), and with them every
pair. A task encodes texts in blocks of about ``CHUNK`` bytes and writes, for each block and stripe, the posting lists of
its pairs: distinct pairs in order, in how many documents of the block each is linked, which ones and how often.

Counting: blocks are partitioned by stripe. A stripe's counts are a dense matrix (its A ids by all B ids), filled a slab of rows at a time
with np.add.at; a slab's row maxima say which pairs are best of their A id. At most ``FAN`` blocks meet in a group; the matrices of
several groups are added in further levels in the same way, so a stripe of very frequent ids is never in one task.
Scoring: the posting lists, partitioned by stripe and group, meet the stripe's counts there, and return two sums for each
document of a block; the sums of a block's stripes are added where its documents are.

Defined results
---------------
* null or empty texts, and texts that either tokenizer does not give back byte by byte: no tokens, zeros and ''.
* special tokens' strings in a text are plain text. Repeated rows are separate documents, also in the counts.
* very long texts: whole, in a block of their own. Pairs of a group are made from its distinct ids, with their numbers
  of occurrences, a bounded slice at a time; so a text without common ends does not multiply.
* further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import byte_chunks, documents, materialise
from heddle.llm.packing import TextTokenizer

STRIPES = 64
CHUNK = 1_000_000
#: Blocks of a stripe that meet in one group; also matrices that are added in one group.
FAN = 256
#: Rows of the dense matrix that are held at once.
SLAB = 128
#: Pairs made at once from the groups of a block.
PAIRS = 1 << 22
DOCUMENT = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string())]
POSTINGS = ("pair", "held", "doc", "times")
POSTED = "block long, stripe int, n_docs int, " + ", ".join(
    [f"{c} array<{'string' if t == pa.string() else 'long'}>" for c, t in DOCUMENT] + [f"{c} binary" for c in POSTINGS]
)


@dataclass(frozen=True)
class Sides:
    """The two tokenizers' files: byte-level BPE for A (and the same vocabulary as byte ranks), pieces for B."""

    a: str
    b: str
    a_ranks: str | None = None

    @staticmethod
    def public() -> Sides:
        from public_tokenizers import path

        return Sides(path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"))


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class Aligner:
    """Both encoders with the bytes of every id; one for each task."""

    def __init__(self, sides: Sides):
        import sentencepiece

        self.first = TextTokenizer(sides.a, sides.a_ranks)
        self.first.tok.encode_special_tokens = True
        self.first.special = []
        self.second = sentencepiece.SentencePieceProcessor(model_file=sides.b)
        vocab, byte = self.first.tok.get_vocab(with_added_tokens=True), byte_of()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        sp = self.second
        self.b_bytes = [
            bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
            for i in range(sp.get_piece_size())
        ]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        names = [[f"{i}{end}" for i in range(len(t))] for t, ends in ((self.a_bytes, ",|"), (self.b_bytes, (",", ";", ""))) for end in ends]
        self.named = [x for part in names for x in part]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; both empty where one does not give the text back."""
        none = np.zeros(0, np.int64)
        firsts = [np.frombuffer(self.first.ids(" " + t), "<u4").astype(np.int64) if t else none for t in texts]
        seconds = self.second.encode([t or "" for t in texts], num_threads=1)
        for i, t in enumerate(texts):
            whole = b" " + t.encode() if t else b""
            same = b"".join(map(self.a_bytes.__getitem__, firsts[i].tolist())) == whole
            if t and same and b"".join(map(self.b_bytes.__getitem__, seconds[i])) == whole:
                seconds[i] = np.array(seconds[i], np.int64)
            else:
                firsts[i], seconds[i] = none, none
        return firsts, seconds


def linked(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, groups: int, width: int):
    """Slices (group, a, b, times) of the distinct pairs of each group; ids are below ``width``."""
    key_a, n_a = np.unique(group_a * width + a, return_counts=True)
    key_b, n_b = np.unique(group_b * width + b, return_counts=True)
    (of_a, a), (of_b, b) = np.divmod(key_a, width), np.divmod(key_b, width)
    many = np.bincount(of_b, minlength=groups)
    start = np.cumsum(many) - many
    size = many[of_a]
    ends = np.cumsum(size)
    cut = np.searchsorted(ends, np.arange(PAIRS, int(ends[-1]) + PAIRS if len(ends) else 0, PAIRS), "right").tolist()
    cuts = sorted({0, len(a), *cut})
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        left = np.repeat(np.arange(lo, hi), size[lo:hi])
        first = np.repeat(ends[lo:hi] - size[lo:hi], size[lo:hi]) - (ends[lo - 1] if lo else 0)
        right = start[of_a[left]] + np.arange(len(left)) - first
        yield of_a[left], a[left], b[right], n_a[left] * n_b[right]


def summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``times`` of each."""
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at], np.add.reduceat(times, at) if len(at) else times


def least(x: np.ndarray) -> bytes:
    """The numbers in the narrowest unsigned form that holds all of them."""
    top = int(x.max(initial=0))
    return x.astype(next(t for t in ("u1", "<u2", "<u4", "<u8") if top <= np.iinfo(t).max)).tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``least`` wrote."""
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "u1").astype(np.int64)


def block_rows(al: Aligner, number: int, docs: list[int | None], texts: list[str | None], stripes: int, digest: bool) -> pa.RecordBatch:
    """The rows of one block: its documents (stripe -1), and the posting lists of each stripe."""
    firsts, seconds = al.encode(texts)
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (firsts, seconds))
    a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (firsts, seconds))
    ends_a, ends_b = np.cumsum(al.a_len[a]), np.cumsum(al.b_len[b])
    mark = np.zeros((int(ends_a[-1]) if len(a) else 0) + 1, bool)
    mark[ends_a] = True
    last_b = mark[ends_b]
    mark[:] = False
    mark[ends_b[last_b]] = True
    last_a = mark[ends_a]
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    groups = int(last_b.sum())
    owner = np.repeat(np.arange(len(docs)), n_b)[last_b]
    size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    n_groups, n_links = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    np.add.at(n_groups, owner, 1)
    np.add.at(n_links, owner, size_a * size_b)

    # the groups as text: ids of A, then of B, group by group
    va, vb = len(al.a_bytes), len(al.b_bytes)
    stop = np.cumsum(n_a + n_b)
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]] = a + va * last_a
    closing = last_b.astype(np.int64)
    if len(b):
        closing[np.cumsum(n_b)[n_b > 0] - 1] = 2
    order[np.arange(len(b)) + np.cumsum(size_a)[group_b]] = 2 * va + b + vb * closing
    shown, at = [], 0
    for end in stop.tolist():
        text = "".join(map(al.named.__getitem__, order[at:end].tolist()))
        shown.append(hashlib.sha256(text.encode()).hexdigest() if text and digest else text)
        at = end

    # posting lists: keys order by stripe, pair (local id of A, id of B) and document
    local = -(-va // stripes)
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for group, x, y, n in linked(group_a, a, group_b, b, groups, max(va, vb)):
        key, n = summed(((x % stripes * local + x // stripes) * vb + y) * len(docs) + owner[group], n)
        keys.append(key)
        times.append(n)
    key, n = summed(np.concatenate(keys), np.concatenate(times))
    pair, doc = np.divmod(key, max(len(docs), 1))
    of, pair = np.divmod(pair, local * vb)
    cuts = np.searchsorted(of, np.arange(stripes + 1))
    some = np.flatnonzero(np.diff(cuts)).tolist()
    lists: dict[str, list] = {c: [None] for c in POSTINGS}
    for s in some:
        lo, hi = cuts[s], cuts[s + 1]
        first = np.flatnonzero(np.diff(pair[lo:hi], prepend=-1))
        lists["pair"].append(pair[lo:hi][first].astype("<u4").tobytes())
        lists["held"].append(np.diff(first, append=hi - lo).astype("<u4").tobytes())
        lists["doc"].append(least(doc[lo:hi]))
        lists["times"].append(least(n[lo:hi]))
    rows = 1 + len(some)
    columns = {
        "block": pa.array([number] * rows, pa.int64()), "stripe": pa.array([-1, *some], pa.int32()), "n_docs": pa.array([len(docs)] * rows, pa.int32()),
    }
    for (name, kind), x in zip(DOCUMENT, (docs, n_a, n_b, n_groups, n_links, shown), strict=True):
        columns[name] = pa.array([list(x)] + [None] * len(some), pa.list_(kind))
    columns |= {c: pa.array(x, pa.binary()) for c, x in lists.items()}
    return pa.RecordBatch.from_pydict(columns)


def posted(docs: DataFrame, sides: Sides, stripes: int = STRIPES, digest: bool = True) -> DataFrame:
    """Documents and posting lists of every block; ``digest`` keeps the sha256 of the groups' text in its place."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, number = Aligner(sides), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in byte_chunks(whole, "text", CHUNK):
                yield block_rows(al, number, batch["doc_id"].to_pylist(), batch["text"].to_pylist(), stripes, digest)
                number += 1

    return documents(docs).mapInArrow(task, POSTED)


def dense_sums(lists: list[tuple[np.ndarray, np.ndarray]], rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, counts, best) of sorted (pair, count) lists, by slabs of the stripe's dense matrix; best: the row's maximum."""
    out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]]
    for low in range(0, rows, SLAB):
        slab, base = np.zeros(min(SLAB, rows - low) * width, np.int64), low * width
        for pair, count in lists:
            lo, hi = np.searchsorted(pair, [base, base + len(slab)])
            np.add.at(slab, pair[lo:hi] - base, count[lo:hi])
        some = np.flatnonzero(slab)
        top = slab.reshape(-1, width).max(axis=1)
        for part, x in zip(out, (some + base, slab[some], slab[some] == top[some // width]), strict=True):
            part.append(x)
    return tuple(np.concatenate(x) for x in out)


class Alignment:
    """Corpus-wide alignment of two tokenizers: ``documents()`` has a row for each text, ``pairs()`` one for each linked id pair."""

    def __init__(self, docs: DataFrame, sides: Sides, stripes: int = STRIPES, digest: bool = True, fan: int = FAN):
        spark = docs.sparkSession
        al = Aligner(sides)  # the driver needs the sizes of the vocabularies
        self.stripes, self.fan = stripes, fan
        self.rows, self.width = -(-len(al.a_bytes) // stripes), len(al.b_bytes)
        self.held = materialise(spark, posted(docs, sides, stripes, digest), "postings")
        blocks = self.held.filter("stripe = -1").count()
        self.parts = max(1, -(-blocks // fan))
        self.counts = materialise(spark, self._counted(), "pair-counts")

    def _lists(self) -> DataFrame:
        return self.held.filter("stripe >= 0").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(self.parts)).cast("int"))

    def _counted(self) -> DataFrame:
        """(stripe, part, pair, held, best): one row for each stripe; the levels end when one part is left."""
        rows, width = self.rows, self.width

        def add(table: pa.Table) -> pa.Table:
            lists = []
            for pair, held in zip(table["pair"], table["held"], strict=True):
                pair = np.frombuffer(pair.as_buffer(), "<u4").astype(np.int64)
                held = np.frombuffer(held.as_buffer(), f"<u{held.as_buffer().size // max(len(pair), 1)}").astype(np.int64)
                lists.append((pair, held))
            pair, count, best = dense_sums(lists, rows, width)
            data = [pair.astype("<u4").tobytes(), count.astype("<u8").tobytes(), np.packbits(best).tobytes()]
            keys = {c: table[c].slice(0, 1) for c in ("stripe", "part")}
            return pa.table(keys | {c: pa.array([x], pa.binary()) for c, x in zip(("pair", "held", "best"), data, strict=True)})

        parts, out = self.parts, self._lists().select("stripe", "part", "pair", "held")
        while True:
            out = out.select("stripe", "part", "pair", "held").groupBy("stripe", "part")
            out = out.applyInArrow(add, "stripe int, part int, pair binary, held binary, best binary")
            if parts == 1:
                return out
            parts = -(-parts // self.fan)
            out = out.withColumn("part", F.floor(F.col("part") / self.fan).cast("int"))

    def pairs(self) -> DataFrame:
        """(a, b, docs, best): in how many documents an id pair is linked, and whether that is the most of its A id."""
        stripes, width = self.stripes, self.width

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for stripe, pair, held, best in zip(*(batch[c] for c in ("stripe", "pair", "held", "best")), strict=True):
                    local, b = np.divmod(np.frombuffer(pair.as_buffer(), "<u4").astype(np.int64), width)
                    count = np.frombuffer(held.as_buffer(), "<i8")
                    top = np.unpackbits(np.frombuffer(best.as_buffer(), np.uint8), count=len(count)).astype(bool)
                    columns = [local * stripes + stripe.as_py(), b, count, top]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "docs", "best"])

        return self.counts.select("stripe", "pair", "held", "best").mapInArrow(task, "a long, b long, docs long, best boolean")

    def _scored(self) -> DataFrame:
        """(block, best, total): for the documents of a block, in order, their best links and sums of counts in one stripe."""

        def score(lists: pa.Table, counts: pa.Table) -> pa.Table:
            known = np.frombuffer(counts["pair"][0].as_buffer(), "<u4")
            count = np.frombuffer(counts["held"][0].as_buffer(), "<i8")
            top = np.unpackbits(np.frombuffer(counts["best"][0].as_buffer(), np.uint8), count=len(count)).astype(np.int64)
            best, total = [], []
            for pair, held, doc, times, n_docs in zip(*(lists[c] for c in (*POSTINGS, "n_docs")), strict=True):
                at = np.searchsorted(known, np.frombuffer(pair.as_buffer(), "<u4"))
                held = np.frombuffer(held.as_buffer(), "<u4").astype(np.int64)
                at = np.repeat(at, held)
                doc, times = wide(doc.as_buffer(), len(at)), wide(times.as_buffer(), len(at))
                sums = np.zeros((2, n_docs.as_py()), np.int64)
                np.add.at(sums[0], doc, times * top[at])
                np.add.at(sums[1], doc, times * count[at])
                best.append(least(sums[0]))
                total.append(least(sums[1]))
            columns = {"block": lists["block"], "best": pa.array(best, pa.binary()), "total": pa.array(total, pa.binary())}
            return pa.table(columns)

        lists = self._lists().select("stripe", "part", "block", "n_docs", *POSTINGS)
        counts = self.counts.drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
        keys = ("stripe", "part")
        return lists.groupBy(*keys).cogroup(counts.groupBy(*keys)).applyInArrow(score, "block long, best binary, total binary")

    def documents(self) -> DataFrame:
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): one row for each document."""
        names = [c for c, _ in DOCUMENT]

        def finish(docs: pa.Table, scores: pa.Table) -> pa.Table:
            docs = docs.slice(0, 1).combine_chunks()
            columns = {c: docs[c].combine_chunks().flatten() for c in names}
            n = len(columns["doc_id"])
            for name, part in (("n_best", "best"), ("count_sum", "total")):
                sums = np.zeros(n, np.int64)
                for x in scores[part]:
                    sums += wide(x.as_buffer(), n)
                columns[name] = pa.array(sums)
            return pa.table(columns)

        fields = ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in DOCUMENT)
        rows = self.held.filter("stripe = -1").select("block", *names).groupBy("block")
        found = rows.cogroup(self._scored().groupBy("block")).applyInArrow(finish, f"{fields}, n_best long, count_sum long")
        return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def op11_striped_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the 50k byte-level vocabulary against the 32k pieces."""
    out = Alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), Sides.public()).documents()
    return out.withColumnRenamed("groups", "groups_sha256")
