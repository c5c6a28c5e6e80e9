"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

All words of the corpus are counted (per task first, then by a shuffle); the most frequent ones are
merged once and compiled into a minimal acyclic automaton: equal suffixes share states, and the
count of words before each edge numbers the words (perfect hashing), so a word's number leads to its
ids. The automaton is a flat byte image; every Python worker writes it to an unlinked temporary file,
maps it into memory and walks all distinct new words of a batch through it at once. Words that it
does not hold are merged exactly from the merge ranks. Equal words are looked up once per worker.

Vocabulary files: BPE with an end-of-word suffix over byte symbols, white space dropped, text in
NFC and lower case, as the tokenizers library writes them.

Defined results
---------------
* null or empty text: no ids, an empty decoded text.
* very long texts and words: whole; a long word is merged with a heap in O(n log n).
* repeated rows: one result row each; ties in word counts break by the word; an empty table gives an
  empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import byte_chunks, documents, materialise, most_frequent

LEXICON_WORDS = 262_144
CACHE = 800_000
# Fixed value: the word pattern in the vocabulary file's pre-tokenizer.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


@lru_cache
def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE files use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


class Merges:
    """Exact BPE of single words from the merge ranks of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.rank: dict[tuple[str, str], int] = {
            tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])
        }
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}

        at = self.vocab.get
        table = byte_symbols()
        self.first = [at(c, -1) for c in table]  # a byte inside a word
        self.last = [at(c + self.suffix, -1) for c in table]  # a word's last byte
        #: (id, id) of a pair, as one number -> its rank, and the id that it becomes
        self.pair = {at(a) << 20 | at(b): i for (a, b), i in self.rank.items()}
        self.merged = [at(a + b) for a, b in self.rank]

    def word(self, word: bytes) -> list[int]:
        """The ids of a word (bytes of UTF-8)."""
        if len(word) > 48:
            table = byte_symbols()
            parts = [table[b] for b in word]
            parts[-1] += self.suffix
            return [self.vocab[p] for p in self._long(parts)]
        first, rank, merged, none = self.first, self.pair.get, self.merged, 1 << 60
        ids = [first[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        ranks = [rank(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            new = ids[i] = merged[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 20 | ids[i + 1], none)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | new, none)
        return ids

    def _long(self, parts: list[str]) -> list[str]:
        n = len(parts)
        left, right, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(self.rank[p], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not live[i] or parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], live[j], right[i] = a + b, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x in (left[i], i):
                if x >= 0 and right[x] < n and (p := (parts[x], parts[right[x]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p], x, *p))
        return [p for p, ok in zip(parts, live, strict=True) if ok]


# --- the transducer ------------------------------------------------------------------------------


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The image of the minimal acyclic automaton of ``words`` with their ids.

    Sorted words are added one by one; the part of the previous word that can no longer change is
    replaced by an equal state where there is one, so states are shared as soon as possible.
    """
    final: list[bool] = [False]
    edges: list[dict[int, int]] = [{}]
    register: dict[tuple, int] = {}
    path, last = [0], b""

    def close(depth: int) -> None:
        for d in range(len(last), depth, -1):
            parent, child = path[d - 1], path[d]
            key = (final[child], tuple(edges[child].items()))
            edges[parent][last[d - 1]] = register.setdefault(key, child)

    order = sorted(words)
    for word in order:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        close(same)
        path = path[: same + 1]
        for b in word[same:]:
            final.append(False)
            edges.append({})
            edges[path[-1]][b] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    close(0)
    # words that each state leads to; states are finished children first
    number: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack[-1]
        todo = [t for t in edges[s].values() if t not in number]
        if todo:
            stack.extend(todo)
        else:
            number[stack.pop()] = final[s] + sum(number[t] for t in edges[s].values())
    key, to, skip, ends = [], [], [], []
    for s in sorted(number):
        before = int(final[s])
        for b, t in sorted(edges[s].items()):
            key.append(s << 8 | b)
            to.append(t)
            skip.append(before)
            before += number[t]
        if final[s]:
            ends.append(s)
    outs = [words[w] for w in order]
    starts = np.cumsum([0, *map(len, outs)])
    arrays = (
        np.array(key, "<i8"),
        np.array(to, "<i4"),
        np.array(skip, "<i4"),
        np.array(ends, "<i4"),
        starts.astype("<i4"),
        np.array([i for o in outs for i in o], "<u4"),
    )
    return np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A memory-mapped automaton image; ``find`` walks many words at once."""

    def __init__(self, image: bytes):
        with tempfile.TemporaryFile() as f:  # has no name: nothing stays behind in the executor's folder
            f.write(image)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes, at, out = np.frombuffer(self.map, "<i8", 6), 48, []
        for n, kind in zip(sizes, ("<i8", "<i4", "<i4", "<i4", "<i4", "<u4"), strict=True):
            out.append(np.frombuffer(self.map, kind, int(n), at))
            at += int(n) * int(kind[2])
        self.key, self.to, self.skip, self.ends, self.starts, self.ids = out

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for those not held."""
        n = len(words)
        number, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not n or not len(self.key):
            return np.full(n, -1)
        length = np.fromiter(map(len, words), np.int64, n)
        body = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(length) - length
        alive = np.flatnonzero(length > 0)
        number[length == 0] = -1
        depth = 0
        while len(alive):
            want = state[alive] << 8 | body[at[alive] + depth]
            i = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[i] == want
            number[alive[~ok]] = -1
            alive, i = alive[ok], i[ok]
            number[alive] += self.skip[i]
            state[alive] = self.to[i]
            depth += 1
            done = length[alive] == depth
            ended = alive[done]
            held = np.isin(state[ended], self.ends)
            number[ended[~held]] = -1
            alive = alive[~done]
        return number

    def output(self, number: int) -> np.ndarray:
        return self.ids[self.starts[number] : self.starts[number + 1]]


# --- words of a text -----------------------------------------------------------------------------


def words_of(piece: str) -> list[bytes]:
    """The words of a piece of text, as the vocabulary's normaliser and pre-tokenizer make them."""
    if piece.isascii():
        piece = piece.lower()
        if piece.isalpha():
            return [piece.encode()]
    else:
        piece = unicodedata.normalize("NFC", piece)
        piece = "".join(c.lower() for c in piece) if "Σ" in piece else piece.lower()
    return [w.encode() for w in WORD.findall(piece)]


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts, where each text's begin), parted at spaces and line ends, which nothing spans."""
    lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), offsets - offsets[0]


def count_words(docs: DataFrame, special: Iterable[str]) -> DataFrame:
    """(word binary, n long): how often each word occurs in all texts."""
    special = tuple(special)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            total: Counter = Counter()
            for piece, n in seen.items():
                if piece and not any(s in piece for s in special):
                    for w in words_of(piece):
                        total[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for text in batch["text"]:
                seen.update(text.as_py().replace("\n", " ").split(" "))
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    found = documents(docs).select("text").mapInArrow(count, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, size: int = LEXICON_WORDS) -> bytes:
    """The automaton image of the most frequent words, at most ``size``, of ``docs`` (48 bytes at most)."""
    merges = Merges(vocabulary)
    counts = materialise(docs.sparkSession, count_words(docs, merges.special).filter(F.length("word") <= 48), "words")
    return compile_lexicon({w: merges.word(w) for w, _ in most_frequent(counts, size)})


class Encoder:
    """Ids and decoded strings of whole texts, by the lexicon first and exact merging else."""

    def __init__(self, vocabulary: str, image: bytes):
        self.merges, self.lexicon = Merges(vocabulary), Lexicon(image)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.mark = os.path.commonprefix(special)
        self.ids: dict[str, bytes] = {}  # of pieces met before
        names = self.merges.text
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())

    def _parts(self, piece: str) -> list[bytes | int]:
        if self.special and self.mark in piece and self.special.search(piece):
            ids = self.merges.special
            parts = [p for p in self.special.split(piece) if p]
            return [x for p in parts for x in ([ids[p]] if p in ids else words_of(p))]
        return words_of(piece)

    def _learn(self, new: list[str]) -> None:
        plan = list(map(self._parts, new))
        words = list({w for p in plan for w in p if w.__class__ is bytes})
        output, merge = self.lexicon.output, self.merges.word
        ids = {
            w: output(k).tolist() if k >= 0 else merge(w)
            for w, k in zip(words, self.lexicon.find(words).tolist(), strict=True)
        }
        for piece, parts in zip(new, plan, strict=True):
            if len(parts) == 1 and parts[0].__class__ is bytes:
                out = ids[parts[0]]
            else:
                out = [i for p in parts for i in (ids[p] if p.__class__ is bytes else (p,))]
            self.ids[piece] = array("I", out).tobytes()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(ids of all texts as little-endian uint32, where each text's begin, decoded texts)."""
        if len(self.ids) > CACHE:
            self.ids.clear()
        lists, offsets = split_texts(texts)
        coded = lists.dictionary_encode()
        pieces, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self._learn(list(set(pieces).difference(self.ids)))
        parts = list(map(self.ids.__getitem__, pieces))
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool, begin = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(begin[at] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[offsets]
        rows = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), self.names.take(pa.array(ids)))
        return ids, bounds, pc.binary_join(rows, pa.scalar(" ", pa.large_string()))

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode() without a decoder: token texts joined by spaces."""
        return " ".join([self.merges.text[i] for i in ids])


@lru_cache(maxsize=1)
def shared_encoder(vocabulary: str, image: bytes) -> Encoder:
    """The worker's encoder, kept from task to task with the words that it has met."""
    return Encoder(vocabulary, image)


def encode_documents(docs: DataFrame, vocabulary: str, size: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text."""
    return _encoded(docs, vocabulary, size, digests=False)


def _encoded(docs: DataFrame, vocabulary: str, size: int, digests: bool) -> DataFrame:
    image = build_lexicon(docs, vocabulary, size)
    shape = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(vocabulary, image)
        for whole in batches:
            for batch in byte_chunks(whole, "text", 2_000_000):
                ids, at, decoded = encoder.batch(batch["text"])
                if digests:
                    parts = [ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
                    cols = [
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()),
                        pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded], pa.string()),
                    ]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                    cols, names = [lists, decoded.cast(pa.string())], ["doc_id", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols], names)

    return documents(docs).mapInArrow(run, f"doc_id long, {shape}")


def op3_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: digests of ids and decoded texts."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _encoded(docs, public_tokenizers.path("word_bpe_49k.json"), LEXICON_WORDS, digests=True)
