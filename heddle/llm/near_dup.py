"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch: the coordinates of a text are bins. In round i each shingle is hashed into one bin with a
value that is larger in later rounds, and a bin keeps its smallest value; after ``t`` rounds, round
t + j offers every shingle to bin j alone, so every coordinate fills. A pair of texts agrees in each
coordinate with probability equal to their Jaccard similarity, and the number of agreements is
concentrated as under independent sampling; a large text fills its bins in one or two rounds.

Linking: equal shingle sets become one class. Classes that share a band of ``rows`` coordinates are
candidates; with the defaults a pair at 0.8 is missed with probability 1.2e-6. Within a bucket the
candidates are first compared with its smallest class only (a star), then, in buckets that still hold several components, with
its best connected one. The texts of buckets that even then hold several components are looked at by prefixes: with every set ordered by rising frequency of
its shingles, two sets that reach the similarity share a shingle among the first fifth of each (for 0.8),
whatever the order. This is exact, and frequent shingles, which a template repeats, seldom stand that far
in front. Two texts of different components become a pair if the places of a shingle that both have in front, their sizes and
the parities of their sets leave room for the similarity; no such bound drops a pair that reaches it.
Every link is confirmed on the full sets, made again from the texts. Groups are connected components.
Hot keys (a bucket, a class of copies, a star's centre) are split over tasks.

Defined results
---------------
* null or empty text, or one without words: an empty set, linked with nothing, its own group.
* fewer words than a shingle has: one shingle, the whole sequence.
* doc_id identifies a text; repeated equal rows give equal result rows. Very long texts count whole.
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import byte_chunks, documents, materialise, mix64, spread_join, utf8, with_ids
from heddle.llm.components import components
from heddle.llm.words import GOLD, salted, shingles

BANDS, ROWS = 45, 6
CHUNK = 1_000_000
#: Rows of one shingle that a task compares with the others in front of which it stands; shingles of more are dealt over tasks.
BLOCK = 2048
#: Rounds in which mixed buckets are compared with their best connected member.
CENTRES = 1
#: Cells of the table of shingle frequencies (by hash; 2 MB): it only orders the shingles.
CELLS = 1 << 18
#: Numbers of 64 bits that hold a set's parities: a bit says whether the set has an odd number of the shingles hashed to it.
SIGNS = 8


def sketch(value: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """(texts, t) coordinates of the sets value[first[i]:first[i + 1]]; texts must not be empty."""
    size = np.diff(first)
    docs = len(size)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    bins = np.full(docs * t, empty, np.uint64)
    value, owner = value, np.repeat(np.arange(docs), size)
    for i in range(2 * t):
        h = mix64(value + salted(i + 1))
        mark = np.uint64(i) << np.uint64(32) | h >> np.uint64(32)
        bin_ = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(bins, owner * t + bin_, mark)
        if i % 2 or i >= t or len(value) > 20_000:
            open_ = (bins.reshape(docs, t) == empty).any(axis=1)
            if not open_.any():
                break
            keep = open_[owner]
            value, owner = value[keep], owner[keep]
    return bins.reshape(docs, t)


def band_keys(coords: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) hashes of each band's coordinates, different in each band."""
    parts = coords.reshape(len(coords), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * GOLD + np.zeros((len(coords), 1), np.uint64)
    for j in range(rows):
        key = mix64(key * GOLD + parts[:, :, j])
    return key.view(np.int64)


def sketches(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, s1, s2, keys): set size, two hashes of the whole set and the band keys (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_chunks(whole, "text", CHUNK):
                value, first = shingles(*utf8(batch["text"]), words)
                n = np.diff(first)
                digest = []
                for salt in (1, 2):
                    sums = np.zeros(len(value) + 1, np.uint64)
                    np.cumsum(mix64(value ^ salted(salt)), dtype=np.uint64, out=sums[1:])
                    digest.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
                some = np.flatnonzero(n)
                keys = band_keys(sketch(value, np.concatenate([first[some], first[-1:]]), bands * rows), bands, rows)
                ends = np.cumsum(np.where(n > 0, bands, 0))
                column = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys.ravel(), pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(n, pa.int64()), *map(pa.array, digest), column],
                    ["doc_id", "n", "s1", "s2", "keys"],
                )

    return documents(docs).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys array<long>")


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those (a, b) of a written table whose full sets have 100 * intersection >= percent * union.

    Only texts of the pairs move. A task reads sorted rows: a text b once, then the texts a to compare with it; a b of
    very many pairs stands in several tasks, with a part of them in each.
    """
    need = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    few = with_ids(documents(texts), need)
    total = pairs.count()
    limit = max(1024, total // 10_000)
    many = pairs.groupBy("b").agg(F.count("*").alias("m"))
    hot = F.broadcast(many.filter(F.col("m") > limit).select("b", F.ceil(F.col("m") / limit).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    left = spread_join(pairs, few.select(F.col("doc_id").alias("a"), "text"), ["a"], total).join(hot, "b", "left")
    left = left.select("b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"), F.lit(True).alias("pair"), "a", "text")
    right = few.join(many.select(F.col("b").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("b"), "text")
    right = right.join(hot, "b", "left").select(
        "b",
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
        F.lit(False).alias("pair"),
        F.lit(None).cast("long").alias("a"),
        "text",
    )
    rows = left.unionByName(right).repartition("b", "part").sortWithinPartitions("b", "part", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.zeros(0, np.uint64)
        for whole in batches:
            for batch in byte_chunks(whole, "text", CHUNK):
                pair, b = batch["pair"].to_pylist(), batch["b"].to_pylist()
                a = batch["a"].to_pylist()
                value, first = shingles(*utf8(batch["text"]), words)
                found = []
                for i, is_pair in enumerate(pair):
                    x = value[first[i] : first[i + 1]]
                    if not is_pair:
                        y = x
                    elif len(x) and len(y) and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                        common = int((y[at] == x).sum())
                        if 100 * common >= percent * (len(x) + len(y) - common):
                            found.append((a[i], b[i]))
                cols = zip(*found, strict=True) if found else [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return rows.select("b", "pair", "a", "text").mapInArrow(run, "a long, b long")


def _cell(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - (CELLS - 1).bit_length())).astype(np.int64)


def frequencies(texts: DataFrame, words: int) -> np.ndarray:
    """How many sets hold a shingle of each cell; ``CELLS`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int64)
        for whole in batches:
            for batch in byte_chunks(whole, "text", CHUNK):
                seen += np.bincount(_cell(shingles(*utf8(batch["text"]), words)[0]), minlength=CELLS)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["cell", "n"])

    rows = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[rows["cell"]] = rows["n"]
    return out


def parities(value: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """(texts, SIGNS) parities; two sets differ in at least as many shingles as their parities do in bits."""
    out = np.zeros((texts, SIGNS), np.uint64)
    bit = np.uint64(1) << (value & np.uint64(63))
    np.bitwise_xor.at(out, (owner, (value >> np.uint64(6)).astype(np.int64) % SIGNS), bit)
    return out.view(np.int64)


def prefixes(rows: DataFrame, order: np.ndarray, words: int, percent: int) -> DataFrame:
    """(h, rep, component, n, p, s0...) of ``rows`` (rep, component, text): the n - ceil(t n) + 1 rarest shingles of each set.

    A set x that reaches t with y has at least t |x| shingles in common with it, so the two prefixes meet. n is the set's
    size, p the shingle's place in it (from 0), s0... its parities.
    """
    signs = [f"s{i}" for i in range(SIGNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_chunks(whole, "text", CHUNK):
                value, first = shingles(*utf8(batch["text"]), words)
                size = np.diff(first)
                owner = np.repeat(np.arange(len(size)), size)
                parity = parities(value, owner, len(size))
                sort = np.lexsort((value, order[_cell(value)], owner))
                value, owner = value[sort], owner[sort]
                n, place = size[owner], np.arange(len(value)) - first[owner]
                keep = place < n + 1 + (-percent * n) // 100
                value, n, place, owner = (x[keep] for x in (value, n, place, owner))
                at = pa.array(owner)
                columns = [pa.array(value.view(np.int64)), batch["rep"].take(at), batch["component"].take(at), pa.array(n), pa.array(place)]
                columns += [pa.array(parity[owner, i]) for i in range(SIGNS)]
                yield pa.RecordBatch.from_arrays(columns, ["h", "rep", "component", "n", "p", *signs])

    return rows.mapInArrow(run, "h long, rep long, component long, n long, p long, " + ", ".join(f"{s} long" for s in signs))


def prefix_pairs(front: DataFrame, percent: int) -> DataFrame:
    """Different pairs (a, b) of a written table of prefixes, of different components, that may reach the similarity.

    The first shingle that two sets share in the common order has all others behind it, so what is behind it in either
    set bounds the intersection, and so do the sets' parities. The shorter set is looked up with the places that still leave
    room for a set of its own size, in classes of sizes (a power of 1.25) up to the largest that fits.
    """
    room = lambda size, place: (100 + percent) * (F.col(size) - F.col(place))
    step = lambda n: F.floor(F.log(n) / float(np.log(1.25))).cast("int")
    most = (room("n", "p") / percent - F.col("n")) * (1 + 1e-9)  # the largest set that fits
    short = front.filter(room("n", "p") >= 2 * percent * F.col("n"))
    short = short.withColumn("g", F.explode(F.sequence(step(F.col("n")), step(most))))
    long = front.withColumn("g", step(F.col("n"))).select("h", "g", *(F.col(c).alias(f"_{c}") for c in front.columns if c != "h"))
    both = F.col("n") + F.col("_n")
    differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"_s{i}"))) for i in range(SIGNS)), F.lit(0))
    fit = (
        (F.col("component") != F.col("_component"))
        & ((F.col("n") < F.col("_n")) | (F.col("n") == F.col("_n")) & (F.col("rep") < F.col("_rep")))
        & (room("n", "p") >= percent * both)
        & (room("_n", "_p") >= percent * both)
        & ((100 + percent) * (both - differ) >= 2 * percent * both)
    )
    met = spread_join(short, long, ["h", "g"], front.count(), spread=BLOCK).filter(fit)
    return met.select(F.greatest("rep", "_rep").alias("a"), F.least("rep", "_rep").alias("b")).distinct()


def family_links(rest: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b): all pairs of texts of ``rest`` (rep, component) that reach the similarity and are of different components."""
    spark = rest.sparkSession
    few = with_ids(documents(texts), rest.select(F.col("rep").alias("doc_id")))
    named = few.withColumnRenamed("doc_id", "rep").join(rest, "rep").select("rep", "component", "text")
    named = materialise(spark, named, "rest-texts")
    front = materialise(spark, prefixes(named, frequencies(named, words), words, percent), "prefixes")
    pairs = materialise(spark, prefix_pairs(front, percent), "prefix-pairs")
    return verify(pairs, named.select(F.col("rep").alias("doc_id"), "text"), words, percent)


def mixed_members(members: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """(key, size, rep, component) of the buckets that hold several components; ``members`` (key, rep) has ``total`` rows."""
    spark = members.sparkSession
    named = members.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component")
    )
    named = materialise(spark, named, "named")
    mixed = named.groupBy("key").agg(F.count("*").alias("_n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = materialise(spark, mixed.filter("_n > 2 and lo <> hi").select("key", "_n", F.col("_n").alias("size")), "mixed")
    return materialise(spark, spread_join(named, mixed.select("key", "size"), ["key"], total, hot=mixed.select("key", "_n")), "rest")


def centre_pairs(spark: SparkSession, rest: DataFrame) -> DataFrame:
    """(a, b): each member of a mixed bucket with the bucket's best connected member b, where they are of different components.

    Best connected is who shares its buckets with most others: the text that near copies were made from, if it is there, since it
    has the coordinates that most of them kept. So one round of as many comparisons as there are members joins most of a family.
    """
    score = rest.groupBy("rep").agg(F.sum("size").alias("score"))
    scored = rest.join(score, "rep")
    best = F.max_by(F.struct("rep", "component"), F.struct("score", -F.col("rep"))).alias("best")
    centre = scored.groupBy("key").agg(best, F.count("*").alias("_n"))
    centre = materialise(spark, centre.select("key", F.col("best.rep").alias("b"), F.col("best.component").alias("of"), "_n"), "centres")
    pairs = spread_join(rest.select("key", "rep", "component"), centre.drop("_n"), ["key"], rest.count(), hot=centre.select("key", "_n"))
    return materialise(spark, pairs.filter("component <> of").select(F.col("rep").alias("a"), "b").distinct(), "centre-pairs")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id linked, directly or not."""
    spark = docs.sparkSession
    found = materialise(spark, sketches(docs, words, bands, rows), "sketches")
    some = found.filter("n > 0")
    classes = materialise(
        spark, some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.any_value("keys").alias("keys")), "sets"
    )
    cells = classes.select("rep", F.explode("keys").alias("key"))
    shared = cells.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("_n")).filter("_n > 1")
    shared = materialise(spark, shared, "buckets")
    n_cells = classes.count() * bands
    members = spread_join(cells, shared.select("key", "first"), ["key"], n_cells, hot=shared.select("key", "_n"))
    members = materialise(spark, members, "members")

    stars = materialise(
        spark, members.filter("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct(), "star"
    )
    links = materialise(spark, verify(stars, docs, words, percent), "links")
    labels = components(links)

    # buckets that still hold several components: their members are compared with the best connected one, and what is left across components
    n_members = members.count()
    for turn in range(CENTRES + 1):
        rest = mixed_members(members, labels, n_members)
        if not rest.limit(1).count():
            break
        if turn < CENTRES:
            more = verify(centre_pairs(spark, rest), docs, words, percent)
        else:
            more = family_links(rest.select("rep", "component").distinct(), docs, words, percent)
        links = materialise(spark, links.unionAll(more), "links")
        labels = components(links)

    reps = classes.select("s1", "s2", "n", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("s1", "s2", "n", F.coalesce("component", "rep").alias("component_id"))
    named = spread_join(found.select("doc_id", "s1", "s2", "n"), reps, ["s1", "s2", "n"], found.count(), "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_fast_similarity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: two-word shingles, similarity of 0.8 or more."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))
