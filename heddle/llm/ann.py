"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample (about ``sample`` distinct vectors, by hash); its leaves
grow in number with the table up to that bound. Every vector is indexed: it descends to its leaf.
Largest inner product becomes nearest distance by one more coordinate, sqrt(M^2 - |x|^2), with M the
largest norm of all vectors in the tree. The longest vectors of the table (at most ``TAIL``) are not in
the tree: every query is compared with all of them. A query walks the tree through a priority queue of bins by distance; the number of leaves it opens is
widened, doubling, until calibration queries reach the asked recall against brute force over the
sample, the query itself left out. Each query also carries the k-th best score among the sample's vectors in those leaves, a lower
bound: a leaf returns only what reaches it, so few candidate rows leave a task. Neighbouring leaves are bundled up to about
``BUNDLE`` vectors: a query is sent once to each bundle, with the leaves it opens there, and compared with those leaves. A bundle
that many queries open, or of a leaf that holds many vectors, is dealt into blocks of about ``QUERIES`` queries and ``VECTORS``
vectors, and each pair of blocks is one group. What the driver gathers is a count for each leaf, bounded by the sample.

Equal vectors are one class, searched once; their members come in again at the end, only the k + 1
smallest ids of each, since no more can be among the k nearest of a query.

Defined results
---------------
* vectors that are null, zero, of another length than most, or hold null or non-finite components
  take no part, as queries or as candidates.
* fewer than k other vectors: all of them. Ties go to the smaller vec_id. vec_id is a key; repeated
  equal rows count once. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.common import materialise

SAMPLE = 32_768
LEAF = 512
TAIL = 1024
BRANCH = 8
#: About how many queries and vectors meet in one group.
QUERIES, VECTORS = 4096, 16_384
#: About how many vectors the leaves of a bundle hold together.
BUNDLE = 4096


@dataclass
class Tree:
    """Inner nodes are rows of ``child`` (node ids, or -1 - leaf); ``centre`` holds every child's centre."""

    child: list[list[int]]
    centre: list[np.ndarray]
    leaves: int
    scale: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that turns inner products into distances."""
        rest = np.sqrt(np.maximum(self.scale**2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at every level."""
        y, out = self.lift(x), np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.child[node]:
                out[rows] = 0
                continue
            c = self.centre[node]
            pick = ((c * c).sum(axis=1) - 2 * y[rows] @ c.T).argmin(axis=1)
            for i, k in enumerate(self.child[node]):
                some = rows[pick == i]
                if k < 0:
                    out[some] = -1 - k
                else:
                    todo.append((k, some))
        return out

    def visit(self, q: np.ndarray, leaves: int, held: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first leaves that best-bin-first search opens for a query; more until they hold ``need`` of ``held``."""
        y, out, have = np.append(q, 0.0), [], 0
        heap = [(0.0, 0)]
        while heap and (len(out) < leaves or have < need):
            _, node = heapq.heappop(heap)
            if node < 0 or not self.child[node]:
                out.append(-1 - node if node < 0 else 0)
                have += int(held[out[-1]]) if need else 0
                continue
            far = ((self.centre[node] - y) ** 2).sum(axis=1)
            for d, k in zip(far.tolist(), self.child[node], strict=True):
                heapq.heappush(heap, (d, k))
        return out


def _split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """k-means with BRANCH centres: (centre of each group, group of each row)."""
    centre = x[rng.choice(len(x), min(BRANCH, len(x)), replace=False)]
    group = np.zeros(len(x), np.int64)
    for _ in range(8):
        group = ((centre * centre).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)
        kept = np.unique(group)
        centre = np.stack([x[group == g].mean(axis=0) for g in kept])
    group = ((centre * centre).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)
    return centre, group


def grow(x: np.ndarray, leaf_rows: int, scale: float, seed: int = 3) -> Tree:
    """The tree of the sample, split until a leaf holds ``leaf_rows`` of it or cannot be split."""
    tree, rng = Tree([[]], [np.zeros((0, x.shape[1] + 1))], 1, scale), np.random.default_rng(seed)
    if len(x) <= leaf_rows:
        return tree
    y, tree.leaves = tree.lift(x), 0
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        centre, group = _split(y[rows], rng)
        tree.centre[node], ids = centre, []
        for g in range(len(centre)):
            some = rows[group == g]
            if len(some) <= leaf_rows or len(some) == len(rows):
                ids.append(-1 - tree.leaves)
                tree.leaves += 1
            else:
                tree.child.append([])
                tree.centre.append(np.zeros((0, y.shape[1])))
                ids.append(len(tree.child) - 1)
                todo.append((len(tree.child) - 1, some))
        tree.child[node] = ids
    return tree


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float, queries: int = 128) -> int:
    """The leaves to open, widened until sample queries reach ``recall`` against brute force over the sample."""
    leaf = tree.leaf_of(x)
    pick = np.random.default_rng(5).choice(len(x), min(queries, len(x)), replace=False)
    score = x[pick] @ x.T
    score[np.arange(len(pick)), pick] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    order = [tree.visit(x[i], tree.leaves) for i in pick]
    n = 1
    while n < tree.leaves:
        hit = [np.isin(leaf[b], o[:n]).mean() for b, o in zip(best, order, strict=True) if len(b)]
        if not hit or np.mean(hit) >= recall:
            break
        n = min(tree.leaves, max(n + 1, n * 5 // 4))
    return n


def usable(column: str) -> Column:
    """Whether a vector takes part (its length aside)."""
    c, bad = F.col(column), (float("inf"), float("-inf"))
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & ~v.isin(*bad))
    return F.coalesce(c.isNotNull() & fine & F.exists(c, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of an Arrow list column of equal lengths, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def norm_step(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The squared norm of each vector, and its step on a fine logarithmic scale."""
    square = (x * x).sum(axis=1)
    return square, np.floor(np.log2(np.maximum(square, 1e-300)) * 32).astype(np.int64)


def longest(classes: DataFrame, most: int) -> tuple[list, int | None, float]:
    """The rows of the longest vectors, whole steps of norm and at most ``most`` rows; the least step; the norm of the rest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                square, step = norm_step(matrix(b["embedding"]))
                steps, at = np.unique(step, return_inverse=True)
                top = np.zeros(len(steps))
                np.maximum.at(top, at, square)
                yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(np.bincount(at)), pa.array(top)], ["step", "n", "top"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(norm_step(matrix(b["embedding"]))[1] >= least))

    steps = classes.select("embedding").mapInArrow(count, "step long, n long, top double")
    steps = steps.groupBy("step").agg(F.sum("n").alias("n"), F.max("top").alias("top")).collect()
    left, least, scale = most, None, 0.0
    for r in sorted(steps, key=lambda r: -r["step"]):
        if r["n"] > left:
            scale = float(np.sqrt(r["top"]))
            break
        left, least = left - r["n"], r["step"]
    if least is None:
        return [], None, scale
    few = classes.select("rep", "embedding")
    return few.mapInArrow(pick, few.schema).collect(), least, scale


def bundles(counts: np.ndarray, target: int) -> np.ndarray:
    """Each leaf's bundle: leaves in their order, a new bundle where the last one holds ``target`` vectors."""
    out, held = np.zeros(len(counts), np.int64), 0
    for leaf in range(1, len(counts)):
        held += counts[leaf - 1]
        new = held >= target
        out[leaf] = out[leaf - 1] + new
        held = 0 if new else held
    return out


def looked_up(values: np.ndarray, at: Column) -> Column:
    """The value at a place of a small list that becomes one constant of the plan."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), at.cast("int"))


def neighbours(vectors: DataFrame, queries: Column, k: int = 20, recall: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product of the rows where ``queries`` holds."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    rows = rows.filter(usable("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes or not k:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("embedding") == sizes[0]["d"])
    classes = rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.max(queries).alias("asked"))
    classes = materialise(spark, classes, "classes")

    total = classes.count()
    share = F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, sample / max(1, total))))
    few = classes.filter(share).select("rep", "embedding").collect()  # the bounded sample: about `sample` vectors
    far, least, scale = longest(classes, min(TAIL, total // 16))
    far = sorted(far, key=lambda r: r["rep"])
    far_rep = np.array([r["rep"] for r in far], np.int64)
    far_x = np.array([r["embedding"] for r in far], np.float64).reshape(-1, sizes[0]["d"])
    x = np.array([r["embedding"] for r in sorted(few, key=lambda r: r["rep"])], np.float64).reshape(-1, sizes[0]["d"])
    if least is not None:
        x = x[norm_step(x)[1] < least]
    wanted = max(1, min(total // LEAF, len(x) // 4))  # leaves follow the table up to the sample's bound
    tree = grow(x, max(4, len(x) // wanted), scale)
    opened = calibrate(tree, x, k, recall)
    at_leaf = tree.leaf_of(x)
    held = np.bincount(at_leaf, minlength=tree.leaves)
    members = np.split(np.argsort(at_leaf, kind="stable"), np.cumsum(held)[:-1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and least is not None:
                b = b.filter(pa.array(norm_step(matrix(b["embedding"]))[1] < least))
            if b.num_rows:
                leaf = pa.array(tree.leaf_of(matrix(b["embedding"])), pa.int64())
                yield pa.RecordBatch.from_arrays([leaf, b["rep"], b["embedding"]], ["leaf", "rep", "embedding"])

    indexed = classes.select("rep", "embedding").mapInArrow(place, f"leaf long, rep long, embedding {kind}")
    indexed = materialise(spark, indexed, "indexed")
    filed = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # a row for each leaf: their number is bounded by the sample's
        filed[r["leaf"]] = r["count"]
    bundle = bundles(filed, BUNDLE)
    vs = np.maximum(1, -(-np.bincount(bundle, weights=filed).astype(np.int64) // VECTORS))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                q = matrix(b["embedding"])
                visits = [tree.visit(v, opened, held, k + 1) for v in q]
                sent = []  # query, bundle and opened leaves
                bound = np.full(len(q), -np.inf)
                for i, leaves in enumerate(visits):
                    # the (k + 1)-th best of the sample in the opened leaves, the query's own class included
                    have = np.concatenate([x[np.concatenate([members[leaf] for leaf in leaves])] @ q[i], far_x @ q[i]])
                    if len(have) > k:
                        bound[i] = np.partition(have, -k - 1)[-k - 1]
                    leaves = np.sort(np.asarray(leaves, np.int64))  # bundles are runs of leaves
                    which, first = np.unique(bundle[leaves], return_index=True)
                    sent += [(i, w, part) for w, part in zip(which, np.split(leaves, first[1:]), strict=True)]
                row = np.array([i for i, _, _ in sent], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array([w for _, w, _ in sent], np.int64)),
                        pa.array([part for _, _, part in sent], pa.list_(pa.int64())),
                        b["rep"].take(pa.array(row)),
                        pa.array(bound[row]),
                        b["embedding"].take(pa.array(row)),
                    ],
                    ["bundle", "leaves", "query", "bound", "vector"],
                )

    asked = classes.filter("asked").select("rep", "embedding")
    parts = max(1, asked.count() // 256)  # walking the tree is the cost, not the bytes
    routed = asked.repartition(parts, F.xxhash64("rep")).mapInArrow(
        route, f"bundle long, leaves array<long>, query long, bound double, vector {kind}"
    )
    routed = materialise(spark, routed, "routed")
    qs = np.ones(len(vs), np.int64)
    for r in routed.groupBy("bundle").count().collect():  # a row for each bundle, of which there are fewer than leaves
        qs[r["bundle"]] = -(-r["count"] // QUERIES)

    def blocks(n: np.ndarray) -> Column:
        """Every block number of a row's bundle."""
        return F.explode(F.sequence(F.lit(0), looked_up(n, F.col("bundle")) - 1))

    def block_of(key: str, n: np.ndarray) -> Column:
        return F.pmod(F.xxhash64(key), looked_up(n, F.col("bundle"))).cast("int")

    group = ["bundle", "q", "v"]
    q_side = routed.withColumn("q", block_of("query", qs)).withColumn("v", blocks(vs)).select(*group, "query", "leaves", "bound", "vector")
    v_side = indexed.withColumn("bundle", looked_up(bundle, F.col("leaf")).cast("long")).withColumn("v", block_of("rep", vs))
    v_side = v_side.withColumn("q", blocks(qs)).select(*group, "leaf", "rep", "embedding")

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": [], "rep": [], "score": []}).astype({"query": "int64", "rep": "int64"})
        if not len(q) or not len(v):
            return none
        a = np.stack(q["vector"].to_numpy()).astype(np.float64)
        b = np.stack(v["embedding"].to_numpy()).astype(np.float64)
        leaf = v["leaf"].to_numpy()
        low = leaf.min()
        opened = np.zeros((len(q), leaf.max() - low + 1), bool)
        n = q["leaves"].map(len).to_numpy()
        mine = np.concatenate(q["leaves"].to_numpy()) - low
        within = (mine >= 0) & (mine < opened.shape[1])  # a block may hold no vector of a bundle's first or last leaves
        opened[np.repeat(np.arange(len(q)), n)[within], mine[within]] = True
        out = []
        for at in range(0, len(a), 512):
            s = a[at : at + 512] @ b.T
            enough = s >= (q["bound"].to_numpy()[at : at + 512] - 1e-9)[:, None]
            i, j = np.nonzero(enough & opened[at : at + 512][:, leaf - low])
            out.append((q["query"].to_numpy()[at + i], v["rep"].to_numpy()[j], np.einsum("nd,nd->n", a[at + i], b[j])))
        return pd.DataFrame(dict(zip(("query", "rep", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = q_side.groupBy(*group).cogroup(v_side.groupBy(*group)).applyInPandas(search, "query long, rep long, score double")

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                q = matrix(b["embedding"])
                s = q @ far_x.T
                cut = min(k + 1, s.shape[1])
                kth = np.partition(s, s.shape[1] - cut, axis=1)[:, s.shape[1] - cut]
                i, j = np.nonzero(s >= kth[:, None] - 1e-9)
                score = np.einsum("nd,nd->n", q[i], far_x[j])
                yield pa.RecordBatch.from_arrays(
                    [b["rep"].take(pa.array(i)), pa.array(far_rep[j]), pa.array(score)], ["query", "rep", "score"]
                )

    if len(far):
        found = found.unionAll(asked.mapInArrow(tail, "query long, rep long, score double"))
    near = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = found.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= k + 1).drop("_r")

    ids = rows.join(classes.select("rep", "embedding"), "embedding").select("rep", "vec_id").distinct()
    ids = materialise(spark, ids, "members")
    lowest = Window.partitionBy("rep").orderBy("vec_id")
    lead = ids.withColumn("_r", F.row_number().over(lowest)).filter(F.col("_r") <= k + 1).drop("_r")
    wide = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        found.join(lead, "rep")
        .withColumn("_r", F.row_number().over(wide))
        .filter(F.col("_r") <= k + 1)
        .select(F.col("query").alias("rep"), "vec_id", "score")
    )
    own = ids.filter(queries).select("rep", F.col("vec_id").alias("query_id"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        own.join(lists, "rep")
        .filter("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the 20 nearest of each vector whose vec_id is divisible by 20."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
