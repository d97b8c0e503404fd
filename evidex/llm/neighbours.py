"""Nearest neighbours by inner product: a forest of random-projection trees and exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.operators.scale import settled

TREES = 4
#: Vectors that a leaf holds about.
LEAF = 1024
#: Vectors the split planes are drawn from, and those of them that set how many leaves are opened.
SAMPLE, TRIALS = 20_000, 200
#: Share of the trials' true neighbours that the opened leaves must hold, and of each trial's own.
RECALL, TAIL = 0.96, 0.9
SEED = 97
#: Rows of one leaf, and queries of one, that one task takes.
LEAF_ROWS, LEAF_QUERIES = 20_000, 5_000


def usable(vector: Column) -> Column:
    """True for vectors with a component that is not zero and none that is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def _share(share: float, n: int) -> int:
    """Place of the last of the first ``share`` of ``n`` sorted values."""
    return max(0, min(n, int(np.ceil(share * n))) - 1)


class Forest:
    """Split planes: inner node k of a tree has the children 2k+1 and 2k+2; all leaves have one depth.

    Vectors get one more component that lifts them all to the length of the longest, so that
    a near direction means a large inner product; queries get 0 there.
    """

    def __init__(self, sample: np.ndarray, rows: int, longest: float, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        self.longest, self.trees = longest, trees
        sample = sample.astype(np.float64)
        lifted = self.lift(sample)
        wanted = max(1, -(-rows // leaf))
        self.depth = int(min(np.ceil(np.log2(wanted)), max(0, np.floor(np.log2(max(1, len(sample) / 4))))))
        inner = (1 << self.depth) - 1
        self.planes = np.zeros((trees, inner, lifted.shape[1]))
        self.offsets = np.zeros((trees, inner))
        rng = np.random.default_rng(seed)
        for t in range(trees):
            parts = {0: np.arange(len(lifted))}
            for k in range(inner):
                mine = parts.pop(k)
                plane = rng.standard_normal(lifted.shape[1])
                if len(mine) > 1:  # between two vectors of the node, if they differ
                    a, b = lifted[rng.choice(mine, 2, replace=False)]
                    plane = a - b if np.any(a != b) else plane
                plane /= np.linalg.norm(plane)
                side = self._side(lifted[mine], np.broadcast_to(plane, (len(mine), len(plane))))
                offset = float(np.median(side)) if len(mine) else 0.0
                self.planes[t, k], self.offsets[t, k] = plane, offset
                parts[2 * k + 1], parts[2 * k + 2] = mine[side <= offset], mine[side > offset]

    @staticmethod
    def _side(lifted: np.ndarray, planes: np.ndarray) -> np.ndarray:
        """Projections row by row: one rounding for fitting and placing, so equal vectors share every leaf."""
        return np.einsum("ij,ij->i", lifted, planes)

    def probes(self, sample: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS) -> int:
        """Leaves a query must open: the fewest that hold ``recall`` of the trials' true neighbours,
        and TAIL of them for all trials but one in twenty.

        Trials are the first vectors of the sample, held against all of it. Neighbours in the
        sample are farther than those among all rows, so this errs on the side of more.
        """
        sample = sample.astype(np.float64)
        leaves, places, tails = self.leaves(sample), [], []
        tried = sample[:trials]
        for at, ((order, _), score) in enumerate(zip(self.search(tried, self.trees << self.depth), tried @ sample.T, strict=True)):
            place = np.full((self.trees, 2 << self.depth), len(order))
            for n, (t, leaf) in enumerate(order):
                place[t, leaf] = n
            score[at] = -np.inf
            best = np.argsort(-score, kind="stable")[:min(k, len(sample) - 1)]
            found = np.sort(place[np.arange(self.trees), leaves[best]].min(1)).tolist()
            places += found
            tails += found[_share(TAIL, len(found)):][:1]
        places.sort()
        tails.sort()
        return 1 + max(places[_share(recall, len(places))], tails[_share(0.95, len(tails))]) if places else 1

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.longest ** 2 - (vectors ** 2).sum(1)))
        return np.hstack([vectors, rest[:, None]])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        lifted = self.lift(vectors.astype(np.float64))
        out = np.zeros((len(vectors), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                side = self._side(lifted, self.planes[t, node])
                node = 2 * node + 1 + (side > self.offsets[t, node])
            out[:, t] = node
        return out

    def search(self, queries: np.ndarray, probes: int, sizes: np.ndarray | None = None, least: int = 0) -> list[tuple[list[tuple[int, int]], int]]:
        """(tree, leaf) pairs of each query, and how many of them it takes to meet ``least`` rows.

        One queue for all trees, nearest planes crossed first. With ``sizes`` (tree, node), the rows
        of each leaf, leaves are opened until there are ``probes`` of them and those of one
        tree, which share no row, hold ``least`` rows, or all are open.
        """
        lifted = np.hstack([queries.astype(np.float64), np.zeros((len(queries), 1))])
        lifted *= self.longest / np.linalg.norm(lifted, axis=1, keepdims=True)
        inner = self.planes.shape[1]
        margin = (lifted @ self.planes.reshape(self.trees * inner, self.planes.shape[2]).T).reshape(len(queries), self.trees, inner) - self.offsets
        out = []
        for own in margin:
            sides = own.tolist()
            queue = [(0.0, t, 0) for t in range(self.trees)]
            found: list[tuple[int, int]] = []
            met, enough = [0] * self.trees, 0
            while queue and (len(found) < probes or not enough):
                worst, t, node = heapq.heappop(queue)
                while node < inner:
                    m = sides[t][node]
                    near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                    heapq.heappush(queue, (max(worst, abs(m)), t, far))
                    node = near
                found.append((t, node))
                met[t] += least if sizes is None else int(sizes[t, node])
                if not enough and met[t] >= least:
                    enough = len(found)
            out.append((found, enough or len(found)))
        return out


def _matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES,
           leaf: int = LEAF, recall: float = RECALL, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, leaf_queries: int = LEAF_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query row.

    ``is_query`` is a condition on ``id_col``. Every row but the query's own is a candidate and every row is
    indexed. The planes are fitted on ``sample`` rows, those of least id hash, and so is the number of
    leaves a query opens: as many as hold ``recall`` of the neighbours in the sample, and TAIL of
    them for 19 of 20 queries there. A query whose leaves are thin opens more, until it has met
    k + 1 rows of one tree, so each gets k rows, or all candidates if there are fewer. Scores are
    exact in double precision on the vectors as given; ties go to the smaller id. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, nor do those of another length
    than most have (ties: the shorter) and rows with a null id. Of several vectors of one id
    the least, component by component, counts, as candidate and as query. Other columns are not
    read; an empty table gives no rows.

    Of equal vectors only the k + 1 of smallest ids can be in a result, so the rest stays out of the
    leaves; that limit is applied before the shuffle. Rows of a leaf beyond ``leaf_rows`` are split by
    id, and so are its queries beyond ``leaf_queries``; each part of one meets each of the other. A
    leaf sends on its best k of each query, but, unless it is one of those a query needs to meet
    k rows or falls in itself, none below the query's k-th best in the sample, which bounds the k-th best of all.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"))
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    rows = settled(rows.filter(usable(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("long"))
    most = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not most:
        return spark.createDataFrame([], schema)
    d, count, longest = most[0].d, most[0].n, float(np.sqrt(most[0].long))
    rows = rows.filter(F.size("v") == d)
    same = Window.partitionBy("v").orderBy("vec_id")
    index = rows.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= k + 1).drop("_r")
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(sample, max(1, 4_000_000 // d))).collect()
    picked = list({r.vec_id: r.v for r in picked}.items())
    fitted = np.array([v for _, v in picked], np.float64)
    made = Forest(fitted, count, longest, trees, leaf)
    probes = made.probes(fitted, k, recall)
    forest = spark.sparkContext.broadcast((made, np.array([i for i, _ in picked]), fitted))  # bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = forest.value[0].leaves(_matrix(batch.column(1), d)) if batch.num_rows else np.zeros((0, trees), np.int64)
            for t in range(trees):
                yield pa.record_batch([pa.array(np.full(batch.num_rows, t)), pa.array(found[:, t]), batch.column(0), batch.column(1)], names=["tree", "leaf", "vec_id", "v"])

    kind = f"tree bigint, leaf bigint, vec_id bigint, v {rows.schema['v'].dataType.simpleString()}"
    placed = settled(index.mapInArrow(place, kind), "leaves")
    filled = placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
    held = np.zeros((trees, 2 << made.depth), np.int64)
    for r in filled.collect():  # a row per leaf, bounded by the sample
        held[r.tree, r.leaf] = r.n

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                planes, ids, known = forest.value
                queries = _matrix(part.column(1), d)
                score = queries @ known.T
                score[part.column(0).to_numpy()[:, None] == ids] = -np.inf
                bar = np.partition(score, -k, 1)[:, -k] if len(ids) >= k else np.full(len(queries), -np.inf)
                found = planes.search(queries, probes, held, k + 1)
                row = np.repeat(np.arange(part.num_rows), [len(f) for f, _ in found])
                pairs = np.array([p for f, _ in found for p in f], np.int64).reshape(-1, 2)
                near = np.concatenate([np.arange(len(f)) < max(enough, planes.trees) for f, enough in found])
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                                       pa.array(np.where(near, -np.inf, bar[row]))], names=["tree", "leaf", "vec_id", "v", "bar"])

    asked = rows.withColumnRenamed("vec_id", id_col).filter(is_query).withColumnRenamed(id_col, "vec_id").mapInArrow(ask, f"{kind}, bar double")
    asked = settled(asked, "asked")
    parts = filled.select("tree", "leaf", F.ceil(F.col("n") / leaf_rows).cast("int").alias("parts"))
    shares = asked.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / leaf_queries).cast("int").alias("shares"))
    split = F.broadcast(parts.join(shares, ["tree", "leaf"]))  # a row per leaf, bounded by the sample
    part, share = (F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int") for c in ("parts", "shares"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = placed.join(split, ["tree", "leaf"]).withColumn("part", part).withColumn("share", every("shares")).drop("parts", "shares")
    right = asked.join(split, ["tree", "leaf"]).withColumn("share", share).withColumn("part", every("parts")).drop("parts", "shares")

    def best(keys: tuple, held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(held) or not len(queries):
            return none
        ids, matrix, out = held["vec_id"].to_numpy(), np.stack(held["v"].to_numpy()).astype(np.float64), [none]
        for low in range(0, len(queries), 512):
            some = queries.iloc[low:low + 512]
            asking, who, bar = np.stack(some["v"].to_numpy()).astype(np.float64), some["vec_id"].to_numpy(), some["bar"].to_numpy()
            bar = np.where(np.isfinite(bar), bar - 1e-9 * (1 + np.abs(bar)), -np.inf)  # rounding
            i, j = np.nonzero((asking @ matrix.T >= bar[:, None]) & (who[:, None] != ids))
            for part in np.array_split(np.arange(len(i)), 1 + len(i) // 100_000):
                out.append(pd.DataFrame({"query_id": who[i[part]], "vec_id": ids[j[part]], "score": (asking[i[part]] * matrix[j[part]]).sum(1)}))
        every = pd.concat(out).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return every[every.groupby("query_id").cumcount() < k]

    group = ["tree", "leaf", "part", "share"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(best, "query_id bigint, vec_id bigint, score double")
    unique = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return unique.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
