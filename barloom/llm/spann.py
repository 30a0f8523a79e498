"""Nearest neighbours by balanced posting lists.

Lists come from a balanced hierarchical split of a bounded sample. A vector near the border of several lists is put into each of them,
unless a list already taken lies closer to the next one than the vector does. Centroids are searched by best-first steps in a neighbour
graph that every task holds in memory; a query reads the lists whose distance is within a ratio of the nearest one's. Lists
are scanned in chunks, so a long list is many small groups and nothing is left out of it. Scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import written

#: Vectors the lists are fitted on at most (those with the smallest hash).
SAMPLE = 32_768
#: Vectors aimed at per list; the number of lists is also at most SAMPLE / 16.
LIST = 128
#: Copies of a border vector at most, and how much farther than the nearest list another may be.
COPIES, BORDER = 4, 0.1
#: Lists a query reads at most, how much farther than the nearest they may be, and vectors it must reach at least.
PROBES, RATIO, LEAST = 192, 0.22, 256
DEGREE, BEAM = 24, 32
#: Vectors of a list, and queries to it, in one group.
CHUNK, BLOCK = 4_096, 2_048


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def balanced_split(x: np.ndarray, parts: int, seed: int = 3) -> list[np.ndarray]:
    """Index sets of `parts` clusters of nearly equal size: halves by the difference of distances to two means, again and again."""
    done, todo = [], [(np.arange(len(x)), parts, seed)]
    while todo:
        at, k, s = todo.pop()
        if k <= 1 or len(at) < 2:
            done.append(at)
            continue
        rng, own = np.random.default_rng(s), x[at]
        first = own[rng.integers(len(own))]
        a = own[np.argmin(own @ first)]
        b = own[np.argmin(own @ a)]
        left = k // 2
        cut = max(1, min(len(at) - 1, round(len(at) * left / k)))
        for _ in range(6):
            order = np.argsort(own @ (b - a), kind="stable")
            a, b = own[order[:cut]].mean(axis=0), own[order[cut:]].mean(axis=0)
        todo += [(at[order[:cut]], left, 2 * s + 1), (at[order[cut:]], k - left, 2 * s + 2)]
    return done


@dataclass(frozen=True)
class Index:
    """Centroids (unit vectors), their neighbour graph and entry points."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each unit vector the `k` nearest centroids found and their distances, nearest first, by steps along the graph."""
        n, c = len(x), self.centroids
        beam = min(max(BEAM, 3 * k // 2), len(c))
        if len(c) <= beam:  # the beam holds every centroid
            near = np.repeat(np.arange(len(c))[None], n, axis=0)
            sims = x @ c.T
        else:
            sims = x @ c[self.entries].T
            near = np.repeat(self.entries[None], n, axis=0)
            room = ((0, 0), (0, max(beam - near.shape[1], 0)))  # places not filled yet hold no centroid
            near, sims = np.pad(near, room, constant_values=-1), np.pad(sims, room, constant_values=-np.inf)
            near, sims, fresh = self._best(near, sims, near >= 0, beam)
            rows = np.arange(n)
            while True:
                # the best node of each row that has not been expanded yet
                pick = np.argmax(np.where(fresh, sims, -np.inf), axis=1)
                active = fresh[rows, pick]
                if not active.any():
                    break
                r = rows[active]
                fresh[r, pick[active]] = False
                more = self.graph[near[r, pick[active]]]
                known = (more[:, :, None] == near[r][:, None, :]).any(axis=2)
                s = np.einsum("ijk,ik->ij", c[more], x[r])
                s[known] = -np.inf
                near[r], sims[r], fresh[r] = self._best(np.hstack([near[r], more]), np.hstack([sims[r], s]), np.hstack([fresh[r], ~known]), beam)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
        return near, np.sqrt(np.maximum(2 - 2 * sims, 0))  # infinite where fewer were found

    @staticmethod
    def _best(near, sims, fresh, beam):
        order = np.argpartition(-sims, min(beam, sims.shape[1]) - 1, axis=1)[:, :beam]
        fresh = np.take_along_axis(fresh, order, 1)
        sims = np.take_along_axis(sims, order, 1)
        return np.take_along_axis(near, order, 1), sims, fresh & np.isfinite(sims)

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and lists: each vector in its nearest list and in those near its border."""
        near, dist = self.search(x, min(3 * COPIES, len(self.centroids)))
        taken = np.zeros(near.shape, bool)
        taken[:, 0] = True
        for j in range(1, near.shape[1]):
            ok = (dist[:, j] <= (1 + BORDER) * dist[:, 0]) & (taken.sum(axis=1) < COPIES)
            for i in range(j):
                apart = np.sqrt(np.maximum(2 - 2 * (self.centroids[near[:, i]] * self.centroids[near[:, j]]).sum(axis=1), 0))
                ok &= ~(taken[:, i] & (apart < dist[:, j]))
            taken[:, j] = ok
        rows, at = np.nonzero(taken)
        return rows, near[rows, at]

    def probes(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and lists a query reads: within the distance ratio, and more while they hold fewer than LEAST vectors."""
        near, dist = self.search(x, min(PROBES, len(self.centroids)))
        held = np.cumsum(sizes[near], axis=1) - sizes[near]
        rows, at = np.nonzero(((dist <= (1 + RATIO) * dist[:, :1] + 1e-9) | (held < LEAST)) & np.isfinite(dist))
        return rows, near[rows, at]


def fit(sample: np.ndarray, total: int) -> Index:
    """The index from sampled vectors, for `total` vectors."""
    x = unit(sample)
    parts = int(max(1, min(-(-total // LIST), len(x) // 16 or 1)))
    means = np.array([x[at].mean(axis=0) for at in balanced_split(x, parts)])
    norms = np.sqrt((means * means).sum(axis=1))
    c = means / np.where(norms > 1e-12, norms, 1.0)[:, None]
    sims = c @ c.T
    np.fill_diagonal(sims, -np.inf)
    degree = min(DEGREE, len(c) - 1)
    graph = np.argsort(-sims, axis=1, kind="stable")[:, : degree // 2 or degree]
    rng = np.random.default_rng(5)
    far = rng.integers(len(c), size=(len(c), max(degree - graph.shape[1], 0)))  # a few long links keep the graph connected
    entries = rng.permutation(len(c))[: min(BEAM, len(c))]
    return Index(c, np.hstack([graph, far]) if len(c) > 1 else np.zeros((1, 1), int), entries)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(v: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """`class_id, v, ids`: each distinct vector with its smallest id and its k + 1 smallest ids, which are all a search can return."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    rows = vectors.withColumn("place", place).where(F.col("place") <= k + 1)
    return rows.groupBy("v").agg(F.min("vec_id").alias("class_id"), F.array_sort(F.collect_list("vec_id")).alias("ids")).select("class_id", "v", "ids")


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`query_id, rank, vec_id, score`: for each query row its k nearest other rows found, by cosine, ties to smaller ids.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids and vectors whose length is not
    the commonest one. Equal vectors are searched once; rows that repeat an id with the same vector count once. Other
    columns are not looked at; without usable vectors the result is empty.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    spark = vectors.sparkSession
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = common["dim"]
    rows = rows.where(F.size("v") == dim).groupBy("vec_id", "v").agg(F.bool_or("q").alias("q"))
    classes = written(distinct_vectors(rows.select("vec_id", "v"), k), "classes")
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("v"), "class_id").limit(SAMPLE).select("v").toArrow()
    index = spark.sparkContext.broadcast(fit(_matrix(sample["v"], dim), total))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                r, lists = index.value.lists(unit(_matrix(batch.column(1), dim)))
                taken = batch.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), taken.column(0), taken.column(1)], ["list", "class_id", "v"])

    kind = classes.schema["v"].dataType.simpleString()
    postings = written(classes.select("class_id", "v").mapInArrow(place, f"list int, class_id bigint, v {kind}"), "postings")
    sizes = np.zeros(len(index.value.centroids), np.int64)  # one number a list, a bounded number of lists
    for r in postings.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    chunks, shared = np.maximum(-(-sizes // CHUNK), 1), spark.sparkContext.broadcast(sizes)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                r, lists = index.value.probes(unit(_matrix(batch.column(1), dim)), shared.value)
                taken = batch.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), taken.column(0), taken.column(1)], ["list", "class_id", "v"])

    queries = rows.where("q").select(F.col("vec_id").alias("query_id"), "v")
    query_of = written(queries.join(classes.select("class_id", "v"), "v").select("query_id", "class_id"), "query-classes")
    wanted = classes.join(query_of.select("class_id").distinct(), "class_id", "left_semi")
    probes = written(wanted.select("class_id", "v").mapInArrow(probe, f"list int, class_id bigint, v {kind}"), "probes")
    blocks = np.ones(len(sizes), np.int64)
    for r in probes.groupBy("list").count().collect():
        blocks[r["list"]] = -(-r["count"] // BLOCK)

    # a list is chunks x blocks of groups: its vectors go to every block of its queries, its queries to every chunk of its vectors
    parts = F.broadcast(spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(chunks, blocks))], "list int, chunks int, blocks int"))
    postings, probes = postings.join(parts, "list"), probes.join(parts, "list")
    own = lambda n: F.pmod(F.xxhash64("class_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = probes.select("list", every("chunks").alias("chunk"), own(F.col("blocks")).alias("block"), "class_id", "v")
    right = postings.select("list", own(F.col("chunks")).alias("chunk"), every("blocks").alias("block"), "class_id", "v")

    def scan(key: tuple[pa.Scalar, ...], q: pa.Table, p: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and p.num_rows:
            ids, x = p["class_id"].to_numpy(), _matrix(p["v"], dim)
            norms, keep = np.sqrt((x * x).sum(axis=1)), min(k + 1, len(ids))
            for query, y in zip(q["class_id"].to_pylist(), _matrix(q["v"], dim)):
                rough = x @ y / norms
                low = np.partition(rough, len(ids) - keep)[len(ids) - keep]
                near = np.flatnonzero(rough >= low - 1e-9 * abs(low) - 1e-12)
                # the score proper, summed in the same order for every pair
                exact = (x[near] * y).sum(axis=1) / (norms[near] * np.sqrt((y * y).sum()))
                best = np.lexsort((ids[near], -exact))[:keep]
                out += [(query, int(ids[near[i]]), float(exact[i])) for i in best]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("query", pa.int64()), ("class_id", pa.int64()), ("score", pa.float64())))})

    found = left.groupBy("list", "chunk", "block").cogroup(right.groupBy("list", "chunk", "block")).applyInArrow(scan, "query bigint, class_id bigint, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class_id")
    top = found.groupBy("query", "class_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    near = top.join(classes.select("class_id", "ids"), "class_id").select("query", "score", F.explode("ids").alias("vec_id"))
    # at most (k + 1)^2 rows a query class
    per = near.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("near"))
    each = query_of.join(per.withColumnRenamed("query", "class_id"), "class_id")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))
