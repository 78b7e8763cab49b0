"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample: a node is split by the hyperplane halfway between two of its vectors, until at most
``LEAF_ROWS`` of the sample are left. Every vector of the table is then sent down every tree. A query keeps one priority
queue over all trees, ordered by how far it lies on the wrong side of the hyperplanes passed, and takes leaves from it
until they hold a set share of the vectors. The vectors of those leaves are ranked by exact Euclidean distance.

Equal vectors are one vector with several ids: the sample, the leaves and the share count it once, so a vector that many rows
repeat does not use up a query's share. A vector keeps its smallest ids, one more than neighbours are asked for: no answer
can hold others, as a query leaves out no other id than its own.

Vectors are dealt into chunks of bounded size, whatever their leaves, so a leaf may hold any share of the table and a vector
is shuffled once, not once a tree. Each chunk keeps its own lists of leaf members; a query visits every chunk with the leaves
it has chosen, and the best of all chunks are its neighbours.

Defined cases: vectors that are null, all zero, or hold null or non-finite components take no part, as query or candidate;
so do rows with a null id. Vectors of another length than most of the sample take no part. Rows that repeat an id and a
vector count once. Ties go to the smaller id. Other columns are not used, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from pagewise.llm.common import shipped, stored

shipped(__name__)

TREES = 16
LEAF_ROWS = 64
#: Bound of the sample the trees are grown on; all other steps see every row.
SAMPLE_ROWS = 20_000
#: A query's leaves hold this share of the different vectors, copies over trees counted, and at least so many. Vectors without
#: cluster structure need a large share for a recall of 0.9; clustered ones do with a small one.
SEARCH_SHARE = 0.75
SEARCH_ROWS = 4_000
NEAREST = 10
QUERY_STEP = 100
#: Most vectors a task holds at once.
CHUNK_ROWS = 1 << 17
SEED = 5


class Tree:
    """Flat arrays: normal and offset of inner nodes, children; a negative child c is leaf -c - 1."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int, seed: int):
        draw = np.random.default_rng([SEED, seed])
        normals: list[np.ndarray] = []
        offsets: list[float] = []
        children: list[list[int]] = []
        self.leaves = 0

        def leaf() -> int:
            self.leaves += 1
            return -self.leaves

        waiting: list[tuple[np.ndarray, int, int]] = []

        def node(rows: np.ndarray) -> int:
            if len(rows) <= leaf_rows:
                return leaf()
            for _ in range(5):
                a, b = vectors[draw.choice(rows, 2, replace=False)]
                normal = a - b
                length = np.linalg.norm(normal)
                if length > 0:
                    normal = normal / length
                    offset = float(normal @ (a + b) / 2)
                    side = vectors[rows] @ normal > offset
                    if 0 < side.sum() < len(rows):
                        at = len(normals)
                        normals.append(normal)
                        offsets.append(offset)
                        children.append([0, 0])
                        waiting.append((rows[~side], at, 0))
                        waiting.append((rows[side], at, 1))
                        return at
            return leaf()  # equal vectors

        self.root = node(np.arange(len(vectors)))
        while waiting:
            rows, at, side = waiting.pop()
            children[at][side] = node(rows)
        width = vectors.shape[1]
        self.normals = np.array(normals).reshape(-1, width)
        self.offsets, self.children = np.array(offsets), np.array(children, dtype=np.int64).reshape(-1, 2)

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        at = np.full(len(vectors), self.root, dtype=np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            here = at[inner]
            side = np.einsum("ij,ij->i", vectors[inner], self.normals[here]) > self.offsets[here]
            at[inner] = self.children[here, side.astype(int)]
        return -at - 1


def grown(vectors: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> list[Tree]:
    return [Tree(vectors, leaf_rows, t) for t in range(trees)]


def searched(forest: list[Tree], sizes: dict[int, int], starts: list[int], query: np.ndarray, rows: int) -> list[int]:
    """Numbers of the leaves nearest to the query that together hold at least ``rows`` vectors; tree t's begin at ``starts[t]``."""
    queue = [(0.0, t, tree.root) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    margins = [tree.normals @ query - tree.offsets for tree in forest]
    found, held = [], 0
    while queue and held < rows:
        far, t, at = heapq.heappop(queue)
        while at >= 0:
            margin = margins[t][at]
            side = int(margin > 0)
            heapq.heappush(queue, (max(far, abs(margin)), t, int(forest[t].children[at, 1 - side])))
            at = int(forest[t].children[at, side])
        leaf = starts[t] - at - 1
        if size := sizes.get(leaf, 0):
            found.append(leaf)
            held += size
    return found


def _place(forest: list[Tree], starts: list[int], kept: int):
    """The different vectors of each batch, their mark, their leaves and their ``kept`` smallest ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            vectors = np.stack(frame["vector"].to_list()) + 0.0  # no negative zeros
            number = pd.factorize(pd.Series([v.tobytes() for v in vectors]))[0]
            of, ids = _smallest(number, frame["vec_id"].to_numpy(), kept)
            ends = np.flatnonzero(np.diff(of)) + 1
            first = np.unique(number, return_index=True)[1]
            marks = [xxhash.xxh64_intdigest(v.tobytes()) - 2**63 for v in vectors[first]]
            own = vectors[first].astype(np.float64)
            leaves = np.stack([tree.leaf_of(own) + start for tree, start in zip(forest, starts, strict=True)], axis=1)
            yield pd.DataFrame(
                {"mark": marks, "ids": np.split(ids, ends), "vector": list(vectors[first]), "leaves": list(leaves.astype(np.int32))}
            )

    return run


def _smallest(of: np.ndarray, ids: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``of`` and ``ids``, sorted and each once, cut to the ``kept`` smallest ids of each ``of``."""
    order = np.lexsort((ids, of))
    of, ids = of[order], ids[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])
    of, ids = of[new], ids[new]
    within = np.arange(len(of)) - np.searchsorted(of, of, "left") < kept
    return of[within], ids[within]


def _probe(forest: list[Tree], starts: list[int], sizes: dict[int, int], rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            chosen = [np.array(searched(forest, sizes, starts, v.astype(np.float64), rows), dtype=np.int32) for v in frame["vector"]]
            yield pd.DataFrame({"mark": frame["vec_id"], "ids": [None] * len(frame), "vector": frame["vector"], "leaves": chosen})

    return run


class Chunk:
    """Some different vectors of the table with their ids and, by leaf, which of them it holds."""

    def __init__(self, kept: int):
        self.frames: list[pd.DataFrame] = []
        self.kept = kept
        self.ids: np.ndarray | None = None

    def add(self, frame: pd.DataFrame) -> None:
        self.frames.append(frame[["ids", "vector", "leaves"]])

    def close(self) -> None:
        """After the last vector: equal ones, which arrive together, become one; leaf members are listed."""
        if self.ids is None and self.frames:
            rows = pd.concat(self.frames, ignore_index=True)
            vectors = np.stack(rows["vector"].to_list())
            new = np.ones(len(vectors), dtype=bool)
            new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
            number = np.cumsum(new) - 1
            self.of, self.ids = _smallest(np.repeat(number, rows["ids"].map(len)), np.concatenate(rows["ids"].to_list()), self.kept)
            self.vectors = vectors[new]
            leaves = np.stack(rows["leaves"].to_list())[new]
            order = np.argsort(leaves, axis=None, kind="stable")
            self.leaves, self.rows = leaves.ravel()[order], order // leaves.shape[1]
            self.frames = []

    def nearest(self, query: int, vector: np.ndarray, leaves: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact distances of the nearest members of ``leaves``."""
        low, high = np.searchsorted(self.leaves, leaves, "left"), np.searchsorted(self.leaves, leaves, "right")
        n = high - low
        within = np.arange(n.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(n) else np.empty(0, dtype=np.int64)
        seen = np.zeros(len(self.vectors), dtype=bool)
        seen[self.rows[within]] = True
        at = np.flatnonzero(seen)
        far = np.full(len(seen), np.nan)
        far[at] = np.sqrt(((self.vectors[at].astype(np.float64) - vector.astype(np.float64)) ** 2).sum(axis=1))
        own = np.flatnonzero(seen[self.of] & (self.ids != query))
        score = far[self.of[own]]
        order = np.lexsort((self.ids[own], score))
        ids = self.ids[own][order]
        # An id that stands on several different vectors counts with its nearest.
        first = np.sort(np.unique(ids, return_index=True)[1])[:count]
        return ids[first], score[order][first]


def _rank(nearest: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, chunk = None, Chunk(nearest + 1)
        for frame in frames:
            for (here, asks), rows in frame.groupby(["chunk", "asks"]):
                if here != number:
                    number, chunk = here, Chunk(nearest + 1)
                if not asks:
                    chunk.add(rows)
                    continue
                chunk.close()
                if chunk.ids is None:
                    continue
                found = [(q, *chunk.nearest(q, v, leaves, nearest)) for q, v, leaves in rows[["mark", "vector", "leaves"]].itertuples(index=False, name=None)]
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat([q for q, _, _ in found], [len(ids) for _, ids, _ in found]),
                        "vec_id": np.concatenate([ids for _, ids, _ in found]),
                        "score": np.concatenate([score for _, _, score in found]),
                    }
                )

    return run


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part; floats stay floats until distances are taken."""
    kept = "array<float>" if vectors.schema[vector].dataType == ArrayType(FloatType()) else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kept).alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists("vector", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))


def neighbours(
    vectors: DataFrame,
    nearest: int = NEAREST,
    step: int = QUERY_STEP,
    trees: int = TREES,
    search_share: float = SEARCH_SHARE,
    search_rows: int = SEARCH_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query, a row whose id is divisible by ``step``."""
    spark = vectors.sparkSession
    rows = valid(vectors)
    seen = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("vector")).alias("different"))
    widths = seen.collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, _, different = max(widths, key=lambda r: (r["n"], -r["width"]))
    rows = rows.filter(F.size("vector") == width)
    # A sample of the different vectors: about twice as many by their hash, so that copies meet before the shuffle.
    drawn = F.pmod(F.xxhash64("vector", F.lit("drawn")), F.lit(1 << 30)) <= min(1.0, 2 * sample_rows / max(different, 1)) * (1 << 30)
    drawn = rows.filter(drawn).select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(sample_rows)
    forest = grown(np.stack(drawn.toArrow()["vector"].to_numpy()).astype(np.float64), trees)
    starts = [0, *accumulate(tree.leaves for tree in forest)][:-1]
    shape = f"mark long, ids array<long>, vector {rows.schema['vector'].dataType.simpleString()}, leaves array<int>"
    index = stored(rows.mapInPandas(_place(forest, starts, nearest + 1), shape))
    # As many leaves as the trees have, whose number the sample bounds.
    once = index.groupBy("mark").agg(F.first("leaves").alias("leaves"))
    sizes = {r["leaf"]: r["count"] for r in once.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}
    total = sum(sizes.values()) // trees
    search_rows = max(search_rows, math.ceil(search_share * total))
    chunks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(total / CHUNK_ROWS))
    queries = rows.filter(F.col("vec_id") % step == 0).select("vec_id", "vector").distinct()
    probes = stored(queries.mapInPandas(_probe(forest, starts, sizes, search_rows), shape))
    # Of a vector, "mark" is its hash; of a query, it is the query's id.
    names = ["chunk", "asks", "mark", "ids", "vector", "leaves"]
    members = index.withColumn("chunk", F.pmod(F.xxhash64("mark"), F.lit(chunks)).cast("int")).withColumn("asks", F.lit(False))
    asked = probes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("asks", F.lit(True))
    met = members.select(names).union(asked.select(names)).repartition(chunks, "chunk")
    met = met.sortWithinPartitions("chunk", "asks", "mark", F.xxhash64("vector"))
    found = met.mapInPandas(_rank(nearest), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
    SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
