"""Approximate nearest neighbours (operator 3): a hierarchical k-means tree with best-bin-first search.

Nearness is the largest inner product. The tree is fitted on a documented, bounded sample of about ``SAMPLE`` vectors, made
Euclidean by one more coordinate that brings all to one norm; its size is bounded by the sample, so it is broadcast. Every
row is assigned to a leaf. A query walks the tree with a priority queue ordered by q.c + |q| r / 2 of each node
(centre c, radius r); leaves come out best first. How many leaves are visited is calibrated: a fixed set of queries is
searched exactly against all rows, block by block, and visits widen until those queries reach ``target`` recall. Queries
and candidates meet by leaf; large leaves are cut into blocks, so no task holds a whole leaf.

Of copies of one vector only the k + 1 smallest ids can be among a query's k nearest (ties go to smaller ids); the others
are dropped from a block before the exchange, which keeps a vector held by a third of all rows cheap and changes nothing.

The order of the walk takes half the radius, not the whole one of the bound q.c + |q| r that no vector of a node exceeds: with
the whole one, wide nodes come before near ones. How far to walk is settled by the calibration in either case.

Defined results: vectors that are null, zero, or that hold null or non-finite values take no part, as query or candidate, nor
do rows without an id; vectors of different lengths are searched apart, each among those of its length; a query with fewer
than k candidates gets them all; rows that share an id are one candidate, as near as the nearest of their vectors, and one
query, which ranks a candidate by the nearest of the query's vectors (among vectors of each length), and never finds its own
id; an empty table gives an empty one; the operator reads id and vector alone, so names of other columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import materialize, partitions
from barloom.llm.common import sample as draw_rows

K = 20
SAMPLE = 20_000
LEAF = 64
BRANCH = 8
CALIBRATION = 200
TARGET = 0.97
BLOCK_ROWS = 4096


@dataclass
class Tree:
    """Nodes in arrays: centre, radius in the sample, first child and number of children (none: a leaf with a number)."""

    centres: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    top: float

    @property
    def leaves(self) -> int:
        return int((self.children == 0).sum())


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """One more coordinate, so that inner products rank as Euclidean distances do."""
    rest = np.sqrt(np.maximum(0, top**2 - (x**2).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def _kmeans(x: np.ndarray, k: int, rng) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit_tree(sample: np.ndarray, leaf: int = LEAF, branch: int = BRANCH, seed: int = 5) -> Tree:
    """Split by k-means until a node has at most ``leaf`` sampled vectors, or copies of one vector only."""
    rng = np.random.default_rng(seed)
    top = float(np.sqrt((sample**2).sum(axis=1).max()))
    x = lift(sample, top)
    nodes = [(np.arange(len(x)), x.mean(axis=0))]
    first, children, i = [], [], 0
    while i < len(nodes):
        rows, _ = nodes[i]
        groups: list = []
        if len(rows) > leaf and np.ptp(x[rows], axis=0).max() > 0:
            centres = _kmeans(x[rows], branch, rng)
            near = ((centres**2).sum(axis=1) - 2 * x[rows] @ centres.T).argmin(axis=1)
            groups = [(rows[near == j], centres[j]) for j in range(branch) if (near == j).any()]
        if len(groups) < 2:
            groups = []
        first.append(len(nodes))
        children.append(len(groups))
        nodes += groups
        i += 1
    children = np.asarray(children)
    centres = np.stack([c for _, c in nodes])
    radii = np.asarray([np.sqrt(((x[rows] - c) ** 2).sum(axis=1).max(initial=0)) for rows, c in nodes])
    number = np.where(children == 0, np.cumsum(children == 0) - 1, -1)
    return Tree(centres, radii, np.asarray(first), children, number, top)


def assign(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each vector: the nearest child at every level."""
    x = lift(x, tree.top)
    node = np.zeros(len(x), np.int64)
    moving = np.arange(len(x))
    while len(moving := moving[tree.children[node[moving]] > 0]):
        for at in np.unique(node[moving]).tolist():
            rows = moving[node[moving] == at]
            kids = np.arange(tree.first[at], tree.first[at] + tree.children[at])
            c = tree.centres[kids]
            node[rows] = kids[((c**2).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)]
    return tree.leaf[node]


def best_leaves(tree: Tree, query: np.ndarray, visits: int) -> list[int]:
    """The first ``visits`` leaves of a best-bin-first walk: the queue holds nodes by the most their vectors can score."""
    scores = tree.centres[:, :-1] @ query + 0.5 * np.linalg.norm(query) * tree.radii
    queue, out = [(-scores[0], 0)], []
    while queue and len(out) < visits:
        _, node = heapq.heappop(queue)
        if tree.children[node] == 0:
            out.append(int(tree.leaf[node]))
        for kid in range(tree.first[node], tree.first[node] + tree.children[node]):
            heapq.heappush(queue, (-scores[kid], kid))
    return out


def clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id long, v array<double>) of the vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def fewest_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows left when each distinct vector keeps its ``most`` smallest ids, once each."""
    _, kind = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, kind.ravel()))
    kind = kind.ravel()[order]
    again = (np.diff(kind, prepend=-1) == 0) & (np.diff(ids[order], prepend=0) == 0)
    order, kind = order[~again], kind[~again]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(np.diff(kind, prepend=-1) != 0, np.arange(len(order)), 0))
    return order[rank < most]


def top_rows(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query id, id, score) of each query's k nearest ids in one block, own id excluded, ties to smaller ids; an id of several
    vectors counts by its nearest.

    A matrix product finds who can be among them; scores are then summed vector by vector in double precision, so equal
    vectors score alike wherever they stand.
    """
    out: list[tuple] = []
    rough = q @ x.T
    rough[q_ids[:, None] == ids] = -np.inf
    slack = 1e-9 * np.maximum(1.0, np.abs(rough, where=np.isfinite(rough), out=np.zeros_like(rough)).max(axis=1, initial=0))
    most = k + len(ids) - len(np.unique(ids))
    edge = np.partition(rough, len(ids) - most, axis=1)[:, len(ids) - most] if len(ids) > most else np.full(len(q), -np.inf)
    for i in range(len(q)):
        near = np.flatnonzero((rough[i] >= edge[i] - slack[i]) & (rough[i] > -np.inf))
        score = (x[near] * q[i]).sum(axis=1)
        order = np.lexsort((ids[near], -score))
        if most > k:
            order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])]
        order = order[:k]
        out.append((np.full(len(order), q_ids[i]), ids[near][order], score[order]))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


_FOUND = "query_id long, vec_id long, score double"


def _table(parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.float64())], ["query_id", "vec_id", "score"])


def nearest(found: DataFrame, k: int, repeated: bool = False) -> DataFrame:
    """Each query's k nearest of partial results, ranked; where ids are ``repeated``, each once, by its nearest vectors."""
    if repeated:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int, repeated: bool = True) -> DataFrame:
    """Brute force for a bounded set of queries against all rows, block by block."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                yield _table(top_rows(*shared.value, part.column("id").to_numpy(), _matrix(part.column("v")), k))

    return nearest(rows.select("id", "v").mapInArrow(run, _FOUND), k, repeated)


def search(
    df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, sample: int = SAMPLE, target: float = TARGET
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``df`` found for each row of ``queries``."""
    rows, asked = clean(df, key, vector), clean(queries, key, vector)
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for (size,) in sorted(map(tuple, asked.select(F.size("v")).distinct().collect())):  # nearly always one
        of_size = F.size("v") == size
        out = out.unionByName(_search(rows.where(of_size), asked.where(of_size), k, sample, target))
    return out


def _search(rows: DataFrame, asked: DataFrame, k: int, sample: int, target: float) -> DataFrame:
    """The search among vectors of one length."""
    spark = rows.sparkSession
    draw = draw_rows(rows, F.col("id"), sample).orderBy("id").toPandas()
    if not len(draw):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = fit_tree(np.stack(draw["v"].to_numpy()))
    shared = spark.sparkContext.broadcast(tree)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column("id").to_numpy(), _matrix(batch.column("v"))
            if not len(ids):
                continue
            keep = fewest_copies(ids, x, k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(assign(shared.value, x[keep]).astype(np.int32)), *[c.take(pa.array(keep)) for c in batch.columns]], ["leaf", "id", "v"])

    repeated = not rows.groupBy("id").count().where("count > 1").isEmpty()
    indexed = materialize(rows.mapInArrow(index, "leaf int, id long, v array<double>"))
    # calibration: widen until a fixed set of queries reaches the target against brute force
    some = draw_rows(asked, F.col("id"), CALIBRATION, seed=12).orderBy("id").toPandas()
    if not len(some):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = (some["id"].to_numpy(), np.stack(some["v"].to_numpy()))
    truth = exact(rows, held, k, repeated)
    walks = {int(i): {leaf: n for n, leaf in enumerate(best_leaves(tree, q, tree.leaves))} for i, q in zip(*held, strict=True)}
    # at which visit each true neighbour is met; one row per calibration query and neighbour
    places = truth.join(indexed.select("leaf", F.col("id").alias("vec_id")), "vec_id").select("query_id", "rank", "leaf").toPandas()
    met = np.sort([walks[q][leaf] for q, leaf in zip(places["query_id"], places["leaf"], strict=True)])
    visits = int(met[min(len(met) - 1, int(np.ceil(target * len(met))))]) + 1 if len(met) else tree.leaves
    sizes = indexed.groupBy("leaf").count().toPandas()  # as many rows as leaves at most
    blocks = {int(a): int(-(-n // BLOCK_ROWS)) for a, n in zip(sizes["leaf"], sizes["count"], strict=True)}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pairs = [(i, leaf, b) for i, q in enumerate(_matrix(part.column("v"))) for leaf in best_leaves(shared.value, q, visits) for b in range(blocks.get(leaf, 0))]
                row = pa.array([p[0] for p in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([p[1] for p in pairs], pa.int32()), pa.array([p[2] for p in pairs], pa.int32()), part.column("id").take(row), part.column("v").take(row)], ["leaf", "block", "id", "v"])

    cut = F.element_at(F.split(F.lit(",".join(str(blocks.get(i, 1)) for i in range(tree.leaves))), ","), F.col("leaf") + 1).cast("int")
    stored = indexed.select("leaf", F.pmod(F.xxhash64("id", "v"), cut).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "v")
    asking = asked.mapInArrow(walk, "leaf int, block int, id long, v array<double>").select("leaf", "block", F.lit(True).alias("asks"), "id", "v")
    # a block's rows come first, then its queries, which are scored as they stream by
    meet = stored.unionByName(asking).withColumn("bin", F.xxhash64("leaf", "block")).repartition(partitions(spark), "bin").sortWithinPartitions("bin", "asks")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, x = None, np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in batches:
            bins, asks = batch.column("bin").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            if not len(bins):
                continue
            all_ids, all_x = batch.column("id").to_numpy(), _matrix(batch.column("v"))
            for part in np.split(np.arange(len(bins)), np.flatnonzero(np.diff(bins)) + 1):
                if bins[part[0]] != current:
                    current, ids, x = bins[part[0]], np.zeros(0, np.int64), np.zeros((0, all_x.shape[1]))
                new, ask = part[~asks[part]], part[asks[part]]
                if len(new):
                    ids, x = np.concatenate([ids, all_ids[new]]), np.concatenate([x, all_x[new]])
                if len(ask) and len(ids):
                    for at in range(0, len(ask), 256):
                        group = ask[at : at + 256]
                        yield _table(top_rows(all_ids[group], all_x[group], ids, x, k))

    return nearest(meet.select("bin", "asks", "id", "v").mapInArrow(score, _FOUND), k, repeated)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours that were found."""
    both = truth.join(found, ["query_id", "vec_id"], "left_semi").count()
    return both / max(1, truth.count())


def embedding_neighbours(embeddings: DataFrame) -> DataFrame:
    """The query: the 20 nearest of every vector whose id is divisible by 20."""
    rows = embeddings.select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
