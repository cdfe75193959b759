"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree's upper part is fitted on a bounded sample. Leaves that hold too many of the
table's vectors are split further, each by its own sample, in the tasks that hold it: the
tree grows with the table, so a leaf's rows and the work of a query don't, up to
``max_leaves``. Every vector is filed under a leaf. A query walks the tree through a
priority queue of centroid distances and visits leaves, nearest first. How many is
calibrated on some of the table's vectors, whose true neighbours among all rows are found
by brute force: visits widen until their recall reaches the target, and the recall of
others of them, which had no part in that, is reported. Neighbouring leaves form cells
of bounded size; a query is compared with all vectors of the cells whose leaves it
visits. Cells are split further where one leaf alone holds more, so it may hold any
share of all vectors.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.llm.common import durable, small_batches


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, nearest centroid of each row); fewer than ``k`` where rows coincide."""
    distinct = np.unique(x[rng.permutation(len(x))[:64 * k]], axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = nearest(x, c)
        used = np.unique(near)
        new = np.stack([x[near == j].mean(0) for j in used])
        if new.shape == c.shape and np.allclose(new, c):
            break
        c = new
    return c, nearest(x, c)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


@dataclass
class Tree:
    """Nodes by number, the root first: centroids, children (empty for a leaf), and how many leaves a query visits."""

    centroids: np.ndarray
    children: list[list[int]]
    visits: int = 1
    recall: float = 1.0

    @classmethod
    def fit(cls, x: np.ndarray, branch: int = 8, leaf: int = 64, seed: int = 11) -> Tree:
        rng = np.random.default_rng(seed)
        centroids, children, open_ = [x.mean(0)], [[]], [(0, x)]
        while open_:
            node, rows = open_.pop()
            if len(rows) <= leaf:
                continue
            c, near = kmeans(rows, branch, rng)
            if len(c) < 2:
                continue
            for j in range(len(c)):
                if (near == j).any():
                    children[node].append(len(children))
                    centroids.append(c[j])
                    children.append([])
                    open_.append((len(children) - 1, rows[near == j]))
        return cls(np.stack(centroids), children)

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row, by the nearest child at each node."""
        out, open_ = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = node
                continue
            near = nearest(x[rows], self.centroids[kids])
            open_ += [(kid, rows[near == j]) for j, kid in enumerate(kids) if (near == j).any()]
        return out

    def walk(self, q: np.ndarray):
        """Leaves in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield node
                continue
            d = ((self.centroids[kids] - q) ** 2).sum(1)
            for kid, far in zip(kids, d.tolist(), strict=True):
                heapq.heappush(queue, (far, kid))

    def graft(self, leaf: int, part: Tree) -> None:
        """Puts the children of ``part``'s root, and all below them, under ``leaf``."""
        if not part.children[0]:
            return
        shift = len(self.children) - 1  # the root of ``part`` is the leaf itself
        self.children[leaf] = [c + shift for c in part.children[0]]
        self.children += [[c + shift for c in kids] for kids in part.children[1:]]
        self.centroids = np.concatenate([self.centroids, part.centroids[1:]])

    def leaves(self) -> list[int]:
        """In the order of the tree, so that neighbours in it lie side by side."""
        out, open_ = [], [0]
        while open_:
            node = open_.pop()
            if self.children[node]:
                open_ += self.children[node][::-1]
            else:
                out.append(node)
        return out

    def cells(self, sizes: dict[int, int], rows: int) -> dict[int, int]:
        """A cell's number for every leaf that holds rows: neighbouring leaves share a cell of ``rows`` rows at most, a larger leaf has its own."""
        out, cell, held = {}, 0, 0
        for leaf in self.leaves():
            if leaf in sizes:
                if held and held + sizes[leaf] > rows:
                    cell, held = cell + 1, 0
                out[leaf] = cell
                held += sizes[leaf]
        return out

    def calibrate(self, queries: list[tuple[np.ndarray, list[int]]], target: float) -> None:
        """Sets ``visits`` to the fewest that reach ``target`` on every other query (vector, its true neighbours' leaves), ``recall`` to what the rest then reach."""
        total = len(self.leaves())
        found, wanted = np.zeros((2, total)), np.zeros(2)
        for i, (q, near) in enumerate(queries):
            turn = {node: n for n, node in enumerate(self.walk(q))}
            for node in near:
                found[i % 2, turn[node]] += 1
            wanted[i % 2] += len(near)
        reached = np.cumsum(found, axis=1) / np.maximum(wanted, 1)[:, None]
        enough = np.flatnonzero(reached[0] >= target)
        self.visits = int(enough[0]) + 1 if len(enough) else total
        self.recall = float(reached[1 if wanted[1] else 0, self.visits - 1]) if wanted.any() else 1.0


def _matrix(column, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors): not null, of ``dims`` finite components, not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    ok = ~lists.is_null().to_numpy(zero_copy_only=False) & (sizes == dims)
    at = np.flatnonzero(ok)
    values = lists.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    x = values[lists.offsets.to_numpy()[:-1][at][:, None] + np.arange(dims)] if len(at) else np.zeros((0, dims))
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[good], x[good]


def _nearest_in(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int, block: int = 128) -> tuple[list, list, list]:
    """(query, id, distance) of each query's ``k`` nearest other ids, ties to the smaller id, an id once.

    Products give every distance roughly; what may be among the nearest is computed from differences.
    """
    out: tuple[list, list, list] = ([], [], [])
    if not len(ids) or not len(asked):
        return out
    size = (x * x).sum(1)
    for at in range(0, len(q), block):
        part, own = q[at:at + block], (q[at:at + block] ** 2).sum(1)
        rough = size[None] - 2 * part @ x.T + own[:, None]
        slack = 1e-9 * (size.max() + own)
        for i, query in enumerate(asked[at:at + block].tolist()):
            g = rough[i]
            g[ids == query] = np.inf
            reach, best = k, np.zeros(0, np.int64)
            while True:  # repeated rows of an id count once: look further while fewer than k ids are found
                limit = np.partition(g, reach - 1)[reach - 1] + slack[i] if reach < len(g) else np.inf
                some = np.flatnonzero((g <= limit) & np.isfinite(g))
                d = np.sqrt(((x[some] - part[i]) ** 2).sum(1))
                order = np.lexsort((ids[some], d))
                _, first = np.unique(ids[some][order], return_index=True)
                best = order[np.sort(first)[:k]]
                if len(best) == k or reach >= len(g):
                    break
                reach *= 4
            out[0].extend([query] * len(best))
            out[1].extend(ids[some][best].tolist())
            out[2].extend(d[best].tolist())
    return out


def _found_table(found: tuple[list, list, list]) -> dict[str, pa.Array]:
    return {"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())}


def _cell_search(k: int, dims: int):
    def run(_key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if vectors.num_rows and queries.num_rows:
            at, x = _matrix(vectors["embedding"], dims)
            qat, q = _matrix(queries["embedding"], dims)
            found = _nearest_in(vectors["vec_id"].to_numpy()[at], x, queries["query_id"].to_numpy()[qat], q, k)
        return pa.table(_found_table(found))

    return run


def fit_top(vectors: DataFrame, total: int, sample_rows: int, leaf: int) -> tuple[Tree, int] | None:
    """The upper tree and the vectors' length, from ``sample_rows`` random rows at most; None if no row takes part."""
    share = min(1.0, 1.1 * sample_rows / max(total, 1))
    rows = (vectors if share == 1 else vectors.sample(False, share, seed=3)).select("embedding").limit(sample_rows).toArrow()
    lists = rows["embedding"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return None
    dims = int(np.bincount(sizes).argmax())
    _, x = _matrix(lists, dims)
    return (Tree.fit(x, leaf=leaf), dims) if len(x) else None


def filed_under(rows: DataFrame, tree: Tree, dims: int) -> DataFrame:
    """The rows that take part, with their ``leaf``."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)  # bounded by max_leaves
    kind = rows.schema["embedding"].dataType.simpleString()

    def file(batches):
        for batch in batches:
            at, x = _matrix(batch.column(1), dims)
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.file(x))], ["vec_id", "embedding", "ask", "leaf"])

    return rows.mapInArrow(file, f"vec_id long, embedding {kind}, ask boolean, leaf long")


def grow(tree: Tree, filed: DataFrame, dims: int, leaf_rows: int, per_part: int = 32, rounds: int = 3) -> Tree:
    """Splits leaves of more than ``leaf_rows`` rows, each by a k-means tree over a sample of its own rows.

    A leaf's sample holds about ``per_part`` rows for each part it is to fall into, at
    most 256 parts a round; the trees are fitted in the tasks, only their centroids
    reach the driver.
    """
    spark = filed.sparkSession
    for _ in range(rounds):
        sizes = {r.leaf: r.n for r in filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each leaf
        big = [(leaf, min(1.0, per_part * min(256, -(-n // leaf_rows)) / n)) for leaf, n in sizes.items() if n > leaf_rows]
        if not big:
            break
        shares = spark.createDataFrame(big, "leaf long, share double")
        part = filed.join(F.broadcast(shares), "leaf").where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 20)) < F.col("share") * (1 << 20))

        def fit(key, rows):
            _, x = _matrix(rows["embedding"], dims)
            found = Tree.fit(x, leaf=per_part) if len(x) else None
            return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(found)], pa.binary())})

        before = len(tree.children)
        for r in part.select("leaf", "embedding").groupBy("leaf").applyInArrow(fit, "leaf long, tree binary").toLocalIterator():
            if (found := pickle.loads(r.tree)) is not None:
                tree.graft(r.leaf, found)
        if len(tree.children) == before:  # equal vectors don't fall apart
            break
        filed = filed_under(filed.select("vec_id", "embedding", "ask"), tree, dims)
    return tree


def true_neighbours(filed: DataFrame, dims: int, k: int, queries: int) -> list[tuple[np.ndarray, list[int]]]:
    """(vector, leaves of its ``k`` nearest) of ``queries`` rows chosen by a hash, by brute force over all rows in one pass."""
    chosen = filed.orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(queries).select("vec_id", "embedding").toArrow()
    at, q = _matrix(chosen["embedding"], dims)
    asked = chosen["vec_id"].to_numpy()[at]
    shared = filed.sparkSession.sparkContext.broadcast((asked, q))

    def run(batches):
        asked, q = shared.value
        for batch in batches:
            at, x = _matrix(batch.column(1), dims)
            found = _found_table(_nearest_in(batch.column(0).to_numpy()[at], x, asked, q, k))
            leaf = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            yield pa.record_batch(found | {"leaf": pa.array([leaf[v] for v in found["vec_id"].to_pylist()], pa.int64())})

    each = filed.select("vec_id", "embedding", "leaf").mapInArrow(run, "query_id long, vec_id long, score double, leaf long")
    ranked = each.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("r") <= k)
    near: dict[int, list[int]] = {}
    for r in ranked.select("query_id", "leaf").collect():  # queries x k rows
        near.setdefault(r.query_id, []).append(r.leaf)
    return [(v, near.get(i, [])) for i, v in zip(asked.tolist(), q, strict=True)]


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, sample_rows: int = 20_000, leaf: int = 32, target: float = 0.97,
    leaf_rows: int = 1024, max_leaves: int = 1 << 18, calibration: int = 200, cell_vectors: int = 8192, cell_queries: int = 4096,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of every row of ``vectors`` (vec_id, embedding) where ``is_query``.

    Also visited_share, the part of the leaves the query visited, and expected_recall, as
    measured on calibration queries. Distances are Euclidean, in double precision, over
    the original components; ties go to the smaller vec_id. All rows but those with the
    query's own vec_id are candidates; fewer than ``k`` of them come back whole, since a
    query visits leaves until they hold more than ``k`` rows. Vectors that are null,
    zero, of another length than most, or hold null or non-finite components take no
    part, nor do rows without a vec_id. Repeated rows count once. An empty table gives no
    rows; extra columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("ask")).where("vec_id is not null")
    total = rows.count()
    fitted = fit_top(rows, total, sample_rows, leaf)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visited_share double, expected_recall double")
    tree, dims = fitted
    if total > sample_rows or total > leaf_rows:
        tree = grow(tree, filed_under(rows, tree, dims), dims, max(leaf_rows, 2 * total // max_leaves))
    filed = durable(filed_under(rows, tree, dims), "filed")
    sizes = {r.leaf: r.n for r in filed.groupBy("leaf").agg(F.countDistinct("vec_id").alias("n")).collect()}  # one for each leaf
    tree.calibrate(true_neighbours(filed, dims, k, calibration), target)
    cell_of = tree.cells(sizes, cell_vectors)
    shared, leaves = spark.sparkContext.broadcast((tree, cell_of)), len(tree.leaves())
    kind = rows.schema["embedding"].dataType.simpleString()

    def visit(batches):
        tree, cell_of = shared.value
        for batch in batches:
            at, x = _matrix(batch.column(1), dims)
            row, seen, share = [], [], []
            for i, q in zip(at.tolist(), x, strict=True):
                held = n = 0
                cells = set()
                for n, node in enumerate(tree.walk(q), 1):
                    if node in sizes:
                        cells.add(cell_of[node])
                        held += sizes[node]
                    if n >= tree.visits and held > k:
                        break
                row += [i] * len(cells)
                seen += sorted(cells)
                share += [n / leaves] * len(cells)
            part = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(seen, pa.int64()), pa.array(share, pa.float64())], ["query_id", "embedding", "cell", "share"])

    asked = filed.where("ask").select(F.col("vec_id").alias("query_id"), "embedding")
    visits = durable(asked.mapInArrow(visit, f"query_id long, embedding {kind}, cell long, share double"), "visits")
    asks = {r.cell: r.n for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each cell
    held: dict[int, int] = {}
    for node, c in cell_of.items():
        held[c] = held.get(c, 0) + sizes[node]
    parts = spark.createDataFrame([(c, -(-held[c] // cell_vectors), -(-n // cell_queries)) for c, n in asks.items()] or [(-1, 1, 1)], "cell long, vs int, qs int")
    parts = F.broadcast(parts)  # one row for each cell
    leaf_cells = F.broadcast(spark.createDataFrame(list(cell_of.items()), "leaf long, cell long"))  # one row for each leaf
    left = filed.join(leaf_cells, "leaf").join(parts, "cell").select(
        "vec_id", "embedding", "cell", F.pmod(F.xxhash64("vec_id"), "vs").cast("int").alias("v"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"))
    right = visits.join(parts, "cell").select(
        "query_id", "embedding", "cell", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("v"), F.pmod(F.xxhash64("query_id"), "qs").cast("int").alias("q"))
    found = left.groupBy("cell", "v", "q").cogroup(right.groupBy("cell", "v", "q")).applyInArrow(_cell_search(k, dims), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    share = visits.groupBy("query_id").agg(F.max("share").alias("visited_share"))
    return ranked.join(share, "query_id").select("query_id", "rank", "vec_id", "score", "visited_share", F.lit(tree.recall).alias("expected_recall"))
