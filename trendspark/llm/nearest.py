"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample of rows (SAMPLE) and sent to the tasks; it has at
most MAX_LEAVES leaves whatever the table's size. Every row is indexed: it goes down to a
leaf, and the rows are dealt into cells, each a run of leaves of bounded size in bytes. A
leaf too large for a cell is split over several, by a hash of its rows.

A query goes through the tree with a priority queue. The node with the best outlook is taken
first; an inner node puts its children on the queue, a leaf is visited. How many leaves are
visited is calibrated: for a bounded sample of queries the exact neighbours are found among
all rows, and visits widen until the lower confidence bound of the recall reaches the target.
Queries are sent to the cells that hold their leaves; a cell scores a query against the rows
of its visited leaves by a matrix product, and those that can be among the best k are scored
again in double precision, components in order.

Nearness is the inner product. A node's outlook for a query is the inner product with its
centroid plus what its spread can add, REACH standard deviations of a random direction.

Edge cases: rows with a null id, and null vectors, zero vectors and vectors with a null or
non-finite component take no part. Shorter vectors are compared with zeros in place of the
missing components. A row with the query's id is the query's own. Of query rows with one id,
the smallest vector is the query; candidate rows that share an id are rows of their own.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspark.llm.tables import table
from trendspark.llm.vectors import Best, is_whole, matrix, numbers
from trendspark.scratch import cut

K = 20
SAMPLE = 16_384  # rows to fit the tree on
BRANCH, ROUNDS = 8, 8
LEAF_ROWS, MAX_LEAVES = 256, 1024
CALIBRATION = 256  # queries
TARGET = 0.95  # recall
REACH = 2.0
CELL_BYTES = 32 << 20
BUFFER_BYTES = 16 << 20
QUERY_BLOCK = 512
SLACK = 1e-9


@dataclass
class Tree:
    """Nodes in the order of their making; node 0 is the root. A leaf's children are empty."""

    centroid: np.ndarray
    spread: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray  # number of the leaf, -1 for inner nodes

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node the nearest child."""
        at, moving = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(moving):
            order = moving[np.argsort(at[moving], kind="stable")]
            nodes, first = np.unique(at[order], return_index=True)
            still = []
            for node, own in zip(nodes, np.split(order, first[1:]), strict=True):
                children = self.children[node]
                if len(children):
                    at[own] = children[nearest(rows[own], self.centroid[children])]
                    still.append(own)
            moving = np.concatenate(still) if still else moving[:0]
        return self.leaf[at]

    def visits(self, queries: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` leaves of each query (queries x most), best outlook first."""
        width = self.centroid.shape[1]
        size = np.linalg.norm(queries, axis=1, keepdims=True)
        outlook = -(queries @ self.centroid.T + size * self.spread * (REACH / np.sqrt(max(1, width))))
        out = np.empty((len(queries), most), np.int32)
        children, leaf = [c.tolist() for c in self.children], self.leaf.tolist()
        for q in range(len(queries)):
            worth, queue, n = outlook[q].tolist(), [(0.0, 0)], 0
            while n < most:
                node = heapq.heappop(queue)[1]
                if leaf[node] >= 0:
                    out[q, n] = leaf[node]
                    n += 1
                for child in children[node]:
                    heapq.heappush(queue, (worth[child], child))
        return out


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids ** 2).sum(axis=1) - 2 * (rows @ centroids.T), axis=1)


def k_means(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The group of each row; fewer than ``k`` groups where rows are equal."""
    centroids = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(ROUNDS):
        group = nearest(rows, centroids)
        sums = np.zeros((k, rows.shape[1]))
        np.add.at(sums, group, rows)
        count = np.bincount(group, minlength=k)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return np.unique(nearest(rows, centroids), return_inverse=True)[1]


def fit(sample: np.ndarray, n_leaves: int, seed: int = 11) -> Tree:
    """Splits the node with the most sample rows until there are ``n_leaves`` leaves."""
    rng = np.random.default_rng(seed)
    centroid, spread, children = [], [], []

    def add(rows: np.ndarray) -> int:
        middle = rows.mean(axis=0)
        centroid.append(middle)
        spread.append(float(np.sqrt(((rows - middle) ** 2).sum(axis=1).mean())))
        children.append(np.zeros(0, np.int64))
        return len(centroid) - 1

    if not len(sample):
        sample = np.zeros((1, sample.shape[1]))
    queue = [(-len(sample), add(sample), sample)]
    leaves = 1
    while queue and leaves < n_leaves:
        _, node, rows = heapq.heappop(queue)
        k = min(BRANCH, n_leaves - leaves + 1, len(rows))
        group = k_means(rows, k, rng) if k > 1 else np.zeros(len(rows), np.int64)
        if group.max() == 0:
            continue
        made = []
        for g in range(group.max() + 1):
            part = rows[group == g]
            made.append(add(part))
            heapq.heappush(queue, (-len(part), made[-1], part))
        children[node] = np.array(made)
        leaves += len(made) - 1
    number, count, todo = np.full(len(centroid), -1), 0, [0]
    while todo:  # leaves are numbered so that those of one subtree follow each other
        node = todo.pop()
        if len(children[node]):
            todo += children[node][::-1].tolist()
        else:
            number[node] = count
            count += 1
    return Tree(np.array(centroid), np.array(spread), children, number)


def usable(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rows) of those that take part."""
    rows, whole = matrix(batch.column("embedding"), width)
    whole &= np.asarray(batch.column("vec_id").is_valid())
    whole[whole] = rows[whole].any(axis=1)
    return numbers(batch.column("vec_id"))[whole], rows[whole]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, components added in their order."""
    if not a.shape[1]:
        return np.zeros(len(a))
    return np.concatenate([np.cumsum(a[i:i + 4096] * b[i:i + 4096], axis=1)[:, -1]
                           for i in range(0, len(a), 4096)] or [np.zeros(0)])


class Lists:
    """Running lists of a set of queries with the ids, vectors and best rows of each."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.best = ids, queries, Best(k, np.float64)
        self.size = np.linalg.norm(queries, axis=1)
        self.least = np.full(len(ids), -np.inf)

    def add(self, some: np.ndarray, ids: np.ndarray, rows: np.ndarray, largest: float) -> None:
        """Rows that can be among the best of the queries numbered ``some``."""
        for low in range(0, len(rows), 4096):
            part = rows[low:low + 4096]
            found = self.queries[some] @ part.T
            floor = self.least[some] - SLACK * self.size[some] * largest
            if found.shape[1] > self.best.k:  # rows that k others of this part surely beat
                kth = np.partition(found, found.shape[1] - self.best.k - 1, axis=1)[:, found.shape[1] - self.best.k - 1]
                floor = np.maximum(floor, kth - SLACK * self.size[some] * largest)
            q, r = np.nonzero(found >= floor[:, None])
            own = ids[low + r] == self.ids[some[q]]
            q, r = some[q[~own]], r[~own]
            self.best.add(q, exact(self.queries[q], part[r]), ids[low + r])
            self.least = self.best.least(len(self.ids), -np.inf)


def sized(vectors: DataFrame) -> tuple[int, int]:
    """(rows with a vector, components of the longest)."""
    row = vectors.agg(F.count("embedding").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    return row.n, max(0, row.width or 0)


def sample_rows(vectors: DataFrame, share: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """About that share of the rows by a hash, on the driver."""
    place = F.pmod(F.xxhash64("vec_id", F.lit("tree")), F.lit(1 << 30))
    some = vectors.where(place < int(share * (1 << 30))).toArrow()  # share x rows is a stated bound
    parts = [usable(batch, width) for batch in some.to_batches()]
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, width))
    ids, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((rows[:, 0], ids)) if width else np.argsort(ids)
    return ids[order], rows[order]


def leaf_counts(vectors: DataFrame, tree: Tree, width: int) -> np.ndarray:
    """Rows of each leaf; the driver gets a row per leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(tree.n_leaves, np.int64)
        for batch in batches:
            total += np.bincount(tree.place(usable(batch, width)[1]), minlength=tree.n_leaves)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["leaf", "n"])

    out = np.zeros(tree.n_leaves, np.int64)
    for row in vectors.mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        out[row.leaf] = row.n
    return out


def exact_neighbours(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, tree: Tree, k: int) -> list:
    """(query, leaf) of the exact k best rows of a bounded set of queries, over all rows."""
    width = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(ids, queries, k)
        leaves: dict[int, int] = {}
        for batch in batches:
            own, rows = usable(batch, width)
            lists.add(np.arange(len(ids)), own, rows, float(np.linalg.norm(rows, axis=1).max(initial=0)))
            leaves = {i: leaves[i] for i in lists.best.ident.tolist() if i in leaves} | {
                i: leaf for i, leaf in _placed(own, rows, set(lists.best.ident.tolist()), tree)}
        best = lists.best
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.group), pa.array(best.ident), pa.array(best.score),
             pa.array([leaves[i] for i in best.ident.tolist()], pa.int64())], ["query", "vec_id", "score", "leaf"])

    found = vectors.mapInArrow(run, "query long, vec_id long, score double, leaf long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query", "leaf").collect()  # CALIBRATION x k rows


def _placed(own: np.ndarray, rows: np.ndarray, wanted: set, tree: Tree):
    some = np.flatnonzero(np.isin(own, np.fromiter(wanted, np.int64, len(wanted))))
    return zip(own[some].tolist(), tree.place(rows[some]).tolist(), strict=True)


def calibrated(found: list, order: np.ndarray, target: float) -> int:
    """The fewest leaves to visit for the target recall, by its lower confidence bound."""
    query, leaf = (np.array([r[i] for r in found], np.int64) for i in (0, 1))
    n_leaves = order.shape[1]
    when = np.empty_like(order)
    np.put_along_axis(when, order, np.broadcast_to(np.arange(n_leaves, dtype=order.dtype), order.shape), axis=1)
    reached, total = when[query, leaf], np.bincount(query, minlength=len(order))
    counted = total > 0
    for visits in range(1, n_leaves):
        recall = (np.bincount(query[reached < visits], minlength=len(order)) / np.maximum(total, 1))[counted]
        if len(recall) > 1 and recall.mean() - 2 * recall.std() / np.sqrt(len(recall)) >= target:
            return visits
    return n_leaves


def plan_cells(count: np.ndarray, rows_each: int) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, cells) of each leaf: small neighbouring leaves share one, a large leaf has several."""
    first, parts, cell, held = np.zeros(len(count), np.int64), np.ones(len(count), np.int64), -1, rows_each
    for leaf, n in enumerate(count.tolist()):
        if n > rows_each:
            first[leaf], parts[leaf] = cell + 1, -(-n // rows_each)
            cell, held = cell + int(parts[leaf]), rows_each
            continue
        if cell < 0 or held + n > rows_each:
            cell, held = cell + 1, 0
        first[leaf] = cell
        held += n
    return first, parts


def _block(cell: int, is_query: bool, ids: np.ndarray, rows: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "cell": pa.array([cell], pa.int32()), "is_query": [is_query], "n": pa.array([len(ids)], pa.int32()),
        "ids": [ids.tobytes()], "rows": [rows.tobytes()], "marks": [marks.tobytes()]})


_BLOCK = "cell int, is_query boolean, n int, ids binary, rows binary, marks binary"


def indexed(vectors: DataFrame, tree: Tree, first: np.ndarray, parts: np.ndarray, width: int) -> DataFrame:
    """Blocks of the rows of a cell, with the leaf of each row."""
    kept = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64

    def flush(ids: list, rows: list) -> Iterator[pa.RecordBatch]:
        own, data = np.concatenate(ids), np.concatenate(rows)
        leaf = tree.place(data)
        spread = own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        cell = first[leaf] + (spread % parts[leaf].astype(np.uint64)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.diff(cell[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                yield _block(cell[part[0]], False, own[part], data[part].astype(kept), leaf[part].astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch in batches:
            own, data = usable(batch, width)
            ids.append(own)
            rows.append(data)
            held += data.nbytes
            if held >= BUFFER_BYTES:
                yield from flush(ids, rows)
                ids, rows, held = [], [], 0
        if ids:
            yield from flush(ids, rows)

    return vectors.mapInArrow(run, _BLOCK)


def sent(queries: DataFrame, tree: Tree, first: np.ndarray, parts: np.ndarray, width: int, visits: int) -> DataFrame:
    """Blocks of queries, one for every cell that any of them visits, with the marked leaves of each."""
    leaves = {}
    for leaf in range(tree.n_leaves):
        for cell in range(first[leaf], first[leaf] + parts[leaf]):
            leaves.setdefault(int(cell), []).append(leaf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, QUERY_BLOCK):
                ids, rows = usable(batch.slice(low, QUERY_BLOCK), width)
                marks = np.zeros((len(ids), tree.n_leaves), bool)
                np.put_along_axis(marks, tree.visits(rows, visits).astype(np.int64), True, axis=1)
                for cell, own in leaves.items():
                    some = np.flatnonzero(marks[:, own].any(axis=1))
                    if len(some):
                        yield _block(cell, True, ids[some], rows[some],
                                     np.packbits(marks[np.ix_(some, own)], axis=1))

    return queries.mapInArrow(run, _BLOCK)


def searched(blocks: DataFrame, first: np.ndarray, parts: np.ndarray, width: int, kept: type, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best ``k`` rows of a query in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, cell = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                block = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if block["cell"] != at:
                    at, held, cell = block["cell"], [], None
                ids = np.frombuffer(block["ids"], np.int64)
                if not block["is_query"]:
                    held.append((ids, np.frombuffer(block["rows"], kept).reshape(len(ids), width),
                                 np.frombuffer(block["marks"], np.int32)))
                    continue
                if cell is None:
                    cell = _by_leaf(held, at, first, parts, kept, width)
                lists = Lists(ids, np.frombuffer(block["rows"]).reshape(len(ids), width), k)
                marks = np.frombuffer(block["marks"], np.uint8).reshape(len(ids), -1)
                marks = np.unpackbits(marks, axis=1, count=len(cell)).astype(bool)
                for nth, (own, rows) in enumerate(cell):
                    some = np.flatnonzero(marks[:, nth])
                    if len(some) and len(own):
                        rows = rows.astype(np.float64)
                        lists.add(some, own, rows, float(np.linalg.norm(rows, axis=1).max()))
                best = lists.best
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.group]), pa.array(best.ident),
                                                  pa.array(best.score)], ["query_id", "vec_id", "score"])

    return blocks.mapInArrow(run, "query_id long, vec_id long, score double")


def _by_leaf(held: list, at: int, first: np.ndarray, parts: np.ndarray, kept: type, width: int) -> list:
    """(ids, rows) of each leaf of the cell, in the order of the leaves."""
    own = [leaf for leaf in range(len(first)) if first[leaf] <= at < first[leaf] + parts[leaf]]
    if not held:
        return [(np.zeros(0, np.int64), np.zeros((0, width), kept))] * len(own)
    ids, rows, leaf = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(leaf, kind="stable")
    ids, rows, bounds = ids[order], rows[order], np.searchsorted(leaf[order], [*own, own[-1] + 1])
    return [(ids[a:b], rows[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def nearest_rows(vectors: DataFrame, is_query: Column, k: int = K, target: float = TARGET,
                 sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for the rows where ``is_query`` holds."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    n_rows, width = sized(vectors)
    tree = fit(sample_rows(vectors, min(1.0, sample / max(1, n_rows)), width)[1],
               max(1, min(MAX_LEAVES, n_rows // LEAF_ROWS)))
    some = F.exists("embedding", lambda x: x != 0)
    queries = (vectors.where(is_query & F.col("vec_id").isNotNull() & is_whole("embedding") & some)
               .groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    queries = cut(queries, "queries")
    share = min(1.0, CALIBRATION / max(1, queries.count()))
    ids, known = sample_rows(queries, share, width)
    visits = calibrated(exact_neighbours(vectors, ids, known, tree, k), tree.visits(known, tree.n_leaves), target)
    kept = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    rows_each = max(1, CELL_BYTES // max(1, width * np.dtype(kept).itemsize))
    rows_each = max(LEAF_ROWS, min(rows_each, -(-n_rows // spark.sparkContext.defaultParallelism)))
    first, parts = plan_cells(leaf_counts(vectors, tree, width), rows_each)
    blocks = (indexed(vectors, tree, first, parts, width)
              .union(sent(queries, tree, first, parts, width, visits))
              .repartitionById(int((first + parts).max()), F.col("cell"))
              .sortWithinPartitions("cell", "is_query"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (searched(blocks, first, parts, width, kept, k)
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rows(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
