"""Nearest vectors by inner product: stable projections, kd-trees, a chi-square stopping test.

* A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest length, a query
  gets 0 there; then the largest inner product is the smallest Euclidean distance.
* PROJECTED Gaussian (2-stable) projections of it are its place in a kd-tree. Squared
  distance there over true squared distance follows chi-square with PROJECTED degrees.
* A query looks through projected neighbours from near to far and verifies them on the
  original vectors. It stops once the next projected distance is so large that a vector
  nearer than its k-th best would lie within it with probability CONFIDENCE.

The upper levels of the tree, fitted on a bounded sample, deal all vectors out to cells;
large cells are cut into blocks by a hash. A query first searches the cell that it lies in,
then those cells that the test with its k-th best score doesn't rule out. Every vector is
in the index; a block and the queries that meet it there are of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.llm.storage import keep

PROJECTED, CONFIDENCE, SEED = 8, 0.95, 20240501
#: Values (rows times dimensions) of the sample that the upper tree is fitted on.
SAMPLE_VALUES = 1 << 20
CELL_ROWS, MOST_CELLS, LEAF_ROWS, QUERIES_AT_ONCE = 8192, 1024, 256, 4096


def chi_square_quantile(p: float, degrees: int) -> float:
    """For an even number of degrees, by bisection of the closed form."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - tail(mid) < p else (low, mid)
    return high


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part: an id, no null, NaN or infinite component, not all zero."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("vector"))
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast("float")))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False)))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


class Tree:
    """Upper levels of the kd-tree: for each inner node a dimension and a value."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels = levels
        self.dim, self.cut = np.zeros(2**levels, np.int64), np.zeros(2**levels)
        self._split(points, 1)

    def _split(self, points: np.ndarray, node: int) -> None:
        if node >= 2**self.levels or not len(points):
            return
        dim = int(np.ptp(points, axis=0).argmax())
        self.dim[node], self.cut[node] = dim, np.median(points[:, dim])
        below = points[:, dim] < self.cut[node]
        self._split(points[below], 2 * node)
        self._split(points[~below], 2 * node + 1)

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] >= self.cut[node])
        return node - 2**self.levels


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    todo, done = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= LEAF_ROWS:
            done.append(own)
            continue
        dim = np.ptp(points[own], axis=0).argmax()
        by = own[np.argsort(points[own, dim], kind="stable")]
        todo += [by[: len(by) // 2], by[len(by) // 2 :]]
    return done


def _gap(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance from every point to every box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d : d + 1]
        out += np.maximum(np.maximum(low[:, d] - p, p - high[:, d]), 0) ** 2
    return out


def _slack(limit: float, length: np.ndarray, longest: float) -> np.ndarray:
    """Rounding of a reach and of a gap: vectors as near as the k-th best, equal ones at distance 0, are to be seen."""
    return 1e-9 * limit * (length + longest) ** 2


def search_block(ids, vectors, places, query_ids, queries, query_places, bound, k: int, limit: float, longest: float):
    """(query number, id, score) of each query's best ``k`` in a block that are verified before the test holds.

    ``bound``: a score that the query has k times elsewhere (-inf if not).
    """
    leaves = _leaves(places)
    low, high = np.stack([places[x].min(axis=0) for x in leaves]), np.stack([places[x].max(axis=0) for x in leaves])
    gap = _gap(query_places, low, high)
    order = np.argsort(gap, axis=1, kind="stable")
    length = np.sqrt((queries**2).sum(axis=1))
    slack = 1e-10 * length * longest  # of a score by matrix product against the exact one
    kth = bound.copy()
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    at, wide = 0, 1
    while at < len(leaves):
        near = order[:, at : at + wide]
        reach = limit * (length**2 + longest**2 - 2 * kth)
        go = np.take_along_axis(gap, near, axis=1) <= (reach + _slack(limit, length, longest))[:, None]
        if not go[:, 0].any():  # leaves come from near to far
            break
        own, leaf = np.nonzero(go)[0], near[go]
        found = [best]
        for number in np.unique(leaf):
            who, rows = own[leaf == number], leaves[number]
            score = vectors[rows] @ queries[who].T
            score[ids[rows][:, None] == query_ids[who]] = -np.inf
            least = kth[who]
            if len(rows) > k:
                least = np.maximum(least, np.partition(score, len(rows) - k, axis=0)[len(rows) - k])
            r, q = np.nonzero((score >= least - slack[who]) & (score > -np.inf))
            found.append((who[q], ids[rows[r]], (vectors[rows[r]] * queries[who[q]]).sum(axis=1)))
        q, i, s = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((i, -s, q))
        q, i, s = q[by], i[by], s[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        full = q[rank == k - 1]
        kth[full] = np.maximum(kth[full], s[rank == k - 1])
        best = (q[rank < k], i[rank < k], s[rank < k])
        at, wide = at + wide, min(2 * wide, 64)
    return best


class Index:
    """All usable vectors with their places and cells, stored; and what is known of each cell.

    Components are read as 32-bit floats. Vectors whose length isn't the commonest one (of
    equally common ones the smallest) take no part, neither as candidates nor as queries.
    """

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding"):
        rows = usable(vectors, key, vector)
        sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        self.spark, self.empty = vectors.sparkSession, sizes is None
        if self.empty:
            self.rows = keep(rows.withColumns({"place": F.array().cast("array<double>"), "cell": F.lit(0)}), "ann-index")
            return
        dims, n = sizes.d, sizes.n
        rows = rows.where(F.size("vector") == dims)
        squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        self.longest = math.sqrt(rows.agg(F.max(squares)).first()[0])
        draw = np.random.default_rng(SEED).standard_normal((dims + 1, PROJECTED))
        self.draw = draw
        longest = self.longest

        def place(x: np.ndarray) -> np.ndarray:
            rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
            return x @ draw[:dims] + rest[:, None] * draw[dims]

        most = max(64, SAMPLE_VALUES // dims)
        share = min(1.0, most / n)
        sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").toPandas()["vector"]
        points = place(_matrix(sample).astype(float)) if len(sample) else np.zeros((0, PROJECTED))
        cells = min(MOST_CELLS, max(1, len(points) // 8), max(1, n // CELL_ROWS))
        tree = Tree(points, int(math.log2(cells)))

        def assign(batches):
            for batch in batches:
                x = batch.column(1).values.to_numpy(zero_copy_only=False)[batch.column(1).offsets[0].as_py() : batch.column(1).offsets[-1].as_py()].reshape(-1, dims).astype(float)
                places = place(x)
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, places.size + 1, PROJECTED), pa.int32()), pa.array(places.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column, pa.array(tree.cell(places), pa.int32())], names=["vec_id", "vector", "place", "cell"])

        self.rows = keep(rows.mapInArrow(assign, "vec_id long, vector array<float>, place array<double>, cell int"), "ann-index")
        bounds = [f(F.col("place")[d]) for d in range(PROJECTED) for f in (F.min, F.max)]
        found = sorted(map(tuple, self.rows.groupBy("cell").agg(F.count("*"), *bounds).collect()))  # at most MOST_CELLS rows
        self.cells = np.array([r[0] for r in found])
        self.blocks = {r[0]: -(-r[1] // (2 * CELL_ROWS)) for r in found}
        box = np.array([r[2:] for r in found], float).reshape(len(found), PROJECTED, 2)
        self.low, self.high = box[:, :, 0], box[:, :, 1]
        self.limit = chi_square_quantile(CONFIDENCE, PROJECTED)

    def _round(self, queries: DataFrame, k: int) -> DataFrame:
        """Best k of each query in the cells it names; queries: query_id, query_key, query, place, bound, cell."""
        blocks, limit, longest = self.blocks, self.limit, self.longest
        crowd = {r.cell: -(-r.n // QUERIES_AT_ONCE) for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        plan = self.spark.createDataFrame([(int(c), int(blocks[c]), int(crowd[c])) for c in sorted(crowd)], "cell int, subs int, parts int")
        plan = F.broadcast(plan)  # a row per cell
        left = self.rows.join(plan, "cell").withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int"))
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "sub", "part", "vec_id", "vector", "place")
        right = queries.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("query_key"), F.col("parts")).cast("int"))
        right = right.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs", "parts")

        def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if block.empty or asked.empty:
                return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "query_key": "int64", "vec_id": "int64"})
            ids = asked["query_id"].to_numpy()
            q, i, s = search_block(
                block["vec_id"].to_numpy(), _matrix(block["vector"]).astype(float), _matrix(block["place"]), ids, _matrix(asked["query"]).astype(float),
                _matrix(asked["place"]), asked["bound"].to_numpy(float), k, limit, longest,
            )
            return pd.DataFrame({"query_id": ids[q], "query_key": asked["query_key"].to_numpy()[q], "vec_id": i, "score": s})

        keys = ["cell", "sub", "part"]
        found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(search, "query_id long, query_key long, vec_id long, score double")
        return _best(found, k)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, vec_id, score: the k best found of every row of ``queries`` (vec_id, vector), itself left out.

        Ties go to the smaller vec_id. Rows with one id and vector are one query.
        """
        if self.empty:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        dims, draw, cells, low, high, limit, longest = len(self.draw) - 1, self.draw, self.cells, self.low, self.high, self.limit, self.longest
        queries = queries.where(F.size("vector") == dims).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec_id", "vector").alias("query_key"), F.col("vector").alias("query"))
        queries = queries.dropDuplicates(["query_id", "query_key"])

        def home(frames):
            for f in frames:
                places = _matrix(f["query"]).astype(float).reshape(-1, dims) @ draw[:dims]
                f = f.assign(place=list(places), bound=-np.inf)
                yield f.assign(cell=cells[_gap(places, low, high).argmin(axis=1)].astype(np.int32))

        def others(frames):
            for f in frames:
                squares = (_matrix(f["query"]).astype(float).reshape(-1, dims) ** 2).sum(axis=1)
                reach = limit * (squares + longest**2 - 2 * f["bound"].to_numpy()) + _slack(limit, np.sqrt(squares), longest)
                go = _gap(_matrix(f["place"]).reshape(-1, PROJECTED), low, high) <= reach[:, None]
                go &= cells != f["cell"].to_numpy()[:, None]
                at, cell = np.nonzero(go)
                yield f.iloc[at].assign(cell=cells[cell].astype(np.int32))

        kind = "query_id long, query_key long, query array<float>, place array<double>, bound double, cell int"
        first = keep(queries.mapInPandas(home, kind), "ann-queries")
        near = keep(self._round(first, k), "ann-near")
        bound = near.where(F.col("rank") == k).select("query_id", "query_key", F.col("score").alias("b"))
        asked = first.join(bound, ["query_id", "query_key"], "left").withColumn("bound", F.coalesce("b", F.lit(float("-inf")))).select(*first.columns)
        far = keep(asked.mapInPandas(others, kind), "ann-far")
        if len(cells) > 1:
            near = _best(near.drop("rank").unionByName(self._round(far, k).drop("rank")), k)
        return near.select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k)
