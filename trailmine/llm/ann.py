"""Approximate nearest neighbours by cosine, with low-dimensional projections in kd-trees.

Vectors of length one are projected on a few random Gaussian directions.  The squared projected
distance of two vectors, by their squared distance, has a chi-square distribution.  Vectors are read
in order of projected distance from the query and verified, until the test says that one nearer than
the ``k`` found so far would, with the wanted confidence, have come by now.

Two levels: a kd-tree of the projections, fitted on at most ``SAMPLE`` vectors, cuts all vectors into
cells; large cells are cut further by a hash of the id.  Each cell holds a kd-tree of its own.
Queries go to their own cell first.  The ``k``-th distance found there tells, by the same test, which
other cells can matter, and only those are searched.  Everything but the sample and the cell borders
stays distributed; every vector is in exactly one cell.

Defined results: vectors that are NULL, zero or hold a NULL or a non-finite component take no part,
nor do those of another dimension than most; rows with a NULL id take no part; equal vectors count
as they are, ties go to lower ids.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmine.llm.common import settle

DIRECTIONS = 8
CONFIDENCE = 0.98
CELL_ROWS = 8_192
MAX_CELLS = 1_024
SAMPLE = 20_000
LEAF_ROWS = 64
SEED = 7
_TINY = 1e-9


def chi_square_cdf(x: np.ndarray, directions: int) -> np.ndarray:
    """For an even number of degrees of freedom, a finite sum."""
    half = np.minimum(np.asarray(x, float) / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, directions // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_bound(confidence: float, directions: int) -> float:
    """The value that a chi-square variable is below with the given probability."""
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, directions) < confidence else (low, mid)
    return high


def directions_for(dim: int, directions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, directions))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.ascontiguousarray(np.stack(column.to_numpy()).astype(np.float64))


class KdTree:
    """A kd-tree over points, read out leaf by leaf in order of distance from a query."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []
        self.points = points
        if len(points):
            self._build(0, len(points), leaf_rows)

    def _build(self, a: int, b: int, leaf_rows: int) -> int:
        rows = self.order[a:b]
        low, high = self.points[rows].min(axis=0), self.points[rows].max(axis=0)
        at = len(self.nodes)
        self.nodes.append(())
        axis = int((high - low).argmax())
        if b - a <= leaf_rows or high[axis] == low[axis]:
            self.nodes[at] = (low, high, a, b, -1, -1)
            return at
        middle = (b - a) // 2
        self.order[a:b] = rows[np.argpartition(self.points[rows, axis], middle)]
        left = self._build(a, a + middle, leaf_rows)
        right = self._build(a + middle, b, leaf_rows)
        self.nodes[at] = (low, high, a, b, left, right)
        return at

    def leaves(self, query: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Squared distance of each leaf's box, never falling, and its rows."""
        if not self.nodes:
            return

        def distance(node: int) -> float:
            low, high = self.nodes[node][:2]
            gap = np.maximum(np.maximum(low - query, query - high), 0)
            return float(gap @ gap)

        heap = [(distance(0), 0)]
        while heap:
            d, node = heapq.heappop(heap)
            _, _, a, b, left, right = self.nodes[node]
            if left < 0:
                yield d, self.order[a:b]
            else:
                heapq.heappush(heap, (distance(left), left))
                heapq.heappush(heap, (distance(right), right))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times the power of two that brings the largest component of each to one half or more,
    so that squares neither overflow nor vanish.  Scaling by powers of two rounds nothing that
    matters to a cosine."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))
    return np.ldexp(vectors, -exponent)


class CellIndex:
    """The vectors of a cell with the kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: np.ndarray) -> None:
        vectors = scaled(vectors)
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.tree = KdTree(projections)

    def search(
        self, own_id, vector: np.ndarray, projected: np.ndarray, k: int, bound: float, worst: float
    ) -> list[tuple[float, object]]:
        """The ``k`` nearest found, as negative cosine and id.

        ``worst`` is a squared distance that a result must not exceed, from cells seen before.
        """
        vector = scaled(vector)
        norm = math.sqrt(float((vector * vector).sum()))
        found: list[tuple[float, object]] = []
        for box, rows in self.tree.leaves(projected):
            if box > _TINY and box > bound * worst:
                break
            # One sum for each row in a fixed order, so equal vectors have equal scores.
            dots = (self.vectors[rows] * vector).sum(axis=1)
            scores = dots / (self.norms[rows] * norm)
            floor = 1 - worst / 2 - 1e-9
            for i in np.flatnonzero(scores >= floor).tolist():
                other = self.ids[rows[i]].item()
                if other != own_id:
                    found.append((-float(scores[i]), other))
            if len(found) > k:
                found = heapq.nsmallest(k, found)
            if len(found) == k:
                worst = min(worst, 2 + 2 * max(found)[0])
        return sorted(found)


def _cells(sample: np.ndarray, n_cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Borders of a kd-tree with ``n_cells`` leaves, a power of two: axis and value of each inner
    node, in heap order."""
    axes, values = np.zeros(n_cells, int), np.zeros(n_cells)

    def split(node: int, points: np.ndarray) -> None:
        if node >= n_cells:
            return
        if len(points):
            axes[node] = int((points.max(axis=0) - points.min(axis=0)).argmax())
            values[node] = float(np.median(points[:, axes[node]]))
        below = points[:, axes[node]] < values[node] if len(points) else np.zeros(0, bool)
        split(2 * node, points[below])
        split(2 * node + 1, points[~below])

    split(1, sample)
    return axes, values, np.arange(n_cells)


def _cell_of(projected: np.ndarray, axes: np.ndarray, values: np.ndarray) -> np.ndarray:
    n_cells = len(axes)
    node = np.ones(len(projected), int)
    rows = np.arange(len(projected))
    while n_cells > 1:
        node = 2 * node + (projected[rows, axes[node]] >= values[node])
        n_cells //= 2
    return node - len(axes)


def _boxes(axes: np.ndarray, values: np.ndarray, directions: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corner of each cell; outer cells have no border."""
    n = len(axes)
    low, high = np.full((2 * n, directions), -np.inf), np.full((2 * n, directions), np.inf)
    for node in range(1, n):
        for child in (2 * node, 2 * node + 1):
            low[child], high[child] = low[node], high[node]
        high[2 * node, axes[node]] = values[node]
        low[2 * node + 1, axes[node]] = values[node]
    return low[n:], high[n:]


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of rows that take part; components as double."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.select(F.col(id_col).alias("id"), vector.alias("vector")).where(
        F.col("id").isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vector").alias("dim")).count()
    dim = sizes.orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("vector") == (dim["dim"] if dim else 0))


def nearest(
    table: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    directions: int = DIRECTIONS,
    confidence: float = CONFIDENCE,
    cell_rows: int = CELL_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of ``table`` to each row of ``queries``.

    A query's own id is not among its results.  ``score`` is the cosine of the given vectors.
    """
    spark = table.sparkSession
    rows = settle(usable_vectors(table, id_col, vector_col), "ann-vectors")
    asked = usable_vectors(queries, id_col, vector_col)
    first = rows.first()
    kind = rows.schema["id"].dataType.simpleString()
    empty = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if first is None:
        return spark.createDataFrame([], empty)
    dim, n_rows = len(first["vector"]), rows.count()
    asked = asked.where(F.size("vector") == dim)
    axes_of = directions_for(dim, directions, seed)
    bound = chi_square_bound(confidence, directions)

    def project(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        vectors = _matrix(column)
        return vectors, _unit(vectors) @ axes_of

    n_cells = 1
    while n_cells < min(MAX_CELLS, n_rows / cell_rows):
        n_cells *= 2
    # Rows below a hash first, so that no task hands on much more than its part of the sample.
    share = min(1.0, 1.5 * SAMPLE / n_rows)
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = chosen.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()
    axes, values, _ = _cells(project(sample["vector"])[1], n_cells)
    low, high = _boxes(axes, values, directions)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                projected = project(batch["vector"])[1]
                yield batch.assign(cell=_cell_of(projected, axes, values).astype("int32"))

    schema = f"id {kind}, vector array<double>, cell int"
    placed = settle(rows.mapInPandas(assign, schema), "ann-cells")
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    # How many parts a cell is cut into; at most MAX_CELLS numbers.
    parts = np.array([-(-counts.get(c, 0) // (2 * cell_rows)) for c in range(n_cells)])
    part_of = F.element_at(F.array(*[F.lit(max(1, int(p))) for p in parts]), F.col("cell") + 1)
    base = placed.withColumn("part", F.pmod(F.xxhash64("id"), part_of).cast("int")).withColumn(
        "query_id", F.lit(None).cast(kind)).withColumn("worst", F.lit(None).cast("double"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a cell part, all vectors before all queries."""
        group: tuple | None = None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        index: CellIndex | None = None
        for batch in batches:
            out = []
            for key, part in batch.groupby(["cell", "part"], sort=False):
                if key != group:
                    group, ids, vectors, index = key, [], [], None
                is_query = part["worst"].notna()
                own = part[~is_query]
                if len(own):
                    ids.append(own["id"].to_numpy())
                    vectors.append(_matrix(own["vector"]))
                asked_here = part[is_query]
                if not len(asked_here) or not ids:
                    continue
                if index is None:
                    all_vectors = np.concatenate(vectors)
                    index = CellIndex(
                        np.concatenate(ids), all_vectors, _unit(all_vectors) @ axes_of
                    )
                given, projected = project(asked_here["vector"])
                for i, (own_id, worst) in enumerate(
                    zip(asked_here["id"].tolist(), asked_here["worst"].tolist(), strict=True)
                ):
                    near = index.search(own_id, given[i], projected[i], k, bound, worst)
                    out += [(own_id, other, -score) for score, other in near]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found_schema = f"query_id {kind}, vec_id {kind}, score double"
    columns = ["id", "vector", "cell", "part", "worst"]

    def run(wanted: DataFrame) -> DataFrame:
        together = base.select(*columns).unionByName(wanted.select(*columns))
        return (
            together.repartition("cell", "part")
            .sortWithinPartitions("cell", "part", F.col("worst").isNotNull(), "id")
            .mapInPandas(search, found_schema)
        )

    def in_parts(cells: DataFrame) -> DataFrame:
        return cells.withColumn("part", F.explode(F.sequence(F.lit(0), (part_of - 1).cast("int"))))

    homes = asked.mapInPandas(assign, schema).withColumn("worst", F.lit(4.0))
    near = settle(run(in_parts(homes)), "ann-home")
    best = near.groupBy("query_id").agg(
        F.expr(f"slice(sort_array(collect_list(score), false), 1, {k})").alias("scores")
    ).selectExpr(
        "query_id", f"IF(size(scores) < {k}, 4D, 2 - 2 * scores[{k - 1}]) AS worst"
    )

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            projected = project(batch["vector"])[1]
            home = _cell_of(projected, axes, values)
            worst = batch["worst"].to_numpy()
            for i in range(len(batch)):
                gap = np.maximum(np.maximum(low - projected[i], projected[i] - high), 0)
                box = (gap * gap).sum(axis=1)
                wanted = (box <= _TINY) | (box <= bound * worst[i])
                wanted[home[i]] = False
                cells = np.flatnonzero(wanted)
                if len(cells):
                    yield pd.concat([batch.iloc[[i]]] * len(cells), ignore_index=True).assign(
                        cell=cells.astype("int32")
                    )

    queried = asked.join(best, asked["id"] == best["query_id"], "left").select(
        "id", "vector", F.coalesce("worst", F.lit(4.0)).alias("worst")
    )
    spread = queried.mapInPandas(others, f"id {kind}, vector array<double>, worst double, cell int")
    everywhere = near.union(run(in_parts(spread)))
    ranked = everywhere.groupBy("query_id").agg(
        F.expr(
            "slice(array_sort(collect_list(struct(-score AS down, vec_id))), 1, " f"{k})"
        ).alias("found")
    )
    return ranked.selectExpr("query_id", "posexplode(found) AS (at, hit)").selectExpr(
        "query_id", "int(at + 1) AS rank", "hit.vec_id AS vec_id", "-hit.down AS score"
    )
