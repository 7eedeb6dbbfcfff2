"""Comparing two sets of vectors block by block.

Every vector gets a block number from the hash of its id, so blocks are even however the data
is skewed. Each pair of blocks with the same comparison key is one task-sized piece of work in
which a single matrix product gives all similarities; only the reduced answer of a piece (best
few, counts, a spanning forest) leaves the task, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterline.cluster import small_table, task_count

RESIDENT_BYTES = 64 << 20
PIVOTS = 1_024
SAMPLE_PER_PIVOT = 8
SLACK = 1e-6  # radians; more than the rounding of angles
PAIRS_AT_ONCE = 1 << 24
BLOCK_ROWS = 20_000
SMALLEST_BLOCK = 1_000
TILE_ROWS = 512


def unit_matrix(table: pa.Table, column: str) -> np.ndarray:
    """A vector column as one double matrix of unit rows; a zero vector fails the job."""
    values = table.column(column).combine_chunks()
    if len(values) == 0:
        return np.zeros((0, 0))
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(values), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    if not norms.all():
        raise ValueError("refusing to compare a zero vector")
    return rows / norms


def tiles(rows: int) -> range:
    return range(0, rows, TILE_ROWS)


def block_counts(vectors: DataFrame, keys: list[str], name: str, block_rows: int) -> DataFrame:
    """How many blocks each key needs: enough to keep blocks in memory, and where there is less
    data than that, enough to keep all cores busy. One row per key, counts combined map-side."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    rows = F.count(F.lit(1))
    busy = F.least(F.lit(cores), F.ceil(rows / F.lit(SMALLEST_BLOCK)))
    return vectors.groupBy(*keys).agg(
        F.greatest(F.ceil(rows / F.lit(block_rows)), busy).cast("int").alias(name)
    )


def compare_blocks(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    ids: tuple[str, str],
    compute: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    block_rows: int = BLOCK_ROWS,
    mirrored: bool = False,
) -> DataFrame:
    """Runs ``compute`` on every pair of a left and a right block that share ``keys``.

    Each left row meets each right row of its key exactly once. A left block of a key without
    right rows is still handed over, with an empty right side. When both sides are the same rows
    and order does not matter, ``mirrored`` visits each pair of blocks once instead of twice.
    """
    plan = block_counts(left, keys, "_lefts", block_rows).join(
        right.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_rights")),
        keys,
        "left",
    )
    rights = F.col("_lefts") if mirrored else F.coalesce("_rights", F.lit(1))
    plan = plan.withColumn("_rights", rights)
    copy = small_table(plan)
    plan = plan if copy is None else F.broadcast(copy)
    counted_left, counted_right = left.join(plan, keys), right.join(plan, keys)

    counted_right = counted_right.select(*[F.col(c).alias(c) for c in counted_right.columns])

    def own(id_column: str, blocks: str):
        return F.pmod(F.xxhash64(F.col(id_column)), F.col(blocks)).cast("int")

    first, last = (F.col("_lb"), F.col("_rb")) if mirrored else (F.lit(0), F.col("_lefts") - 1)
    to_meet = F.explode(F.sequence(first, F.col("_rights") - 1))
    met_by = F.explode(F.sequence(F.lit(0), last))
    piece = keys + ["_lb", "_rb"]
    lefts = counted_left.withColumn("_lb", own(ids[0], "_lefts")).withColumn("_rb", to_meet)
    rights = counted_right.withColumn("_rb", own(ids[1], "_rights")).withColumn("_lb", met_by)
    tasks = task_count(left.sparkSession)
    lefts = lefts.drop("_lefts", "_rights").repartition(tasks, *piece)
    rights = rights.drop("_lefts", "_rights").repartition(tasks, *piece)
    return lefts.groupBy(*piece).cogroup(rights.groupBy(*piece)).applyInArrow(compute, schema)


def resident(vectors: DataFrame, ids: list[str], max_bytes: int = RESIDENT_BYTES) -> pa.Table | None:
    """All rows on the driver, if their vectors and ids take at most ``max_bytes``; for a broadcast."""
    width = F.size("embedding") * 8 + 64
    for column in ids:
        width = width + F.octet_length(F.col(column).cast("string"))
    if (vectors.agg(F.sum(width.cast("bigint"))).first()[0] or 0) > max_bytes:
        return None
    return vectors.toArrow()


def compare_resident(
    left: DataFrame, right: pa.Table, key: str, id_column: str, compute: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """``compute`` on every batch of left rows and the resident right rows of the same ``key``; no null key meets
    another. Only the left side is dealt out, and it is no larger than what is resident."""
    held = left.sparkSession.sparkContext.broadcast({"rows": right})

    def look_up(batches):
        value = held.value
        if "keys" not in value:
            keys = value["rows"].column(key)
            value["keys"] = {k: value["rows"].filter(pc.equal(keys, k)) for k in pc.unique(keys).to_pylist() if k is not None}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for k in set(table.column(key).to_pylist()) & set(value["keys"]):
                own, others = table.filter(pc.equal(table.column(key), k)), value["keys"][k]
                rows = max(1, PAIRS_AT_ONCE // max(len(others), 1))
                for at in range(0, len(own), rows):
                    yield from compute(own.slice(at, rows), others).to_batches()

    return left.repartition(task_count(left.sparkSession), id_column).mapInArrow(look_up, schema)


def spread_out(vectors: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of the vectors, each as far as can be from those before it; no two equal."""
    chosen, near = [], np.full(len(vectors), -2.0)
    while len(chosen) < min(count, len(vectors)):
        at = int(near.argmin())
        if near[at] >= 1 - 1e-12:
            break
        chosen.append(at)
        near = np.maximum(near, vectors @ vectors[at])
    return vectors[chosen]


class Cells:
    """Vectors dealt to pivots by angle, and which blocks of cells can hold a neighbour of a vector.

    A neighbour y of x at an angle of at most ``reach`` lies in the cell of a pivot p only if the angle of x and p is
    at most ``reach`` plus the cell's radius, and at most twice ``reach`` more than that of x and its own pivot.
    """

    def __init__(self, pivots: np.ndarray, reach: float):
        self.pivots, self.reach = pivots, reach
        self.radius, self.first, self.parts, self.blocks = None, None, None, 0

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(vectors @ self.pivots.T, -1, 1))

    def pack(self, counts: np.ndarray, radius: np.ndarray, block_rows: int) -> None:
        """Cells into blocks of about ``block_rows``: near cells together, a larger cell into several blocks."""
        order, left = [], set(np.flatnonzero(counts).tolist())
        near = self.pivots @ self.pivots.T
        while left:
            at = max(left, key=lambda c: near[order[-1], c]) if order else min(left)
            order.append(at)
            left.remove(at)
        self.radius = radius
        self.first, self.parts = np.full(len(counts), -1), np.ones(len(counts), np.int64)
        block, filled = -1, block_rows
        for cell in order:
            self.parts[cell] = -(-counts[cell] // block_rows)
            if filled + counts[cell] > block_rows:
                block, filled = block + 1, 0
            self.first[cell] = block
            block += self.parts[cell] - 1
            filled = block_rows if self.parts[cell] > 1 else filled + counts[cell]
        self.blocks = block + 1

    def _blocks_of(self, open_: np.ndarray) -> list[int]:
        """The blocks of some cells, given as a mask."""
        cells = np.flatnonzero(open_ & (self.first >= 0))
        return sorted({b for c in cells for b in range(self.first[c], self.first[c] + self.parts[c])})

    def visits(self, angles: np.ndarray) -> list[list[int]]:
        """Per vector, the blocks that can hold a neighbour of it."""
        own = angles.min(axis=1, keepdims=True)
        open_ = (angles <= self.reach + self.radius + SLACK) & (angles <= own + 2 * self.reach + SLACK)
        same, which = np.unique(open_, axis=0, return_inverse=True)
        lists = [self._blocks_of(row) for row in same]
        return [lists[i] for i in which.ravel()]

    def callers(self, home: np.ndarray) -> list[list[int]]:
        """Per vector, by its cell, the blocks whose vectors can visit the block it lies in."""
        lists = {}
        for cell in np.unique(home):
            here = np.flatnonzero(self.first == self.first[cell])
            near = self.angles(self.pivots[here]) <= self.radius[here, None] + self.reach + self.radius + SLACK
            lists[cell] = self._blocks_of(near.any(axis=0))
        return [lists[c] for c in home]


def compare_cells(
    vectors: DataFrame,
    id_column: str,
    other_column: str,
    threshold: float,
    compute: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    block_rows: int = BLOCK_ROWS,
    pivots: int = PIVOTS,
    mirrored: bool = False,
) -> DataFrame:
    """``compute`` on every pair of blocks that can hold similar vectors.

    Every pair of vectors of one model at or above the cosine ``threshold`` meets once in either order, a vector
    with itself too. Where order does not matter, ``mirrored`` visits each pair of blocks once instead of twice. Vectors are dealt to the nearest of at most ``pivots`` of them; a vector is copied to another
    block only if that lies within the threshold's angle of it. Models, which are few, are taken one by one.
    """
    found = None
    reach = float(np.arccos(np.clip(threshold, -1, 1)))
    tasks = task_count(vectors.sparkSession)
    piece = ["_from", "_to"]
    models = vectors.select("model_version").distinct().filter("model_version is not null").collect()
    for row in models:
        own = vectors.filter(F.col("model_version") == row[0])
        visiting, residing = deal_to_cells(own, id_column, reach, block_rows, pivots)
        residing = residing.withColumnRenamed(id_column, other_column)
        if mirrored:
            visiting, residing = (side.filter("_from <= _to") for side in (visiting, residing))
        left, right = (side.repartition(tasks, *piece).groupBy(*piece) for side in (visiting, residing))
        part = left.cogroup(right).applyInArrow(compute, schema)
        found = part if found is None else found.union(part)
    return vectors.sparkSession.createDataFrame([], schema) if found is None else found


def deal_to_cells(
    vectors: DataFrame, id_column: str, reach: float, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS
) -> tuple[DataFrame, DataFrame]:
    """The vectors as visitors and as residents of pieces (_from, _to): those that lie in block ``_from`` and can have
    a neighbour in block ``_to``, and those that lie in ``_to``. The driver holds a sample of ``SAMPLE_PER_PIVOT`` times
    ``pivots`` vectors, chooses pivots far apart among them, and gets a count and a radius for each.
    """
    sample = vectors.orderBy(F.xxhash64(id_column), id_column).limit(pivots * SAMPLE_PER_PIVOT)
    cells = Cells(spread_out(unit_matrix(sample.select("embedding").toArrow(), "embedding"), pivots), reach)
    held = vectors.sparkSession.sparkContext.broadcast(cells)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                angles = held.value.angles(unit_matrix(pa.Table.from_batches([batch]), "embedding"))
                yield pa.RecordBatch.from_arrays([pa.array(angles.argmin(axis=1)), pa.array(angles.min(axis=1))], names=["cell", "far"])

    sizes = vectors.select("embedding").mapInArrow(place, "cell bigint, far double").groupBy("cell")
    counts, radius = np.zeros(len(cells.pivots), np.int64), np.zeros(len(cells.pivots))
    for row in sizes.agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
        counts[row.cell], radius[row.cell] = row.n, row.far
    cells.pack(counts, radius, block_rows)
    packed = vectors.sparkSession.sparkContext.broadcast(cells)

    def visit(batches):
        for batch in batches:
            if batch.num_rows:
                cells = packed.value
                angles = cells.angles(unit_matrix(pa.Table.from_batches([batch]), "embedding"))
                home = angles.argmin(axis=1)
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (cells.visits(angles), cells.callers(home))]
                columns = [*batch.columns, pa.array(cells.first[home]), pa.array(cells.parts[home]), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_first", "_parts", "_visits", "_callers"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    dealt = vectors.mapInArrow(visit, f"{fields}, _first bigint, _parts bigint, _visits array<bigint>, _callers array<bigint>")
    own = F.col("_first") + F.pmod(F.xxhash64(id_column), F.col("_parts"))
    kept = vectors.columns
    visiting = dealt.select(*kept, own.alias("_from"), F.explode("_visits").alias("_to"))
    return visiting, dealt.select(*kept, F.explode("_callers").alias("_from"), own.alias("_to"))
