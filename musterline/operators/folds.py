"""Ordered folds: a running state per key, updated row by row in time order.

A key with more rows than ``max_rows`` is cut along its time column into pieces that are folded side
by side. Each piece first starts from the empty state; its real starting state is the end state of the
piece before it, so pieces whose starting state turns out different are folded again until nothing
changes. The first piece is right from the beginning and correctness moves on by at least one piece per
round, so the end result equals the sequential fold. Where a round leaves more than half of its pieces
unsettled, the state does not forget where it came from within a piece; what is unsettled of a key is then
folded in one go behind what is settled.

What only names things is kept out of the comparison. A step may hold things that live on across a cut
(tracks); inside a piece those it started with are known by their slot, and their names and order of
creation are filled in afterwards by one pass over the ends of the pieces. So a thing that stays in view
for many pieces costs no round. Only where the order of such things decided something (``leaned``) is
a piece folded again if that order was guessed wrong.

Inside a task rows are streamed in sort order; only the state is held, never a whole group.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from musterline.cluster import cut_lineage, discard, task_count

MAX_ROWS_PER_PIECE = 1_000_000
OUTPUT_ROWS = 10_000
ENDS = "_began string, _order string, _state string, _slots string, _leaned boolean"
ARROW_TYPES = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "boolean": pa.bool_(),
    "double": pa.float64(),
}


class Step:
    """One fold. ``push`` takes (row, values of the ``reads`` columns) and returns finished rows as
    (row, added values). ``close`` flushes at the end of a piece. ``dump`` and ``load`` carry a whole
    state over."""

    reads: list[str]
    adds: str

    def start(self) -> Any:
        raise NotImplementedError

    def push(self, state: Any, row: tuple) -> Iterable[tuple[tuple, tuple]]:
        raise NotImplementedError

    def close(self, state: Any) -> Iterable[tuple[tuple, tuple]]:
        return []

    def dump(self, state: Any) -> str:
        raise NotImplementedError

    def load(self, text: str) -> Any:
        raise NotImplementedError

    def outline(self, state: Any) -> tuple[str, list[list]]:
        """What later rows depend on, equal for equal states, and the things named beside it: for each
        slot two numbers that name it and its place in the order of creation."""
        return self.dump(state), []

    def resume(self, text: str, slots: list[list]) -> Any:
        """The state of an outline; a slot named (None, number) stands for what the piece began with."""
        return self.load(text)

    def leaned(self, state: Any) -> bool:
        """Whether the order of things from before the piece has decided anything."""
        return False


class ColumnStep(Step):
    """A step that takes a batch of sorted rows at once. ``act`` gets which rows start a piece, the states
    that entry rows stand for, and the ``reads`` columns; it returns the added columns, and a function from
    a row's position to the state after it."""

    def act(self, starts: np.ndarray, entered: dict[int, Any], reads: pa.Table) -> tuple[list[pa.Array], Any]:
        raise NotImplementedError


def fold(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    step: Step,
    max_rows: int = MAX_ROWS_PER_PIECE,
) -> DataFrame:
    """Every row of ``rows`` with the columns ``step.adds``; ``order[0]`` is a bigint along which
    large keys are cut, and rows that share its value stay together. The input is computed once."""
    rows = cut_lineage(rows)
    along = order[0]
    sizes = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(along).alias("_from"), F.max(along).alias("_to")
    )
    span = F.ceil((F.col("_to") - F.col("_from") + 1) * F.lit(float(max_rows)) / F.col("_rows"))
    cuts = cut_lineage(
        sizes.filter(F.col("_rows") > max_rows).select(*keys, "_from", span.alias("_span"))
    )
    piece = F.floor((F.col(along) - F.col("_from")) / F.col("_span")).cast("bigint")
    whole = [*rows.columns, F.coalesce(piece, F.lit(0)).cast("bigint").alias("_piece")]
    entries, pieces = None, rows.join(cuts, keys, "left").select(*whole)
    if not cuts.isEmpty():
        entries, open_ = settled(rows.join(cuts, keys).select(*whole), keys, order, step)
        # One piece from the first unsettled one on; least passes over the nulls of settled keys.
        first = F.least("_piece", "_first").alias("_piece")
        pieces = pieces.join(open_, keys, "left").select(*rows.columns, first)
        entries = entries.join(open_, keys, "left").filter("_first is null or _piece <= _first").drop("_first")
    return _run(pieces, entries, keys, order, step, False)


def settled(pieces: DataFrame, keys: list[str], order: list[str], step: Step) -> tuple[DataFrame, DataFrame]:
    """The true starting state of every piece but the first of its key; and of keys that were given up, the first
    piece (``_first``) that is not settled, whose starting state is true, too."""
    where = keys + ["_piece"]
    ends = cut_lineage(_run(pieces, None, keys, order, step, True))
    entries = cut_lineage(_entries(ends, keys))
    stale = entries.filter("_stale")
    left = stale.count()
    while left:
        again = pieces.join(stale.select(*where), where, "left_semi")
        redone = cut_lineage(_run(again, stale.drop("_stale"), keys, order, step, True))
        others, old = ends, entries
        ends = cut_lineage(others.join(redone.select(*where), where, "left_anti").unionByName(redone))
        entries = cut_lineage(_entries(ends, keys))
        for table in (others, redone, old):
            discard(table)
        stale = entries.filter("_stale")
        before, left = left, stale.count()
        if 2 * left > before:
            break
    discard(ends)
    open_ = stale.groupBy(*keys).agg(F.min("_piece").alias("_first"))
    return entries.drop("_stale"), open_


def _entries(ends: DataFrame, keys: list[str]) -> DataFrame:
    """The state each piece starts from, its slots named, and whether the piece was folded from another
    one. Reads one row per piece, in order."""
    where = keys + ["_piece"]
    placed = ends.repartition(task_count(ends.sparkSession), *keys).sortWithinPartitions(*where)
    schema = StructType([ends.schema[c] for c in where] + StructType.fromDDL("_state string, _slots string, _stale boolean").fields)
    width = len(keys)

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text, names = None, None, []
        for batch in batches:
            out = []
            for row in zip(*[batch.column(c).to_pylist() for c in where + ["_began", "_order", "_state", "_slots", "_leaned"]]):
                began, used, state, slots, leaned = row[width + 1 :]
                if row[:width] != key:
                    key, names = row[:width], []
                else:
                    rank = {n: i for i, n in enumerate(sorted(range(len(names)), key=lambda n: names[n]))}
                    order = [rank[n] for n in range(len(names))]
                    stale = text != began or (leaned and order != json.loads(used))
                    named = json.dumps([[*name, place] for name, place in zip(names, order)])
                    out.append((*row[: width + 1], text, named, stale))
                # A piece folded from another state may speak of slots that are not there; it comes again.
                known = dict(enumerate(names))
                names = [known.get(b, (0, b)) if a is None else (a, b) for a, b, _ in json.loads(slots)]
                text = state
            columns = list(zip(*out)) or [()] * len(schema)
            types = [batch.schema.field(c).type for c in where] + [pa.string(), pa.string(), pa.bool_()]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return placed.mapInArrow(hand_on, schema)


def _run(
    rows: DataFrame,
    entries: DataFrame | None,
    keys: list[str],
    order: list[str],
    step: Step,
    only_ends: bool,
) -> DataFrame:
    """One pass over all pieces: where each began and ended, or its rows with the added columns."""
    where = keys + ["_piece"]
    kept = [c for c in rows.columns if c != "_piece"]
    nothing = F.lit(None).cast("string")
    tagged = rows.withColumns({"_state": nothing, "_slots": nothing})
    if entries is not None:
        tagged = tagged.unionByName(entries.select(*where, "_state", "_slots"), allowMissingColumns=True)
    placed = tagged.repartition(task_count(rows.sparkSession), *where).sortWithinPartitions(
        *where, F.col("_state").isNull(), *order
    )
    told, came = (where, ENDS) if only_ends else (kept, step.adds)
    added = StructType.fromDDL(came)
    schema = StructType([rows.schema[c] for c in told] + added.fields)
    added_types = [(f.name, ARROW_TYPES[f.dataType.simpleString()]) for f in added.fields]
    names = placed.columns
    if isinstance(step, ColumnStep):
        return placed.mapInArrow(_by_columns(step, where, kept, only_ends, schema.names), schema)

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seat = {name: i for i, name in enumerate(names)}
        where_of, kept_of, reads_of = (picked([seat[c] for c in columns]) for columns in (where, kept, step.reads))
        state_at, slots_at = seat["_state"], seat["_slots"]
        current, state, began, ready, arrow = None, None, None, [], None

        def finished(done):
            ready.extend(kept_of(row) + tuple(extra) for row, extra in done)

        def begin(text, slots):
            if text is None:
                empty = step.start()
                return empty, (step.outline(empty)[0], "[]")
            named = json.loads(slots)
            order = json.dumps([place for *_, place in named])
            if only_ends:
                named = [[None, n, place] for n, (*_, place) in enumerate(named)]
            return step.resume(text, named), (text, order)

        def end_piece():
            if current is not None:
                done = step.close(state)
                if only_ends:
                    text, slots = step.outline(state)
                    ready.append(current + began + (text, json.dumps(slots), step.leaned(state)))
                else:
                    finished(done)

        def flush():
            columns = zip(*ready) if ready else [[]] * len(arrow)
            arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow)]
            ready.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            if arrow is None:
                arrow = pa.schema([(c, batch.schema.field(c).type) for c in told] + added_types)
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns):
                place = where_of(row)
                if place != current:
                    end_piece()
                    current = place
                    state, began = begin(row[state_at], row[slots_at])
                if row[state_at] is not None:
                    continue
                done = step.push(state, (row, reads_of(row)))
                if not only_ends:
                    finished(done)
                if len(ready) >= OUTPUT_ROWS:
                    yield flush()
        end_piece()
        if arrow is not None:
            yield flush()

    return placed.mapInArrow(pass_over, schema)


def picked(seats: list[int]) -> Callable[[tuple], tuple]:
    """The values of a row at some seats, as a tuple."""
    if len(seats) == 1:
        return lambda row, seat=seats[0]: (row[seat],)
    return itemgetter(*seats) if seats else lambda row: ()


def _by_columns(step: ColumnStep, where: list[str], kept: list[str], only_ends: bool, names: list[str]):
    """The same pass for a step that works on columns. Between batches only the last state is held; it goes
    before the rows that follow as an entry of their piece."""

    def changes(column: pa.ChunkedArray) -> np.ndarray:
        here, before = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        other = pc.fill_null(pc.not_equal(here, before), False)
        return pc.or_(other, pc.not_equal(pc.is_null(here), pc.is_null(before))).to_numpy()

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = None, None  # held: where the last piece is, what it began with, its state

        def ends(rows):
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            types = [batch.schema.field(c).type for c in where] + [pa.string()] * 4 + [pa.bool_()]
            if held is not None:
                fixed = dict(zip([*where, "_state", "_slots"], [*held[0], held[2], "[]"]))
                row = [pa.array([fixed.get(f.name)], f.type) for f in batch.schema]
                table = pa.concat_tables([pa.Table.from_arrays(row, schema=batch.schema), table])
            table = table.combine_chunks()
            starts = np.ones(len(table), dtype=bool)
            starts[1:] = np.logical_or.reduce([changes(table.column(c)) for c in where])
            is_row = pc.is_null(table.column("_state"))
            texts = {int(i): table.column("_state")[int(i)].as_py() for i in np.flatnonzero(~is_row.to_numpy())}
            entered = {i: step.load(text) for i, text in texts.items()}
            added, state_after = step.act(starts, entered, table.select(step.reads))
            firsts = np.flatnonzero(starts)
            lasts = np.append(firsts[1:], len(table)) - 1
            done = []
            for first, last in zip(firsts, lasts) if only_ends else [(firsts[-1], lasts[-1])]:
                place = tuple(table.column(c)[int(first)].as_py() for c in where)
                began = texts.get(int(first), step.dump(step.start()))
                if first == 0 and held is not None and place == held[0]:
                    began = held[1]
                done.append((place, began, step.dump(state_after(int(last)))))
            if only_ends:
                # A piece that had ended with the batch before is a lone entry here, and ends now.
                if len(done) > 1:
                    yield ends([(*p, b, "[]", text, "[]", False) for p, b, text in done[:-1]])
            else:
                columns = [table.column(c) for c in kept] + added
                yield from pa.Table.from_arrays(columns, names=names).filter(is_row).combine_chunks().to_batches()
            held = done[-1]
        if only_ends and held is not None:
            yield ends([(*held[0], held[1], "[]", held[2], "[]", False)])

    return pass_over
