"""Records of headerless CSV files whose quoted cells may hold line breaks, read by many
tasks per file.

A file is read as lines, in blocks of the file. Whether a line starts inside a quoted
cell depends on all lines before it, but each block only ever turns one of two states
into another, so it is summed up as a function of one bit: one pass works the functions
out, they are folded along each file's blocks, and in a second pass every block joins its
lines to records, knowing how it starts. Nothing is shuffled but the records that reach
over the end of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridwash.functions.cells import column


class _State:
    """Reads lines one by one: where a quoted cell opens and closes, and the number of the
    last cell of the record that is not empty.

    A quote opens a cell at its start only and closes it unless it is doubled; elsewhere
    it is a character like any other.
    """

    def __init__(self, inside: bool, sep: str):
        self.inside, self.sep = inside, sep
        self.cell = self.last = 0

    def read(self, line: str) -> None:
        """The state behind ``line`` and its line break."""
        if self.inside:
            self._holds("\n")
        else:
            self.cell = self.last = 0
        if '"' not in line:
            if self.inside:
                self._holds(line)
            else:
                self._cells(line)
            return
        parts = line.split('"')
        opens, closed = not self.inside, False
        for i, part in enumerate(parts):
            behind = i < len(parts) - 1
            if self.inside:
                self._holds(part)
                if behind:
                    self.inside, closed, opens = False, True, False
            elif closed and part == "" and behind:
                # A doubled quote: the cell goes on.
                self.inside, closed = True, False
                self._holds('"')
            else:
                closed = False
                self._cells(part)
                opens = part.endswith(self.sep) or (opens and part == "")
                if behind and opens:
                    self.inside = True
                elif behind:
                    self._holds('"')
                opens = False

    def _holds(self, text: str) -> None:
        if text:
            self.last = self.cell + 1

    def _cells(self, text: str) -> None:
        first, *others = text.split(self.sep)
        self._holds(first)
        for cell in others:
            self.cell += 1
            self._holds(cell)


def _blocks(batches) -> Iterator[tuple[str, int, list[str]]]:
    """(file, block, lines) in pieces, in the order of the file."""
    for batch in batches:
        files, blocks, lines = (c.to_pylist() for c in batch.columns)
        lo = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or (files[i], blocks[i]) != (files[lo], blocks[lo]):
                yield files[lo], blocks[lo], [x or "" for x in lines[lo:i]]
                lo = i


def _lines(spark: SparkSession, path: str) -> DataFrame:
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return spark.read.text(path).select(*at, "value")


def _block_starts(lines: DataFrame, sep: str) -> dict[tuple[str, int], bool]:
    """{(file, block): does it start inside a quoted cell?} of the blocks that do."""

    def sum_up(batches):
        at, states = None, None
        out = []
        for file, block, some in _blocks(batches):
            if (file, block) != at:
                at, states = (file, block), (_State(False, sep), _State(True, sep))
                out.append((*at, states))
            for state in states:
                for line in some:
                    state.read(line)
        rows = [(file, block, a.inside, b.inside) for file, block, (a, b) in out]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["file", "block", "outside", "inside"]
        )

    functions = lines.mapInArrow(sum_up, "file string, block long, outside boolean, inside boolean")
    # A block that ends the same way however it starts settles the state; between such
    # blocks only the number of those that turn it over counts.
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("outside") & ~F.col("inside")).cast("long")
    counted = functions.withColumn("_n", F.sum(turns).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    settled = F.when(F.col("outside") == F.col("inside"), F.struct("outside", "_n"))
    known = counted.withColumn("_s", F.last(settled, True).over(before)).withColumn("_b", F.last("_n").over(before))
    passed = F.coalesce("_b", F.lit(0)) - F.coalesce("_s._n", F.lit(0))
    starts = F.coalesce("_s.outside", F.lit(False)) != (passed % 2 == 1)
    # One row per block that starts inside a cell.
    return {(r["file"], r["block"]): True for r in known.where(starts).select("file", "block").collect()}


def _records(lines: DataFrame, sep: str, starts: dict) -> DataFrame:
    """(file, block, line, order, text, last, whole): records, and the parts of those that
    reach into another block, which have the block in which they stand as ``order``."""
    names = ["file", "block", "line", "text", "last", "head", "tail"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())

    def join(batches):
        at = state = None
        rows, held, number, begun = [], [], 0, 0

        def close(tail: bool):
            # ``head``: the record has begun in an earlier block.
            rows.append((*at, begun, "\n".join(held), state.last, begun < 0, tail))

        for file, block, some in _blocks(batches):
            if (file, block) != at:
                if held:
                    close(True)
                at, held, number = (file, block), [], 0
                state = _State(starts.get(at, False), sep)
                begun = -1 if state.inside else 0
            for line in some:
                if not held and number:
                    begun = number
                state.read(line)
                held.append(line)
                number += 1
                if not state.inside:
                    close(False)
                    held = []
            if len(rows) >= 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
                rows = []
        if held:
            close(True)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return lines.mapInArrow(join, "file string, block long, line long, text string, last long, head boolean, tail boolean")


def read_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """file, row_id, text, cells: every record of a file or folder of files as one text.

    ``row_id`` grows along a file; ``cells`` is the number of its last cell that is not
    empty. Line breaks are written as \\n. A quoted cell that is never closed reaches to
    the end of its file. Empty lines are records without cells.
    """
    lines = _lines(spark, path)
    found = _records(lines, sep, _block_starts(lines, sep))
    whole = found.where("NOT head AND NOT tail").select("file", "block", "line", "text", F.col("last").alias("cells"))
    parts = found.where("head OR tail")
    # A part belongs to the record that was open last before it.
    order = Window.partitionBy("file").orderBy("block", "line")
    opened = F.last(F.when(~F.col("head"), F.struct("block", "line")), True).over(order)
    piece = F.struct("block", "line", "text", "last", "head")
    joined = parts.withColumn("_r", opened).groupBy("file", "_r").agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: p["text"]), "\n")
    # Cells are counted anew in every block; a part goes on in the cell that was open.
    joined = joined.select("file", F.col("_r.block").alias("block"), F.col("_r.line").alias("line"), text.alias("text"))
    spanning = joined.withColumn("cells", _last_cell(F.col("text"), sep))
    both = whole.unionByName(spanning)
    return both.select("file", (F.col("block") + F.col("line")).alias("row_id"), "text", "cells")


def _last_cell(text: Column, sep: str) -> Column:
    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        out = []
        for record in texts.to_pylist():
            state = _State(False, sep)
            for line in record.split("\n"):
                state.read(line)
            out.append(state.last)
        return pa.array(out, pa.int64())

    return count(text)


def parse_records(n_columns: int, sep: str = ",", text: str = "text", **options) -> list[Column]:
    """Columns c0..cn of the records in a text column."""
    schema = ", ".join(f"c{i} string" for i in range(n_columns))
    given = {"sep": sep, "escape": '"', "maxColumns": str(max(20480, n_columns + 1)), **options}
    cells = F.from_csv(column(text), schema, given)
    return [cells[f"c{i}"].alias(f"c{i}") for i in range(n_columns)]
