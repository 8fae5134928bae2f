"""Automata over the lines of documents, segment by segment, so that a long document spreads over tasks.

A segment of lines is a map from the state in which it is entered to the state in which it is left. Maps are small, and those of a
document are composed in order; each segment then runs from its own first state. Lines are gathered by segment only. Documents of one segment stay
in their rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covara.operators.lines import SEGMENT_LINES


@dataclass(frozen=True)
class Automaton:
    """step(state, symbol) gives (next state, output); states and symbols count from 0, the first state is 0. Output 1 begins something that is numbered."""

    states: int
    symbols: int
    step: Callable[[int, int], tuple[int, int]]
    following: np.ndarray = field(init=False, repr=False)
    outputs: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        table = np.array([[self.step(s, x) for x in range(self.symbols)] for s in range(self.states)], np.int64)
        object.__setattr__(self, "following", table[:, :, 0])
        object.__setattr__(self, "outputs", table[:, :, 1])

    def run(self, symbols: np.ndarray, entered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the outputs of each line, the last state) from each of the states in `entered`."""
        out, state = np.empty((len(symbols), len(entered)), np.int64), entered
        for i, x in enumerate(symbols):
            out[i] = self.outputs[state, x]
            state = self.following[state, x]
        return out, state


def scanned(lines: DataFrame, key: str, machine: Automaton, symbol: Column, mark: Column, carried: list[str], segment_lines: int = SEGMENT_LINES) -> DataFrame:
    """The lines (key, line_no and those of `carried`) for which the machine has an output, with out, number, before and marks.

    number counts the outputs 1 of the document up to the line, before sums `mark` over the lines above it, marks over all.
    line_no counts from 0; a document without lines has no rows. A segment holds `segment_lines` lines.
    """
    following, outputs, states = machine.following, machine.outputs, np.arange(machine.states)
    tables = Automaton(machine.states, machine.symbols, lambda s, x: (int(following[s, x]), int(outputs[s, x])))  # without what step may hold

    def mapped(column: pd.Series) -> pd.Series:
        def of(symbols) -> list[int]:
            out, last = tables.run(np.asarray(symbols), states)
            return [*last.tolist(), *(out == 1).sum(axis=0).tolist()]

        return column.map(of)

    def composed(column: pd.Series, marks: pd.Series) -> pd.Series:
        def of(maps, sums) -> list[dict]:
            out, state, number, before = [], 0, 0, 0
            for m, n in zip(maps, sums):
                out.append({"state": state, "number": number, "before": before})
                state, number, before = int(m[state]), number + int(m[machine.states + state]), before + int(n)
            return out

        return pd.Series([of(m, s) for m, s in zip(column, marks)])

    line = F.struct("line_no", symbol.cast("int").alias("_symbol"), mark.cast("bigint").alias("_mark"), *carried)
    segments = lines.groupBy(key, F.expr(f"line_no div {segment_lines}").alias("_segment")).agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    symbols, marks = F.transform("_lines", lambda x: x["_symbol"]), F.transform("_lines", lambda x: x["_mark"])
    total = lambda column, part: F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + x[part])
    maps = segments.select(key, F.struct("_segment", F.pandas_udf(mapped, "array<int>")(symbols).alias("map"), total("_lines", "_mark").alias("marks")).alias("x"))
    whole = maps.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("all"))  # a few numbers for each segment
    entries = F.pandas_udf(composed, "array<struct<state: int, number: bigint, before: bigint>>")(F.transform("all", lambda x: x["map"]), F.transform("all", lambda x: x["marks"]))
    whole = whole.select(key, total("all", "marks").alias("marks"), F.explode(F.arrays_zip("all", entries.alias("entries"))).alias("e"))
    entered = whole.select(key, "marks", F.col("e.all._segment").alias("_segment"), F.col("e.entries.state").alias("_state"), F.col("e.entries.number").alias("_number"), F.col("e.entries.before").alias("_before"))
    return _walked(segments.join(entered, [key, "_segment"]), key, machine, carried)


def scanned_whole(docs: DataFrame, key: str, machine: Automaton, carried: list[str]) -> DataFrame:
    """The same rows for documents that are one segment each: docs has key and _lines, an array in order of line_no, _symbol, _mark and those of `carried`. Nothing is shuffled."""
    zero = F.lit(0).cast("bigint")
    marks = F.aggregate("_lines", zero, lambda a, x: a + x["_mark"])
    return _walked(docs.select(key, "_lines", marks.alias("marks"), F.lit(0).alias("_state"), zero.alias("_number"), zero.alias("_before")), key, machine, carried)


def _walked(segments: DataFrame, key: str, machine: Automaton, carried: list[str]) -> DataFrame:
    """The lines of segments (key, marks, _lines, _state, _number, _before) for which the machine has an output, each segment run from its own state and counts."""
    following, outputs = machine.following.tolist(), machine.outputs.tolist()

    def placed(entered: pd.Series, number: pd.Series, before: pd.Series, symbols: pd.Series, marks: pd.Series) -> pd.Series:
        def of(state, n, b, xs, ms) -> list[dict]:
            found = []
            for i, (x, m) in enumerate(zip(xs.tolist(), ms.tolist())):
                if out := outputs[state][x]:
                    n += out == 1
                    found.append({"at": i, "out": out, "number": n, "before": b})
                state, b = following[state][x], b + m
            return found

        return pd.Series([of(*x) for x in zip(entered, number, before, symbols, marks)])

    symbols, marks = F.transform("_lines", lambda x: x["_symbol"]), F.transform("_lines", lambda x: x["_mark"])
    outs = F.pandas_udf(placed, "array<struct<at: int, out: int, number: bigint, before: bigint>>")("_state", "_number", "_before", symbols, marks)
    rows = segments.select(key, "marks", "_lines", outs.alias("_outs"))
    found = rows.select(key, "marks", F.explode(F.transform("_outs", lambda o: F.struct(F.get("_lines", o["at"]).alias("x"), o.alias("o")))).alias("y"))
    return found.select(key, "y.x.line_no", *(f"y.x.{c}" for c in carried), "y.o.out", "y.o.number", "y.o.before", "marks")
