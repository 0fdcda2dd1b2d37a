"""Small state machines over ordered events, folded range by range.

An event is a function from state to state. Functions of one kind compose into one of the same kind, so each range of a key's
events is first composed by itself, the ranges' functions then give the state at which each range begins, and a second walk
gives the state after every event. No key's events are one task's, and a task holds one function or state at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.ordered import RANGES, ranged


@dataclass(frozen=True)
class Lockout:
    """Consecutive drifts up to ``drifts``, which lock for ``locked`` events, each counting down; an event is 1 if it drifts.

    States are numbered: drifts so far, then what is left of a lockout. A function lists the next state of each."""

    drifts: int = 3
    locked: int = 5

    start = 0

    def event(self, drifting: int) -> tuple[int, ...]:
        free = tuple((d + 1 if d + 1 < self.drifts else self.drifts + self.locked - 1) if drifting else 0 for d in range(self.drifts))
        return free + tuple(0 if left == 1 else self.drifts + left - 2 for left in range(1, self.locked + 1))

    def after(self, f: tuple[int, ...], g: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(g[s] for s in f)

    def at(self, f: tuple[int, ...], state: int) -> int:
        return f[state]


@dataclass(frozen=True)
class ClampedSum:
    """A sum kept between ``-most`` and ``most``; an event is a whole number to add, within ``-step`` and ``step``, or null,
    which starts at 0 again. A function is (shift, low, high): add, then keep between."""

    step: int = 200
    most: int = 2000

    start = 0

    def event(self, amount: int | None) -> tuple[int, int, int]:
        return (0, 0, 0) if amount is None else (max(-self.step, min(self.step, amount)), -self.most, self.most)

    def after(self, f: tuple[int, int, int], g: tuple[int, int, int]) -> tuple[int, int, int]:
        return (f[0] + g[0], self.at(g, f[1]), self.at(g, f[2]))

    def at(self, f: tuple[int, int, int], state: int) -> int:
        return min(f[2], max(f[1], state + f[0]))


def _starts(key: tuple, functions: list[tuple[int, list[list[int]]]], machines: list) -> list[tuple]:
    states, out = [m.start for m in machines], []
    for at, fs in sorted(functions):
        out.append((at, list(states)))
        states = [m.at(tuple(f), s) for m, f, s in zip(machines, fs, states, strict=True)]
    return out


def states(df: DataFrame, key: str, order: str, machines: dict[str, tuple[object, Column]], ranges: int = RANGES) -> DataFrame:
    """key, order and a column a machine: its state after each event. ``machines`` has the machine and the event's column.

    Events of a key follow by ``order``; events of one order by their values, nulls first. Rows whose key or order is null have
    no place and are out. An empty table gives an empty result."""
    names, kinds = list(machines), {f.name: f.dataType.simpleString() for f in df.schema}
    own = [m for m, _ in machines.values()]
    events = df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(key, order, *(c.cast("bigint").alias(f"_e{i}") for i, (_, c) in enumerate(machines.values())))
    inputs = [f"_e{i}" for i in range(len(own))]
    r = ranged(events, order, ranges)
    dealt = lambda x: x.repartition(key, "_range").sortWithinPartitions(key, "_range", order, *inputs)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fs, kind = None, [], None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], kind), pa.array([at[1]], pa.int32()), pa.array([[list(f) for f in fs]], pa.list_(pa.list_(pa.int64())))], names=[key, "_range", "_f"])
        for b in batches:
            kind = b.schema.field(key).type
            for k, where, *values in zip(*(b.column(c).to_pylist() for c in (key, "_range", *inputs)), strict=True):
                new = [m.event(v) for m, v in zip(own, values, strict=True)]
                if (k, where) == at:
                    fs = [m.after(f, g) for m, f, g in zip(own, fs, new, strict=True)]
                    continue
                if at is not None:
                    yield row()
                at, fs = (k, where), new
        if at is not None:
            yield row()

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, where, state = [], [], []
            for k, parts in zip(b.column(key).to_pylist(), b.column("_parts").to_pylist(), strict=True):
                for at, now in _starts(k, [(p["_range"], p["_f"]) for p in parts], own):
                    keys.append(k)
                    where.append(at)
                    state.append(now)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(key).type), pa.array(where, pa.int32()), pa.array(state, pa.list_(pa.int64()))], names=[key, "_range", "_s"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, []
        for b in batches:
            out: list[list[int]] = [[] for _ in own]
            for k, where, s, *values in zip(*(b.column(c).to_pylist() for c in (key, "_range", "_s", *inputs)), strict=True):
                if (k, where) != at:
                    at, now = (k, where), s
                now = [m.at(m.event(v), x) for m, v, x in zip(own, values, now, strict=True)]
                for column, x in zip(out, now, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(order), *(pa.array(x, pa.int64()) for x in out)], names=[key, order, *names])

    composed = dealt(r).mapInArrow(compose, f"{key} {kinds[key]}, _range int, _f array<array<bigint>>")
    starts = composed.groupBy(key).agg(F.collect_list(F.struct("_range", "_f")).alias("_parts")).mapInArrow(begin, f"{key} {kinds[key]}, _range int, _s array<bigint>")
    return dealt(r.join(starts, [key, "_range"])).mapInArrow(walk, f"{key} {kinds[key]}, {order} {kinds[order]}, " + ", ".join(f"{n} bigint" for n in names))
