"""Returns of many slices compounded in one pass over sorted rows.

Every level of a tree of fan-out ``FAN`` keeps the products of whole nodes that no larger node holds yet;
the equity so far is their product, the larger first.  Rounding grows with the depth only, and long losses
go to 0 where one product after another stays at the smallest numbers above it.  Of a slice, a few numbers
and up to ``CHUNK`` rows and a batch are held at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Sent with its tasks: the engine needs no package on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN = 16
#: Rows of a slice that are worked on at once.
CHUNK = 1 << 15


class Run:
    """One slice's returns, in order; null ones are left out."""

    def __init__(self):
        self.bars, self.mean, self.squares, self.total = 0, 0.0, 0.0, 0.0
        self.peak, self.drop = 1.0, 0.0
        self.levels: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def feed(self, pnl: np.ndarray) -> None:
        self.waiting.append(pnl)
        self.held += len(pnl)
        if self.held >= CHUNK:
            self.settle()

    def equity(self) -> float:
        out = 1.0
        for nodes in reversed(self.levels):
            for x in nodes:
                out *= float(x)
        return out

    def settle(self) -> None:
        x = np.concatenate(self.waiting) if self.waiting else np.empty(0)
        self.waiting, self.held = [], 0
        if not len(x):
            return
        with np.errstate(all="ignore"):
            self._moments(x)
            growth = 1.0 + x
            eq = np.multiply(self.equity(), np.cumprod(growth))
            peaks = np.maximum(np.maximum.accumulate(eq), self.peak)
            self.drop = float(np.fmin(self.drop, np.fmin.reduce(eq / peaks - 1)))
            self.peak = float(peaks[-1])
            self._nodes(growth)

    def _moments(self, x: np.ndarray) -> None:
        n, mean = len(x), float(x.mean())
        away, both = mean - self.mean, self.bars + n
        self.squares += float(np.square(x - mean).sum()) + away * away * self.bars * n / both
        self.mean += away * n / both
        self.total += float(x.sum())
        self.bars = both

    def _nodes(self, nodes: np.ndarray) -> None:
        level = 0
        while len(nodes):
            if level == len(self.levels):
                self.levels.append(np.empty(0))
            nodes = np.concatenate((self.levels[level], nodes))
            whole = len(nodes) // FAN * FAN
            self.levels[level] = nodes[whole:].copy()
            rows = nodes[:whole].reshape(-1, FAN)
            nodes = rows[:, 0].copy()
            for k in range(1, FAN):
                nodes *= rows[:, k]
            level += 1

    def result(self) -> dict:
        self.settle()
        deviation = float(np.sqrt(self.squares / (self.bars - 1))) if self.bars > 1 else None
        return {"bars": self.bars, "mean_bar_return": self.mean, "std_bar_return": deviation, "pnl_sum": self.total, "_end": self.equity(), "max_drawdown": self.drop}


RESULT = "bars long, mean_bar_return double, std_bar_return double, pnl_sum double, _end double, max_drawdown double"


def summaries(values: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (_key, _j, *values) sorted by key and _j, _key null but where _j is 0: rows (_key, value, *RESULT)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs, done, kind = None, None, [], None

        def close() -> None:
            if runs is not None:
                done.extend({"_key": key, "value": name} | run.result() for name, run in zip(values, runs, strict=True) if run.bars or run.held)

        for batch in batches:
            kind = batch.schema.field("_key").type
            keys = batch.column("_key")
            starts = np.flatnonzero(batch.column("_j").to_numpy(zero_copy_only=False) == 0)
            columns = [batch.column(v) for v in values]
            edges = [0, *starts.tolist(), batch.num_rows]
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if i:
                    close()
                    key, runs = keys[a].as_py(), [Run() for _ in values]
                if b > a:
                    for run, column in zip(runs, columns, strict=True):
                        run.feed(column.slice(a, b - a).drop_null().to_numpy(zero_copy_only=False))
            if len(done) >= 1000:
                yield _batch(done, kind)
                done = []
        close()
        if done:
            yield _batch(done, kind)

    return work


def _batch(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    doubles = ("mean_bar_return", "std_bar_return", "pnl_sum", "_end", "max_drawdown")
    types = {"_key": kind, "value": pa.string(), "bars": pa.int64()} | dict.fromkeys(doubles, pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], names=list(types))
