"""Exact top-k search by inner product over an impact-ordered index.

Vectors become integers, floor(``SCALE`` * x).  Candidates are dealt into blocks of about ``BLOCK``
rows.  Of a block, a posting is a component's sign and quantised size (1 to 255) for one dimension
and row; postings of like size form segments, processed from the largest down for a batch of queries
at once.  After a segment every row's score is known within a bound of the sizes still to come plus
the quantisation error.  A query stops once at most a few rows can reach its k best (the proof is the
k-th best lower bound), and exactly those are rescored in integers; if no early proof comes, the
postings run out and the bound is the quantisation error alone.

The queries stream past each block, so a task holds one block and one batch.  Every query's best of
each block meet in one ranking.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id.
Vectors meet those of their own length only.  Rows that repeat an id are queries and candidates of
their own: a query leaves out its own row alone.  Ties go to the smaller id, and then to either row.
Vectors may have any length, a block's in the memory of its task.
Scores past 64 bits saturate.  Further columns change nothing;
an empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch

SCALE, BLOCK, LEVELS, SEGMENTS = 1024.0, 4096, 255, 16
#: A query is rescored once so many times k rows remain possible.
POSSIBLE = 4


class Index:
    """The segments of one block: masked matrices of quantised components, largest sizes first."""

    def __init__(self, ids: np.ndarray, rids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rids, ids))
        self.ids, self.rids, self.vectors = ids[order], rids[order], vectors[order]
        size = np.abs(self.vectors)
        top = float(size.max()) if size.size else 0.0
        self.step = max(1.0, np.ceil((top + 1) / (LEVELS + 1)))
        level = np.floor(size / self.step)
        self.wide = top > 2**20
        edges = np.unique(np.linspace(0, LEVELS, SEGMENTS + 1).astype(int))
        self.segments = []
        for low, high in reversed(list(zip(edges[:-1] + 1, edges[1:], strict=True))):
            inside = (level >= low) & (level <= high)
            if inside.any():
                # what is left after this segment has a size below low * step
                self.segments.append((low * self.step, np.where(inside, np.sign(self.vectors) * level * self.step, 0.0).T.copy()))
        self.top = top

    def exact(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if not self.wide and np.abs(query).max(initial=0) <= 2**20:
            return self.vectors[rows].astype(np.int64) @ query.astype(np.int64)
        most = 2**63 - 1
        q = [int(x) for x in query]
        return np.array([max(-most - 1, min(most, sum(a * int(b) for a, b in zip(q, v, strict=True)))) for v in self.vectors[rows]], np.int64)

    def search(self, qrids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, ids, scores) of each query's k best rows here, best first, its own row left out."""
        n = len(self.ids)
        weight = np.abs(queries).sum(1)
        live, score = np.arange(len(queries)), np.zeros((len(queries), n))
        own = qrids[:, None] == self.rids[None, :]
        found = []
        # Scores that may saturate tie among themselves, which bounds can't tell: rescore every row.
        huge = np.full(len(queries), self.wide) | (np.abs(queries).max(1, initial=0) > 2**20)
        for j in np.flatnonzero(huge):
            rows = np.flatnonzero(~own[j])
            exact = self.exact(queries[j], rows)
            best = np.array(sorted(range(len(rows)), key=lambda i: (-int(exact[i]), int(self.ids[rows[i]])))[:k], np.int64)  # noqa: B023
            found.append((int(j), self.ids[rows][best], exact[best]))
        live = live[~huge]
        for i, (below, values) in enumerate([(self.top + 1, None), *self.segments, (1.0, None)]):
            if values is not None:
                score[live] += queries[live] @ values
            last = i == len(self.segments) + 1
            # sizes to come, or the quantisation error of those seen, and the rounding of the sums
            slack = weight[live] * (max(below, self.step) if not last else self.step) * (1 + 1e-9) + 1e-6
            here = np.where(own[live], -np.inf, score[live])
            if n > k:
                floor = np.partition(here, n - k, axis=1)[:, n - k] - slack
            else:
                floor = np.full(len(live), -np.inf)
            possible = (here + slack[:, None] >= floor[:, None]) & ~own[live]
            done = possible.sum(1) <= (POSSIBLE * k if not last else n)
            for j in np.flatnonzero(done):
                rows = np.flatnonzero(possible[j])
                exact = self.exact(queries[live[j]], rows)
                best = np.lexsort((self.ids[rows], -exact))[:k]
                found.append((int(live[j]), self.ids[rows][best], exact[best]))
            live = live[~done]
            if not len(live):
                break
        return found


def _valid(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def topk_search(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every row of which ``is_query`` holds."""
    chosen = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("vec_id").isNotNull() & _valid(F.col("v")))
    rows = Scratch(vectors.sparkSession).write(chosen.withColumn("rid", F.monotonically_increasing_id()), "rows")
    n_blocks = max(1, -(-rows.count() // block))
    candidates = rows.select(F.pmod(F.xxhash64("rid"), F.lit(n_blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "vec_id", "rid", "v")
    queries = rows.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(1).alias("side"), "vec_id", "rid", "v")
    both = candidates.unionByName(queries).withColumn("dim", F.size("v")).repartition("block", "dim").sortWithinPartitions("block", "dim", "side", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731, B023
            block_, dim, side, ids, rids = (get(n).to_numpy(zero_copy_only=False) for n in ("block", "dim", "side", "vec_id", "rid"))
            offsets = get("v").offsets.to_numpy()
            flat = get("v").values.to_numpy(zero_copy_only=False)
            change = np.flatnonzero(np.r_[True, (block_[1:] != block_[:-1]) | (dim[1:] != dim[:-1]) | (side[1:] != side[:-1])])
            out: tuple[list, ...] = ([], [], [], [])
            for a, b in zip(change, np.r_[change[1:], len(ids)], strict=True):
                if (block_[a], dim[a]) != at:
                    at, held, index = (block_[a], dim[a]), [], None
                values = np.floor(SCALE * flat[offsets[a] : offsets[b]].reshape(b - a, dim[a]))
                if side[a] == 0:
                    held.append((ids[a:b], rids[a:b], values))
                    continue
                if not held:
                    continue
                if index is None:
                    index = Index(*(np.concatenate(x) for x in zip(*held, strict=True)))
                for lo in range(0, b - a, 64):
                    mine = slice(a + lo, min(b, a + lo + 64))
                    for j, best, scores in index.search(rids[mine], values[lo : lo + 64], k):
                        out[0].extend([rids[mine][j]] * len(best))
                        out[1].extend([ids[mine][j]] * len(best))
                        out[2].extend(best.tolist())
                        out[3].extend(scores.tolist())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_rid", "query_id", "vec_id", "score"])

    per_block = both.mapInArrow(run, "query_rid long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id")
    return per_block.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
