"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their stems of four to six letters, hashed to a fixed
number of slots.  Beside a weight for each slot the machine learns a short vector for each, so that
pairs of terms (an insult and the mention of a group) move the score beyond the sum of their weights.
Training is proximal: weights and vectors without evidence are exactly zero, and only slots with
evidence are broadcast.  A slot has evidence by itself, or with another: of the ``PAIRED`` commonest
words every pair is held against the label beyond what its two words say alone.

All labelled rows decide which slots have evidence; the gradient steps read a bounded sample of them
(``sample`` rows, those of the smallest hash of id and text).  Scores cover every whole text of any
length, each in the memory of its task.  Null and empty texts have no terms and get the score of the bias.
Rows are independent: repeated rows, ties, null ids and further columns change nothing.  An empty
table gives an empty result; without labelled rows, or with one label only, every score is the share
of toxic rows (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, binary_text, slices

SLOTS, FACTORS = 1 << 20, 4
#: Labelled rows that the gradient steps read at most.
SAMPLE = 12_000
CACHE_SIZE = 500_000
#: Least G statistic of a slot with evidence.
SCREEN = 14.0
#: Commonest words (in at most COMMON of all rows) whose pairs are screened, and the least G statistic of a pair.
PAIRED, COMMON, PAIR_SCREEN = 256, 0.75, 25.0

# A-Z lower-cased; whatever is neither letter, digit nor past ASCII is a gap.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes) -> set[bytes]:
    return set(text.translate(_TO_WORDS).split())


def terms(word: bytes) -> list[int]:
    """Slots of a word: itself and its stems."""
    return [crc32(b"=" + word) % SLOTS] + [crc32(b"^" + word[:n]) % SLOTS for n in (4, 5, 6) if len(word) >= n]


class Machine:
    """bias, and weight and vector of the slots with evidence (sorted)."""

    def __init__(self, bias: float, slots: np.ndarray, weight: np.ndarray, vector: np.ndarray):
        self.bias, self.slots, self.weight, self.vector = bias, slots, weight, vector

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    def __init__(self, machine: Machine):
        self.m = machine
        self.row = {int(s): i for i, s in enumerate(machine.slots)}
        self.of: dict[bytes, tuple[int, ...]] = {}

    def rows(self, word: bytes) -> tuple[int, ...]:
        got = self.of.get(word)
        if got is None:
            got = tuple(self.row[t] for t in terms(word) if t in self.row)
            if len(self.of) >= CACHE_SIZE:
                self.of.clear()
            self.of[word] = got
        return got

    def score(self, text: bytes) -> float:
        rows = self.rows
        hit = [r for w in words(text) if (x := rows(w)) for r in x]
        z = self.m.bias
        if hit:
            v = self.m.vector[hit].astype(np.float64)
            z += float(self.m.weight[hit].astype(np.float64).sum()) + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _g_statistic(n1: np.ndarray, n: np.ndarray, total1: int, total: int) -> np.ndarray:
    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)

    p = total1 / total
    n0, rest = n - n1, total - n
    return 2 * (part(n1, n * p) + part(n0, n * (1 - p)) + part(total1 - n1, rest * p) + part(rest - total1 + n1, rest * (1 - p)))


def fit(indptr: np.ndarray, slots: np.ndarray, y: np.ndarray, used: np.ndarray, epochs: int = 20, rate: float = 0.1, l1: float = 1e-5, seed: int = 7) -> Machine:
    """Minibatch AdaGrad on the logistic loss, soft-thresholding weights and whole vectors after each step.

    ``used``: the sorted slots with evidence; row d holds slots[indptr[d]:indptr[d + 1]], all of them used.
    """
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        p = min(max(share, 1e-12), 1 - 1e-12)
        return Machine(float(np.log(p / (1 - p))), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    doc, at = np.repeat(np.arange(len(y)), np.diff(indptr)), np.searchsorted(used, slots)
    start = np.searchsorted(doc, np.arange(len(y) + 1))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(used)), rng.normal(0, 0.05, (len(used), FACTORS))
    gw, gv = np.full(len(used), 1e-2), np.full(len(used), 1e-2)
    bias, gb = np.log(share / (1 - share)), 1e-2
    ever = np.zeros(len(used), bool)  # a vector counts once its slot's weight has moved from zero
    for _ in range(max(epochs, -(-1500 * 128 // max(1, len(y))))):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 128):
            d = order[a : a + 128]
            sizes = start[d + 1] - start[d]
            own = np.repeat(np.arange(len(d)), sizes)
            idx = at[np.repeat(start[d] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]
            act = v[idx] * ever[idx, None]
            total = np.zeros((len(d), FACTORS))
            np.add.at(total, own, act)
            z = bias + np.bincount(own, w[idx], len(d)) + 0.5 * ((total**2).sum(1) - np.bincount(own, (act**2).sum(1), len(d)))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[d]) / len(d)
            u, inv = np.unique(idx, return_inverse=True)
            g = np.bincount(inv, err[own], len(u))
            gw[u] += g**2
            step = rate / np.sqrt(gw[u])
            x = w[u] - step * g
            w[u] = np.sign(x) * np.maximum(np.abs(x) - step * l1, 0)
            live = ever[u]
            if live.any():
                gvec = np.zeros((len(u), FACTORS))
                np.add.at(gvec, inv, err[own][:, None] * (total[own] - act))
                ul, gl = u[live], gvec[live]
                gv[ul] += (gl**2).sum(1)
                s = rate / np.sqrt(gv[ul])
                x = v[ul] - s[:, None] * gl
                norm = np.linalg.norm(x, axis=1)
                v[ul] = x * np.maximum(1 - s * l1 / np.maximum(norm, 1e-12), 0)[:, None]
            ever[u] |= w[u] != 0
            gb += err.sum() ** 2
            bias -= rate / np.sqrt(gb) * err.sum()
    kept = (w != 0) | (ever & (np.abs(v).max(1) > 0))
    return Machine(float(bias), used[kept].astype(np.int64), w[kept].astype(np.float32), (v * ever[:, None])[kept].astype(np.float32))


def _features(of: dict[bytes, list[int]], text: bytes) -> list[int]:
    out: list[int] = []
    for w in words(text):
        got = of.get(w)
        if got is None:
            if len(of) >= CACHE_SIZE:
                of.clear()
            got = of[w] = terms(w)
        out += got
    return out


def evidence(labelled: DataFrame, screen: float = SCREEN) -> np.ndarray:
    """Slots whose presence in a text depends on the label beyond chance, alone or in a pair, by G statistics over all rows.

    Every task adds up its own counts; at most SLOTS of them meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[bytes, list[int]] = {}
        n, word = np.zeros((2, SLOTS), np.int32), np.zeros(SLOTS, bool)
        for batch in batches:
            labels = batch.column(batch.schema.get_field_index("label")).to_pylist()
            for y, t in zip(labels, binary_text(batch), strict=True):
                n[y][np.unique(np.array(_features(of, t), np.int64))] += 1
            word[[x[0] for x in of.values()]] = True
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[0, at], pa.int64()), pa.array(n[1, at], pa.int64()), pa.array(word[at])], ["slot", "n0", "n1", "word"])

    per = labelled.select("text", "label").mapInArrow(run, "slot int, n0 long, n1 long, word boolean")
    per = Scratch(labelled.sparkSession).write(per.groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max("word").alias("word")), "slots")
    totals = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    t1, t = totals.get(1, 0), totals.get(0, 0) + totals.get(1, 0)
    if not t1 or t1 == t:
        return np.zeros(0, np.int64)
    n = F.col("n0") + F.col("n1")
    # A slot without a link to the label beyond a generous bound never leaves the executors.
    lift = F.abs(F.col("n1") / n - F.lit(t1 / t)) * F.sqrt(n / F.lit(t1 / t * (1 - t1 / t)))
    got = per.where((n > 1) & (lift > 1.0)).toArrow()
    n0, n1 = got.column("n0").to_numpy(), got.column("n1").to_numpy()
    strong = _g_statistic(n1.astype(float), (n0 + n1).astype(float), t1, t) >= screen
    alone = got.column("slot").to_numpy()[strong].astype(np.int64)
    common = per.where(F.col("word") & (n <= COMMON * t)).orderBy(n.desc(), "slot").limit(PAIRED).select("slot").toArrow().column("slot").to_numpy()
    return np.union1d(alone, paired_evidence(labelled, np.sort(common.astype(np.int64)), t1, t))


def paired_evidence(labelled: DataFrame, common: np.ndarray, t1: int, t: int) -> np.ndarray:
    """Those of the slots that tell the label in a pair beyond what the two tell alone."""
    shared = labelled.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, of = shared.value, {}
        both = np.zeros((2, len(slots), len(slots)))
        for batch in batches:
            labels = np.array(batch.column(batch.schema.get_field_index("label")).to_pylist())
            x = np.zeros((len(labels), len(slots)), np.float32)
            for i, t in enumerate(binary_text(batch)):
                terms_ = np.array(_features(of, t), np.int64)
                at = np.minimum(np.searchsorted(slots, terms_), len(slots) - 1)
                x[i, at[slots[at] == terms_]] = 1
            for y in (0, 1):
                both[y] += x[labels == y].T @ x[labels == y]
        i, j = np.nonzero(np.triu(both.any(0)))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both[0, i, j].astype(np.int64)), pa.array(both[1, i, j].astype(np.int64))], ["i", "j", "n0", "n1"])

    if len(common) < 2:
        return np.zeros(0, np.int64)
    got = labelled.select("text", "label").mapInArrow(run, "i long, j long, n0 long, n1 long").groupBy("i", "j").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    n = np.zeros((2, len(common), len(common)))
    i, j = got.column("i").to_numpy(), got.column("j").to_numpy()
    n[0, i, j], n[1, i, j] = got.column("n0").to_numpy(), got.column("n1").to_numpy()
    i, j = np.triu_indices(len(common), 1)
    one, two, both = n[:, i, i], n[:, j, j], n[:, i, j]
    whole = np.array([t - t1, t1], float)[:, None]

    def dependence(cells: list[np.ndarray]) -> np.ndarray:
        """G statistic of the label against the cells (2, pairs) that split all rows."""
        g = np.zeros(cells[0].shape[1])
        for c in cells:
            expected = c.sum(0) * whole / t
            g += 2 * np.where(c > 0, c * np.log(np.maximum(c, 1e-12) / np.maximum(expected, 1e-12)), 0).sum(0)
        return g

    joint = dependence([both, one - both, two - both, whole - one - two + both])
    beyond = joint - dependence([one, whole - one]) - dependence([two, whole - two])
    strong = beyond >= PAIR_SCREEN
    return np.union1d(common[i[strong]], common[j[strong]])


def train(labelled: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from rows (text, label).  All of them decide which slots have evidence; the gradient
    steps read at most ``sample`` rows, the same ones on every run."""
    rows = labelled.where(F.col("label").isin(0, 1)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    used = evidence(rows)
    shared = labelled.sparkSession.sparkContext.broadcast(used)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[bytes, list[int]] = {}
        for batch in batches:
            lists = []
            for t in binary_text(batch):
                x = np.sort(np.array(_features(of, t), np.int64))
                i = np.searchsorted(shared.value, x)
                lists.append(x[(i < len(shared.value)) & (shared.value[np.minimum(i, len(shared.value) - 1)] == x)] if len(shared.value) else x[:0])
            get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([get("h"), get("label"), pa.array(lists, pa.list_(pa.int32()))], ["h", "label", "slots"])

    hashed = rows.select(F.xxhash64("doc_id", "text").alias("h"), "text", "label")
    got = hashed.mapInArrow(featurise, "h long, label int, slots array<int>").orderBy("h", "label").limit(sample).toArrow()
    if len(got) == 0:
        return fit(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), used)
    lists = got.column("slots").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    indptr = lists.offsets.to_numpy().astype(np.int64)
    return fit(indptr - indptr[0], lists.flatten().to_numpy().astype(np.int64), got.column("label").to_numpy().astype(np.float64), used)


def toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """Every row of ``docs`` with its columns and ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.slots, machine.weight, machine.vector))
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Machine(*shared.value).scorer()
        for batch in batches:
            texts = binary_text(batch)
            scores = [scorer.score(t) for a, b in slices(texts) for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    name = "score"
    others = docs.drop(name)
    return others.mapInArrow(run, StructType([*others.schema.fields, StructField(name, DoubleType())]))
