"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has bit b set if more than half of the text's shingle hashes have it.  Distinct
fingerprints are cut into ``blocks`` bit blocks; two within ``radius`` bits agree on blocks - radius
of them, so every choice of that many blocks is a key, and linked fingerprints share one.  Of each
key's bucket the fingerprints are stored vertically, 64 to a machine word per bit plane.  One
fingerprint against such a block is one XOR per plane; carry-save adders update all 64 distances at
once, and a comparison is abandoned when all its lanes exceed the radius.

Buckets of more than ``CHUNK`` fingerprints are dealt into parts, and each pair of parts is a cell of
its own, so no task holds a whole hot bucket and no pair is left out.  A cell emits a spanning forest
of its links, never all pairs.  Components come from star contraction over those forests.

Words: A-Z lower-cased, split at white space.  Texts of fewer words than a shingle have one, the whole
sequence; null, empty and blank texts have fingerprint zero, linked like any other.  The component id
is the smallest doc_id reachable; null ids are members but never its name (null if there is no other).
Repeated rows have equal fingerprints; texts may have any length, each in the memory of its task.
Further columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, binary_text, connected_components, slices

SHINGLE, RADIUS, BLOCKS = 4, 4, 6
#: Fingerprints of a bucket in one part.
CHUNK = 512
#: Rows that a task compares at once.
ROWS = 16_384
_PAIRS = 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start = np.r_[0, end[:-1]][:n].tolist()
    stop = (end[min(size, len(words)) - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 8192):
        h = np.array([xxh64_intdigest(joined[x:y], 42) for x, y in zip(start[a : a + 8192], stop[a : a + 8192])], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_text(batch)
            fps = np.array([fingerprint(t, size) for a, b in slices(texts) for t in texts[a:b]], np.uint64).view(np.int64)
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps)], ["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp long")


def _key_columns(blocks: int, radius: int):
    """For every choice of agreeing blocks, its number and the bits in them, as one array column."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")))
    return F.array(*keys)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 fingerprints: row per block, column per bit; lane i is bit i of a word."""
    n = -(-len(fps) // 64)
    padded = np.zeros(n * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(n, 64, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(n, 64, 8).copy().view("<u8").reshape(n, 64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three words, lane by lane."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def near_lanes(query: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Comparisons with lanes left, and those lanes: each query against its block of planes.

    ``lanes`` holds the lanes to look at.  Counters of 1, 2 and 4 take four planes at a time; a lane
    that passes 7 or the radius is out, and a comparison without lanes is abandoned.
    """
    which = np.arange(len(query))
    ones, twos, fours = np.zeros_like(lanes), np.zeros_like(lanes), np.zeros_like(lanes)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(0, 64, 4):
        x = [block[:, b + j] ^ (((query >> np.uint64(b + j)) & np.uint64(1)) * full) for j in range(4)]
        ones, a2 = _add(ones, x[0], x[1])
        ones, b2 = _add(ones, x[2], x[3])
        twos, a4 = _add(twos, a2, b2)
        lanes = lanes & ~(fours & a4)
        fours = fours | a4
        over = np.zeros_like(lanes)
        for v in range(radius + 1, 8):
            over |= (ones if v & 1 else ~ones) & (twos if v & 2 else ~twos) & (fours if v & 4 else ~fours)
        lanes = lanes & ~over
        alive = lanes != 0
        if not alive.all():
            which, query, block, lanes = which[alive], query[alive], block[alive], lanes[alive]
            ones, twos, fours = ones[alive], twos[alive], fours[alive]
        if not len(which):
            break
    return which, lanes


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the label classes (labels are indices of their smallest members) along links a-b."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            down = label[label]
            if (down == label).all():
                break
            label[:] = down


def cell_forest(cell: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Rows (fp, smaller root) of a spanning forest of the links in every cell.

    Rows are sorted by cell, then side.  In cells with both sides 0 and 1 only links across count;
    in others all of them.
    """
    n = len(fps)
    begins = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    ends = np.r_[begins[1:], n]
    label = np.arange(n)
    blocks, first, length, q, qb, qmin = [], [], [], [], [], []
    n_blocks = 0
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if b - a < 2:
            continue
        cut = a + int(np.count_nonzero(side[a:b] == 0))
        across = a < cut < b
        lo = cut if across else a
        k = -(-(b - lo) // 64)
        blocks.append(planes(fps[lo:b]))
        own = np.arange(lo, b, 64)
        first.append(own)
        length.append(np.minimum(64, b - own))
        queries = np.arange(a, cut) if across else np.arange(a, b)
        # one side only: compare with later rows, so skip blocks that end before the query
        qi, bi = np.repeat(queries, k), np.tile(np.arange(n_blocks, n_blocks + k), len(queries))
        if not across:
            keep = np.tile(own + 63, len(queries)) > qi
            qi, bi = qi[keep], bi[keep]
        q.append(qi)
        qb.append(bi)
        qmin.append(np.full(len(qi), -1) if across else qi)
        n_blocks += k
    if not blocks:
        return np.zeros((0, 2), np.uint64)
    planes_, first_, length_ = np.concatenate(blocks), np.concatenate(first), np.concatenate(length)
    q_, b_, min_ = np.concatenate(q), np.concatenate(qb), np.concatenate(qmin)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for a in range(0, len(q_), _PAIRS):
        qi, bi, least = q_[a : a + _PAIRS], b_[a : a + _PAIRS], min_[a : a + _PAIRS]
        lanes = full >> (64 - length_[bi]).astype(np.uint64)
        skip = np.clip(least + 1 - first_[bi], 0, 63).astype(np.uint64)
        lanes = np.where(least < 0, lanes, lanes & (full << skip))
        which, left = near_lanes(fps[qi], planes_[bi], lanes, radius)
        if len(which):
            hit, lane = np.nonzero(np.unpackbits(left.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            _join_labels(label, qi[which[hit]], first_[bi[which[hit]]] + lane)
    moved = np.flatnonzero(label != np.arange(n))
    return np.stack([fps[moved], fps[label[moved]]], axis=1)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) that connect just what fingerprints within the radius connect; fps: distinct fp."""
    keyed = fps.select("fp", F.explode(_key_columns(blocks, radius)).alias("key")).select("fp", "key.k", "key.bits")
    sizes = keyed.groupBy("k", "bits").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    dealt = keyed.join(sizes, ["k", "bits"]).select("fp", "k", "bits", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts.cast("bigint")).cast("int").alias("p"))
    cells = dealt.select("fp", "k", "bits", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    i, j = F.least("p", "other"), F.greatest("p", "other")
    cells = cells.select(F.xxhash64("k", "bits", i, j).alias("cell"), (F.col("p") != i).cast("int").alias("side"), "k", "bits", i.alias("i"), j.alias("j"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def forest(whole: bool) -> tuple[np.ndarray, list[np.ndarray] | None]:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            change = np.zeros(len(cols[0]), bool)
            for c in (0, 1, 2, 3, 4):
                change[1:] |= cols[c][1:] != cols[c][:-1]
            cell = np.cumsum(change)
            cut = len(cell) if whole else int(np.searchsorted(cell, cell[-1]))
            found = cell_forest(cell[:cut], cols[5][:cut], cols[6][:cut].view(np.uint64), radius)
            return found, [c[cut:] for c in cols] if cut < len(cell) else None

        def out(found: np.ndarray) -> pa.RecordBatch:
            edges = np.ascontiguousarray(found).view(np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, 0])), pa.array(np.ascontiguousarray(edges[:, 1]))], ["u", "v"])

        for batch in batches:
            held.append([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("cell", "k", "bits", "i", "j", "side", "fp")])
            rows += batch.num_rows
            if rows >= ROWS:
                found, rest = forest(False)
                held = [rest] if rest else []
                rows = len(rest[0]) if rest else 0
                yield out(found)
        if rows:
            yield out(forest(True)[0])

    dealt_out = cells.repartition("cell").sortWithinPartitions("cell", "k", "bits", "i", "j", "side")
    return dealt_out.mapInArrow(run, "u long, v long").distinct()


def simhash_dedup(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Every row of ``docs`` as (doc_id, fp, component_id)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(fingerprints(docs), "fingerprints")
    known = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = scratch.write(links(known.select("fp"), radius, blocks, chunk), "links")
    classes = connected_components(found, scratch, "components")
    scratch.drop("links")
    named = known.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(names, "component").select("fp", "component_id")
    return rows.join(by_print, "fp").select("doc_id", "fp", "component_id")
