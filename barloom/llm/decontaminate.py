"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of an item; a shorter item, if it has words, is one window.
Of each window the least hash of its ``GRAM``-word grams is its fingerprint.  A document's windows
are fingerprinted the same way, so a span of WINDOW shared words always shares one.  Around every
document gram that is an item fingerprint, the windows it stands for are compared with the item's
windows, by hash and then word by word; the union of the windows that occur are the hits.

Items are taken in blocks of at most ``BLOCK_WORDS`` words; each block is broadcast and applied in a
pass of its own, written before the next block's, so that one broadcast of bounded size lives at a time
and no text is shuffled.

Null and empty texts have no words, hence no hits and no windows.  Items with the same id count
once; the windows of an item without an id make hits but name no item.  Document rows are
independent: repeated rows, ties and null ids change nothing; columns of documents are kept, those
named like a result give way.  Texts may have any length, each in the memory of its task.  Empty tables
give empty results or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from barloom.llm.common import Scratch, binary_text, slices

WINDOW, GRAM = 10, 5
#: Words of the items in one broadcast.
BLOCK_WORDS = 200_000

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0xC4CEB9FE1A85EC53)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    for i, base in enumerate((_BASE, _INVERSE)):
        while len(_powers[i]) < n:
            factor = np.uint64(pow(base, len(_powers[i]), 1 << 64))
            _powers[i] = np.concatenate([_powers[i], _powers[i] * factor])
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def plain(text: bytes) -> bytes:
    return text.translate(_TO_WORDS)


def word_hashes(text: bytes, piece: int = 1 << 20) -> np.ndarray:
    """A hash of every word of a plain text, left to right, worked out in pieces of bounded size."""
    out, a = [], 0
    while a < len(text):
        b = len(text) if a + piece >= len(text) else text.find(b" ", a + piece)
        b = len(text) if b < 0 else b
        part = np.frombuffer(text, np.uint8, b - a, a)
        edge = np.flatnonzero(np.diff((part != 32).view(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        power, inverse = _power_tables(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
        out.append(_mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)))
        a = b
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Of every n consecutive words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for j in range(1, n):
        out = out * _STEP + h[j : j + m]
    return _mix(out)


def window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    m = len(grams) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = grams[:m].copy()
    for j in range(1, width):
        np.minimum(out, grams[j : j + m], out=out)
    return out


def _among(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted ``of``."""
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


class Block:
    """The windows of some items: fingerprints, window hashes by length, and the windows themselves."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.items: dict[bytes, list[str]] = {}
        prints, by_length = [], {}
        for item, text in items:
            words = plain(text).split()
            n = min(window, len(words))
            if not n:
                continue
            h = word_hashes(plain(text))
            by_length.setdefault(n, []).append(gram_hashes(h, n))
            if n == window:
                prints.append(window_minima(gram_hashes(h, gram), window - gram + 1))
            for i in range(len(words) - n + 1):
                own = self.items.setdefault(b" ".join(words[i : i + n]), [])
                if item is not None and item not in own:
                    own.append(item)
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.hashes = {n: np.unique(np.concatenate(x)) for n, x in by_length.items()}

    def candidates(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """Word positions at which a window of each length may start."""
        found = {}
        for n, known in self.hashes.items():
            if n == self.window:
                minima = window_minima(gram_hashes(h, self.gram), n - self.gram + 1)
                if not len(minima):
                    continue
                # A gram stays the least of several windows in a row: one lookup for the row.
                new = np.r_[True, minima[1:] != minima[:-1]]
                seed = _among(minima[new], self.prints)
                if not seed.any():
                    continue
                at = np.flatnonzero(seed[np.cumsum(new) - 1])
                grams = h[at].copy()
                for j in range(1, n):
                    grams = grams * _STEP + h[at + j]
                at = at[_among(_mix(grams), known)]
            else:
                at = np.flatnonzero(_among(gram_hashes(h, n), known))
            if len(at):
                found[n] = at
        return found

    def hits(self, text: bytes, h: np.ndarray, candidates: dict[int, np.ndarray]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans of the windows that occur, and their items, checked word by word."""
        words = text.split()
        spans, items = [], set()
        for n, at in candidates.items():
            for i in at.tolist():
                own = self.items.get(b" ".join(words[i : i + n]))
                if own is not None:
                    spans.append((i, i + n))
                    items.update(own)
        return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[str | None, bytes]]]:
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).distinct().toLocalIterator():
        n = len(plain(bytes(row.text)).split())
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row.item, bytes(row.text)))
        size += n
    yield block


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, hits (merged word spans) and items (ids of items with a window there)."""
    sc = docs.sparkSession.sparkContext
    base = docs.drop("n_words", "hits", "items")
    fields = base.schema.fields
    span = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    schema = StructType([*fields, StructField("n_words", LongType()), StructField("hits", span), StructField("items", ArrayType(StringType()))])
    out, scratch, held = base, Scratch(docs.sparkSession), None
    for k, block in enumerate(_blocks(items, block_words)):
        if held is not None:  # one block's broadcast lives at a time, whatever the items' number
            out = scratch.write(out, f"block-{k}")
            scratch.drop(f"block-{k - 1}")
            held.unpersist()
        held = shared = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, later=k > 0) -> Iterator[pa.RecordBatch]:
            known = Block(shared.value, window, gram)
            for batch in batches:
                old_hits = batch.column(batch.schema.get_field_index("hits")).to_pylist() if later else None
                old_items = batch.column(batch.schema.get_field_index("items")).to_pylist() if later else None
                texts = binary_text(batch)
                n_words, hits, found = [], [], []
                for a, b in slices(texts):
                    ready = [plain(t) for t in texts[a:b]]
                    joined = word_hashes(b" ".join(ready))
                    counts = [len(t.split()) for t in ready]
                    ends = np.cumsum(counts)
                    near = known.candidates(joined)
                    for d, (t, n, end) in enumerate(zip(ready, counts, ends.tolist(), strict=True)):
                        own = {}
                        for size, at in near.items():
                            lo, hi = np.searchsorted(at, [end - n, end - size + 1]) if n >= size else (0, 0)
                            if hi > lo:
                                own[size] = at[lo:hi] - (end - n)
                        spans, ids = known.hits(t, joined, own) if own else ([], set())
                        if later:
                            spans += [(x["start"], x["end"]) for x in old_hits[a + d]]
                            ids |= set(old_items[a + d])
                        n_words.append(n)
                        hits.append([{"start": x, "end": y} for x, y in _merged(spans)])
                        found.append(sorted(ids))
                columns = [batch.column(i) for i, f in enumerate(batch.schema) if f.name not in ("n_words", "hits", "items")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(hits, _SPAN), pa.array(found, pa.list_(pa.string()))], names=schema.names)

        out = out.mapInArrow(run, schema)
    return out
