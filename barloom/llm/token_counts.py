"""Token counts by a map-side two-tier lookup of pre-token lengths.

Tier one is a broadcast table of the lengths of the corpus's frequent pre-tokens; tier two is a
bounded cache in each Python worker, filled by encoding the pre-tokens that the table lacks.  No
pre-token is shuffled: the table comes from summaries of bounded size, one row a task, merged some at
a time.  The table only saves work; every count is what the tokenizer itself returns for the whole text.

Null and empty texts have 0 bytes and 0 tokens; bytes that are no UTF-8 are counted as they are and
tokenised as replacement characters.  A text of any length is held by its task whole.  Rows are
independent: ties, repeated rows, null ids and further columns change nothing, and an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import Scratch, binary_text, slices

#: Size of the broadcast table, its longest key and each task's summary.
TABLE_SIZE, KEY_CHARS, SUMMARY_SIZE = 32_768, 48, 32_768
#: Summaries that are merged at a time.
MERGED = 16
#: Entries of a worker's cache; it is emptied when full.
CACHE_SIZE = 400_000

# Of this alphabet every character's class, lower case and normal form are the same in all Unicode
# versions; a text with any other character, or with the opening of a special token, is encoded whole.
_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-įı-ſ]*")
_LETTER = "a-zß-öø-ſ"
_PRETOKEN = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[0-9]|[^\\t-\\r {_LETTER}0-9]+")


def pretokens(text: str) -> list[str] | None:
    """Pre-tokens of a plain text, or None where only the tokenizer may split it."""
    if "<|" in text or _PLAIN.fullmatch(text) is None:
        return None
    return _PRETOKEN.findall(text.lower())


class _Lengths(dict):
    """Pre-token -> number of tokens: the broadcast table, then the bounded cache."""

    def __init__(self, path: str, frequent: dict[str, int]):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self.frequent = frequent
        self.tokenizer = Tokenizer.from_file(path)

    def learn(self, tokens) -> None:
        new = [t for t in tokens if t not in self]
        if not new:
            return
        if len(self) - len(self.frequent) + len(new) > CACHE_SIZE:
            self.clear()
            self.update(self.frequent)
            new = [t for t in tokens if t not in self]
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            for t, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self[t] = len(e)

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))


def _texts(batch: pa.RecordBatch) -> list[tuple[str, int]]:
    """The texts, bytes that are no UTF-8 replaced, with their sizes in bytes."""
    return [(t.decode("utf-8", "replace"), len(t)) for t in binary_text(batch)]


def _packed(kept: Counter) -> pa.RecordBatch:
    top = [(k, n) for k, n in kept.most_common(SUMMARY_SIZE) if len(k) <= KEY_CHARS]
    return pa.RecordBatch.from_arrays([pa.array([json.dumps(top).encode()], pa.binary())], ["summary"])


def frequent_pretokens(docs: DataFrame) -> list[str]:
    """The commonest pre-tokens of all texts, by Misra-Gries summaries of every task.

    A summary is one row of bounded size; rows are merged ``MERGED`` at a time, round after round, so no
    pre-token is a row of its own and no task or the driver holds more than that many summaries.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        for batch in batches:
            texts = [t for t, _ in _texts(batch)]
            for a, b in slices(texts):
                for t in texts[a:b]:
                    kept.update(pretokens(t) or ())
                if len(kept) > 4 * SUMMARY_SIZE:
                    floor = sorted(kept.values(), reverse=True)[SUMMARY_SIZE]
                    kept = Counter({k: n - floor for k, n in kept.items() if n > floor})
        if kept:
            yield _packed(kept)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        for batch in batches:
            for row in batch.column(0).to_pylist():
                for k, n in json.loads(row):
                    kept[k] += n
        if kept:
            yield _packed(kept)

    scratch = Scratch(docs.sparkSession)
    found = scratch.write(docs.select("text").mapInArrow(summarise, "summary binary"), "summaries-0")
    step, n = 0, found.count()
    while n > 1:
        step, n = step + 1, -(-n // MERGED)
        found = scratch.write(found.repartition(n).mapInArrow(merge, "summary binary"), f"summaries-{step}")
        scratch.drop(f"summaries-{step - 1}")
    row = found.first()
    best = sorted(json.loads(row.summary), key=lambda x: (-x[1], x[0])) if row else []
    return [k for k, _ in best[:TABLE_SIZE]]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, frequent: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as (doc_id, n_bytes, n_tokens, over_limit); ``frequent`` replaces the scan for the table."""
    lengths = _Lengths(tokenizer_path, {})
    lengths.learn(frequent_pretokens(docs) if frequent is None else frequent)
    table = docs.sparkSession.sparkContext.broadcast(dict(lengths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Lengths(tokenizer_path, table.value)
        size = known.__getitem__
        for batch in batches:
            whole = _texts(batch)
            texts = [t for t, _ in whole]
            n_bytes, n_tokens = [n for _, n in whole], []
            for a, b in slices(texts):
                split = [pretokens(t) for t in texts[a:b]]
                known.learn(set().union(*(s for s in split if s)))
                for t, s in zip(texts[a:b], split, strict=True):
                    n_tokens.append(known.whole(t) if s is None else sum(map(size, s)))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
