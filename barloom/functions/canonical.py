"""Canonical JSON and its hash.

Spark's to_json orders keys and writes floats otherwise, so the text is made in Python: on the
driver, or by an Arrow-batched function for a column.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_json(obj) -> str:
    return json.dumps(obj, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def stable_hash(obj) -> str:
    return hashlib.sha256(stable_json(obj).encode()).hexdigest()


def genome_hash(genome: dict) -> str:
    """Identity of a strategy; the order of its parts matters."""
    return stable_hash({"genome_v": 1, "genome": genome})


def _canonical(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else stable_json({"genome_v": 1, "genome": json.loads(x)}))


def genome_hash_column(genome: Column) -> Column:
    return F.sha2(F.pandas_udf(_canonical, "string")(F.to_json(genome)), 256)
