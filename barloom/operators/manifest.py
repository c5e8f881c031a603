"""Provenance of a run, text reports and logging; driver utilities."""

from __future__ import annotations

import dataclasses
import json
import logging
import os
import platform
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "barloom.run_manifest.v1"


def now_utc() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def plain(x):
    """JSON values only, recursively."""
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return plain(dataclasses.asdict(x))
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    return x if x is None or isinstance(x, (str, int, float, bool)) else str(x)


def _git(*args: str) -> str | None:
    try:
        return subprocess.run(["git", *args], capture_output=True, text=True, timeout=5, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def manifest(run_id: str, eval_id: str, config, spark: SparkSession | None = None) -> dict:
    out = {"schema": SCHEMA, "run_id": run_id, "eval_id": eval_id, "created_utc": now_utc(), "config": plain(config)}
    out["host"] = {"os": platform.platform(), "python": platform.python_version(), "cpus": os.cpu_count()}
    out["git"] = {"commit": _git("rev-parse", "--short", "HEAD"), "dirty": bool(_git("status", "--porcelain"))}
    if spark is not None:
        out["spark"] = {"version": spark.version, "master": spark.sparkContext.master, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}
    return out


def write_text(path: str | Path, text: str) -> None:
    """Whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(path.name + ".tmp")
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def write_json(path: str | Path, content) -> None:
    write_text(path, json.dumps(plain(content), indent=2, sort_keys=True, ensure_ascii=False))


def write_manifest(path: str | Path, content: dict, stamped: bool = True) -> list[Path]:
    """The file, and beside it one with the time in its name."""
    path = Path(path)
    out = [path]
    if stamped:
        out.append(path.with_name(f"{path.stem}_{datetime.now():%Y%m%d_%H%M%S}{path.suffix}"))
    for p in out:
        write_json(p, content)
    return out


def logger(name: str, path: str | Path | None = None) -> logging.Logger:
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
        if path:
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            log.addHandler(logging.FileHandler(path, encoding="utf-8"))
    return log


def format_rows(df: DataFrame, columns: list[str], limit: int = 20) -> str:
    """A fixed-width table of the first rows."""
    rows = [columns] + [["n/a" if r[c] is None else f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in df.select(*columns).limit(limit).collect()]
    width = [max(len(r[i]) for r in rows) for i in range(len(columns))]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, width, strict=True)) for r in rows)
