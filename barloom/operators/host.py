"""Host probes and the advice drawn from them; driver utilities, off the analytics path."""

from __future__ import annotations

import json
import os
import platform
import shutil
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def human_bytes(n: float | None) -> str:
    if n is None:
        return "n/a"
    power, units = 0, ("B", "KB", "MB", "GB", "TB", "PB")
    while abs(n) >= 1024 ** (power + 1) and power + 1 < len(units):
        power += 1
    return f"{n / 1024**power:.2f} {units[power]}" if power else f"{int(n)} B"


def clamp(x: int, lo: int, hi: int) -> int:
    return max(lo, min(hi, int(x)))


def cpu_work(iters: int) -> int:
    """A linear congruential chain."""
    x = 1
    for _ in range(iters):
        x = (1664525 * x + 1013904223) & 0xFFFFFFFF
    return x


def single_core(iters: int = 200_000, trials: int = 3) -> dict:
    times = []
    for _ in range(trials):
        t = time.perf_counter()
        cpu_work(iters)
        times.append(time.perf_counter() - t)
    s = sorted(times)[len(times) // 2]
    return {"iters": iters, "seconds_median": s, "iters_per_second": iters / s}


def scaling(spark: SparkSession, workers: tuple[int, ...] = (1, 2, 4), iters: int = 200_000) -> DataFrame:
    """(workers, seconds, rate): one task for each worker, all at once."""
    rows = []
    for w in workers:
        def work(batches, iters=iters):
            for b in batches:
                cpu_work(iters)
                yield b

        t = time.perf_counter()
        spark.range(0, w, 1, w).mapInPandas(work, "id long").count()
        s = time.perf_counter() - t
        rows.append((w, s, w * iters / s))
    return spark.createDataFrame(rows, "workers int, seconds double, rate double")


def near_peak(measured: DataFrame, share: float = 0.97) -> DataFrame:
    """The fewest workers within ``share`` of the best rate."""
    best = measured.agg(F.max("rate").alias("peak"))
    return measured.join(F.broadcast(best), F.col("rate") >= share * F.col("peak")).agg(F.min("workers").cast("int").alias("workers"))


def disk(path: str | None = None, mib: int = 32) -> dict:
    block = os.urandom(1 << 20)
    with tempfile.NamedTemporaryFile(dir=path) as f:
        t = time.perf_counter()
        for _ in range(mib):
            f.write(block)
        f.flush()
        os.fsync(f.fileno())
        w = time.perf_counter() - t
        f.seek(0)
        t = time.perf_counter()
        while f.read(1 << 20):
            pass
        r = time.perf_counter() - t
    return {"write_mb_s": mib * 1.048576 / w, "read_mb_s": mib * 1.048576 / r}


def vector(n: int = 1_000_000, reps: int = 4) -> dict:
    import numpy as np

    a, b = np.ones(n), np.ones(n)
    t = time.perf_counter()
    for _ in range(reps):
        a = a * 1.000001 + b
    s = time.perf_counter() - t
    return {"seconds": s, "gb_s": n * 8 * 3 * reps / s / 1e9}


def memory_bytes() -> int:
    try:
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError):
        return 0


def recommended_ram_gb(total_gb: float | None) -> dict:
    """A reserve of 3 GB (4 from 16 GB on); the budget is 70 % less a quarter of it, 1 GB at least, and leaves the reserve."""
    if not total_gb or total_gb <= 0:
        return {"reserve_gb": None, "budget_gb": None}
    reserve = 3.0 if total_gb < 16 else 4.0
    share = max(1.0, 0.70 * total_gb - reserve / 4)
    return {"reserve_gb": reserve, "budget_gb": round(max(1.0, min(share, total_gb - reserve)), 2)}


def recommended_io_workers(read_mb_s: float | None) -> int:
    """2, or more for disks that read 800 or 1500 MB/s; 2 where nothing was measured."""
    return 2 if read_mb_s is None else 2 + 2 * sum(read_mb_s >= tier for tier in (800, 1500))


def capabilities(path: str = "capabilities_latest.json") -> dict:
    """A written report, or {} where there is none that can be read."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def workers_of(report_: dict) -> int | None:
    """The report's recommended number of CPU workers, if it names one of at least 1."""
    advice = report_.get("recommendations")
    advice = advice if isinstance(advice, dict) else {}
    try:
        n = int(advice.get("recommended_cpu_workers", advice.get("cpu_workers")))
    except (TypeError, ValueError):
        return None
    return n if n >= 1 else None


def resources(workers: int = -1, batch: int = -1, inflight: int = -1, report_: dict | None = None) -> dict:
    """Workers, batch and in-flight, unless given: all cores but one from 4 on, 12 for each worker (32 to 4096),
    and 2 for each (4 and a worker each at least)."""
    logical, physical = os.cpu_count() or 4, 0
    for name in ("cpu_physical_cores", "physical_cores", "cores_physical", "cpu_cores_physical"):
        value = (report_ or {}).get(name)
        physical = max(physical, int(value) if isinstance(value, (int, float)) else 0)
    cores = min(logical, physical) if physical > 0 else logical
    w = workers if workers > 0 else max(1, cores - (cores >= 4))
    return {
        "workers": w,
        "batch": batch if batch > 0 else clamp(12 * w, 32, 4096),
        "inflight": inflight if inflight > 0 else clamp(2 * w, max(4, w), max(16, 8 * w)),
    }


def report(spark: SparkSession | None = None, quick: bool = True) -> dict:
    total = memory_bytes() / 2**30
    out = {
        "system": {"os": platform.system(), "python": platform.python_version(), "machine": platform.machine()},
        "cpu": {"logical_cores": os.cpu_count()},
        "memory": {"total_gb": round(total, 2)},
        "disk": {"free": shutil.disk_usage(".").free},
        "benchmarks": {"cpu_single": single_core(50_000 if quick else 500_000), "disk": disk(mib=8 if quick else 256), "numpy": vector()},
        "recommendations": recommended_ram_gb(total),
    }
    if spark is not None:
        measured = scaling(spark, (1, 2) if quick else (1, 2, 4, 8), 50_000)
        out["benchmarks"]["cpu_multi"] = [r.asDict() for r in measured.collect()]
        out["recommendations"]["cpu_workers"] = near_peak(measured).first().workers
    out["recommendations"]["io_workers"] = recommended_io_workers(out["benchmarks"]["disk"]["read_mb_s"])
    return out


def write_report(path: str, content: dict) -> None:
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(content, f, indent=2, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)
