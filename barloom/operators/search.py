"""The search: synchronous, seeded generations, each evaluated by one plan.

The driver keeps only counters.  The elite (bounded by ``elite_size``) and the seen fingerprints
(bounded by ``seen_max``) are tables that every generation writes anew, which cuts their lineage.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.config import ResearchConfig
from barloom.functions.canonical import genome_hash_column, stable_json
from barloom.operators import gates, genomes as G, store
from barloom.operators.signal import GENOME

ELITE = f"fp long, score double, arrival long, genome {GENOME}"
#: Genomes of an elite below this size are drawn at random only.
LEAST_ELITE = 8
#: Shares of mutated, crossed and random genomes of an evolved generation.
MIXTURE = (0.35, 0.50, 0.15)


@dataclass
class Progress:
    tested: int = 0
    accepted: int = 0
    generations: int = 0
    best_score: float = -1e9
    seconds: float = 0.0
    rejects: dict[str, int] = field(default_factory=dict)

    @property
    def tested_per_second(self) -> float:
        return self.tested / self.seconds if self.seconds else 0.0

    def top_rejects(self, k: int = 8) -> list[tuple[str, int]]:
        return sorted(self.rejects.items(), key=lambda x: (-x[1], x[0]))[:k]


def bounded_elite(rows: DataFrame, size: int) -> DataFrame:
    """The best of each fingerprint, then the best of all; ties to the earlier arrival."""
    one = rows.groupBy("fp").agg(F.max_by(F.struct("score", "arrival", "genome"), F.struct("score", -F.col("arrival"))).alias("x")).select("fp", "x.*")
    return one.orderBy(F.desc("score"), "arrival", "fp").limit(size).select("fp", "score", "arrival", "genome")


def drawn(elite: DataFrame, n: int, seed: int, what: str) -> DataFrame:
    """(i, genome) of n draws, the best of k ranks k times as likely as the last."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "arrival", "fp"))
    k = F.count("*").over(Window.partitionBy())
    weighted = elite.select("genome", (k - rank + 1).alias("w"), rank.alias("rank"))
    upto = F.sum("w").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("w").over(Window.partitionBy())
    ranges = weighted.select("genome", ((upto - F.col("w")) / total).alias("lo"), (upto / total).alias("hi"))
    draws = elite.sparkSession.range(n).select(F.col("id").alias("i"), G.uniform(seed, what, F.col("id")).alias("u"))
    return draws.join(F.broadcast(ranges), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("i", "genome")


def generation(spark: SparkSession, cfg: ResearchConfig, number: int, elite: DataFrame, seen: DataFrame, first_id: int, seeds: DataFrame | None = None) -> DataFrame:
    """(genome_id, genome, fp) of up to ``generation_size`` genomes never seen; ``seeds`` (place, genome) come first, by place."""
    n, seed = cfg.generation_size, cfg.seed * 1_000_003 + number
    fresh = G.random_genomes(spark, n * 2, seed, cfg.space, 2 * n)
    rows = fresh
    if cfg.search_mode == "evo" and elite.count() >= LEAST_ELITE:
        n_mut, n_cross = int(n * MIXTURE[0]), int(n * MIXTURE[1])
        mutated = G.mutate(drawn(elite, n_mut, seed + 1, "m").select(F.col("i").alias("genome_id"), "genome"), seed + 2, cfg.space)
        a = drawn(elite, n_cross, seed + 3, "a").withColumnRenamed("genome", "a")
        b = drawn(elite, n_cross, seed + 4, "b").withColumnRenamed("genome", "b")
        crossed = G.crossover(a.join(b, "i").select((F.col("i") + n).alias("genome_id"), "a", "b"), seed + 5, cfg.space)
        rows = mutated.unionByName(crossed).unionByName(fresh)
    if seeds is not None:  # before all others
        rows = seeds.select((F.col("place") - F.lit(1 << 40)).alias("genome_id"), "genome").unionByName(rows)
    new = G.unseen(rows, seen).orderBy("genome_id").limit(n)
    renumbered = F.row_number().over(Window.orderBy("genome_id")) - 1 + first_id
    return new.select(renumbered.cast("bigint").alias("genome_id"), "genome", "fp")


def strategy_rows(evaluated: DataFrame, cfg: ResearchConfig, run_id: str, now: str) -> DataFrame:
    """Accepted genomes as rows of the store."""
    cv = [c for c in evaluated.columns if c.startswith("cv_") and c != "cv_error"]
    reg = [c for c in evaluated.columns if c.startswith("regime_")]
    part = lambda names, prefix: F.struct(*[F.col(c).alias(c.removeprefix(prefix)) for c in names])
    side = lambda p: F.struct(*[F.col(f"{p}_{x}").alias(x) for x in ("sharpe", "total_return", "cagr", "calmar", "max_drawdown", "trades", "turnover_mean", "exposure", "active_bars")])
    doc = [side("train").alias("train"), side("holdout").alias("holdout"), side("stress").alias("holdout_stress")]
    doc += [part(cv, "cv_").alias("cv")] * bool(cv) + [part(reg, "regime_").alias("regime")] * bool(reg)
    both = {"sharpe": "sharpe", "calmar": "calmar", "mdd": "max_drawdown", "trades": "trades", "exposure": "exposure", "turnover": "turnover_mean"}
    columns = {f"{k}_{s}": F.col(f"{s}_{v}") for k, v in both.items() for s in ("train", "holdout")}
    return evaluated.where(F.col("reject_reason").isNull()).select(
        genome_hash_column(F.col("genome")).alias("strategy_hash"), F.lit(cfg.dataset_id).alias("dataset_id"), F.lit(cfg.evaluation.eval_id).alias("eval_id"), F.lit(now).alias("created_utc"), F.lit(run_id).alias("run_id"),
        F.to_json("genome").alias("genome_json"), F.to_json(F.struct(*doc)).alias("metrics_json"), "pass_flags", "score", *[c.alias(k) for k, c in columns.items()], F.col("genome_id").alias("seq"),
    )


def warm_elite(spark: SparkSession, strategies: DataFrame, cfg: ResearchConfig) -> DataFrame:
    """The best stored genomes of the latest evaluation, with their scores."""
    best = store.top(strategies, cfg.dataset_id, cfg.elite_load)
    rows = best.select(F.from_json("genome_json", GENOME).alias("genome"), "score", F.col("rank").cast("bigint").alias("arrival"))
    return rows.select(G.fingerprint(F.col("genome")).alias("fp"), "score", "arrival", "genome")


def writer(spark: SparkSession, kind: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes tables into a new shared folder and reads them back."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + f"/{kind}-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return written


def run(spark: SparkSession, bars: DataFrame, bar_seconds: int, cfg: ResearchConfig, minutes: float | None = None, on_progress: Callable[[Progress], None] | None = None) -> Progress:
    """Generations until their number or the time is reached; accepted strategies go to the store."""
    from datetime import UTC, datetime

    written = writer(spark, "search")
    kept = store.Store(spark, cfg.store)
    run_id = uuid.uuid4().hex[:10]
    now = lambda: datetime.now(UTC).isoformat(timespec="seconds")
    kept.insert_run({"run_id": run_id, "created_utc": now(), "mode": cfg.search_mode, "dataset_id": cfg.dataset_id, "eval_id": cfg.evaluation.eval_id, "config_json": stable_json(json.loads(json.dumps(asdict(cfg))))})

    # Every feature of the search space, once; generations only add up columns.
    from barloom.operators.features import features

    feats = [(f, w) for f in cfg.space.features for w in cfg.space.windows]
    wide = written(features(bars, feats), "features")
    elite = written(bounded_elite(spark.createDataFrame([], ELITE).unionByName(warm_elite(spark, kept.read("strategies"), cfg)), cfg.elite_size), "elite-0")
    seeds = elite.select(F.col("arrival").alias("place"), "genome")  # stored strategies are evaluated anew, as the configuration may differ
    seen = written(spark.createDataFrame([], "fp long, arrival long"), "seen-0")
    p, began, first_id = Progress(), time.time(), 0
    for k in range(1, cfg.generations + 1):
        if minutes is not None and time.time() - began > minutes * 60:
            break
        batch = written(generation(spark, cfg, k, elite, seen, first_id, seeds), f"batch-{k}")
        result = gates.evaluate(wide, batch, feats, cfg.evaluation, bar_seconds, lambda df, name, k=k: written(df, f"{name}-{k}"))
        result = written(result.join(batch, "genome_id"), f"result-{k}")
        accepted = result.where(F.col("reject_reason").isNull()).select("fp", "score", F.col("genome_id").alias("arrival"), "genome")
        near = gates.elite_updates(result).select("fp", F.col("soft_score").alias("score"), F.col("genome_id").alias("arrival"), "genome")
        elite = written(bounded_elite(elite.unionByName(accepted).unionByName(near), cfg.elite_size), f"elite-{k}")
        new_seen = seen.unionByName(batch.select("fp", F.col("genome_id").alias("arrival")))
        seen = written(new_seen.orderBy(F.desc("arrival")).limit(max(10_000, cfg.seen_max)), f"seen-{k}")
        n = batch.count()
        first_id += n
        for r in gates.reject_counts(result).collect():
            p.rejects[r.reject_reason] = p.rejects.get(r.reject_reason, 0) + r.n
        top = accepted.agg(F.count("*").alias("n"), F.max("score").alias("best")).first()
        if top.n:
            kept.upsert(strategy_rows(result, cfg, run_id, now()))
        p.tested, p.accepted, p.generations = p.tested + n, p.accepted + top.n, k
        p.best_score = max(p.best_score, top.best if top.best is not None else -1e9)
        p.seconds = time.time() - began
        if on_progress:
            on_progress(p)
        if not n:
            break
    return p
