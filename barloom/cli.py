"""Command line: ``python -m barloom.cli mine|audit|top|benchmark``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from barloom.config import Costs, EvalConfig, ResearchConfig
from barloom.operators import audit as audits, host, manifest, search, store
from barloom.sources import bars as B


def _session() -> SparkSession:
    return SparkSession.builder.appName("barloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="barloom")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("mine")
    source = m.add_mutually_exclusive_group()
    source.add_argument("--demo", action="store_true")
    source.add_argument("--csv")
    m.add_argument("--demo-bars", type=int, default=120_000)
    m.add_argument("--demo-bar-seconds", type=int, default=900)
    m.add_argument("--seed", type=int, default=1234)
    m.add_argument("--bar-seconds", type=int, help="spacing of a CSV file's bars; inferred where absent")
    m.add_argument("--force-rebuild-cache", action="store_true")
    m.add_argument("--minutes", type=float, default=1.0)
    m.add_argument("--generations", type=int, default=1000)
    m.add_argument("--batch", type=int, default=-1)
    m.add_argument("--store", default="strategy_store")
    m.add_argument("--cache", default="bar_cache")
    m.add_argument("--run-manifest", default="run_manifest.json")
    m.add_argument("--log-file")
    m.add_argument("--search-mode", choices=["evo", "random"], default="evo")
    for name, kind, default in (("elite-size", int, 512), ("elite-load", int, 128), ("seen-max", int, 200_000)):
        m.add_argument(f"--{name}", type=kind, default=default)
    for flag, (field, kind) in _EVAL.items():
        m.add_argument(f"--{flag}", type=kind, default=getattr(EvalConfig(), field))
    m.add_argument("--no-deep", action="store_true")
    m.add_argument("--no-regime", action="store_true")
    t = sub.add_parser("top")
    a = sub.add_parser("audit")
    for q in (t, a):
        q.add_argument("--store", default="strategy_store")
        q.add_argument("--dataset-id", required=True)
        q.add_argument("--eval-id")
    t.add_argument("--limit", type=int, default=20)
    a.add_argument("--cache", default="bar_cache")
    a.add_argument("--hash")
    a.add_argument("--rank", type=int, default=1)
    a.add_argument("--bar-seconds", type=int)
    for flag, (_, kind, default) in _AUDIT.items():
        a.add_argument(f"--{flag}", type=kind, default=default)
    a.add_argument("--cost-bps", type=float, default=1.0)
    a.add_argument("--slippage-bps", type=float, default=0.5)
    a.add_argument("--cost-mults", default="1,2,3,5")
    a.add_argument("--delays", default="0,1")
    b = sub.add_parser("benchmark")
    b.add_argument("--full", action="store_true")
    b.add_argument("--out", default="capabilities_latest.json")
    return p


#: Options of an audit, their fields and defaults (fixed values).
_AUDIT = {
    "holdout-frac": ("holdout_frac", float, 0.20), "mdd-floor": ("mdd_floor", float, 0.02), "calmar-cap": ("calmar_cap", float, 25.0),
    "cv-folds": ("cv_folds", int, 5), "cv-delay": ("cv_delay_bars", int, 1), "cv-min-fold-bars": ("cv_min_fold_bars", int, 800), "cv-cost-mult": ("stress_cost_mult", float, 3.0),
    "regime-vol-window": ("regime_vol_window", int, 160), "regime-trend-window": ("regime_trend_window", int, 160), "regime-min-bars": ("regime_min_bars", int, 600), "regime-min-exp": ("regime_min_exposure", float, 0.03),
}
_EVAL = {
    "holdout-frac": ("holdout_frac", float), "min-exposure-train": ("min_exposure_train", float), "min-exposure-holdout": ("min_exposure_holdout", float), "min-trades-train": ("min_trades_train", int),
    "min-trades-holdout": ("min_trades_holdout", int), "stress-cost-mult": ("stress_cost_mult", float), "min-train-sharpe": ("min_train_sharpe", float), "min-holdout-sharpe": ("min_holdout_sharpe", float),
    "min-holdout-stress-sharpe": ("min_holdout_stress_sharpe", float), "cv-folds": ("cv_folds", int), "cv-delay": ("cv_delay_bars", int), "cv-min-pos-frac": ("cv_min_positive_folds_frac", float), "cv-min-sharpe": ("cv_min_sharpe", float),
    "cv-min-med-base": ("cv_min_median_sharpe_base", float), "cv-min-med-delay": ("cv_min_median_sharpe_delay1", float), "cv-min-med-cost": ("cv_min_median_sharpe_coststress", float), "cv-min-sharpe-delay1": ("cv_min_sharpe_delay1", float),
    "cv-min-sharpe-cost": ("cv_min_sharpe_coststress", float), "cv-min-pos-cost-frac": ("cv_min_positive_folds_coststress_frac", float), "regime-vol-window": ("regime_vol_window", int), "regime-trend-window": ("regime_trend_window", int),
    "regime-min-bars": ("regime_min_bars", int), "regime-min-exp": ("regime_min_exposure", float),
}


def _mine(args, spark: SparkSession) -> int:
    log = manifest.logger("barloom", args.log_file)
    if args.csv:
        dataset_id, bars = B.prepare_csv(spark, args.csv, args.cache, args.force_rebuild_cache)
        seconds = args.bar_seconds or B.bar_seconds(bars).first().bar_seconds
    else:
        dataset_id, bars = B.prepare_demo(spark, args.cache, args.demo_bars, args.demo_bar_seconds, args.seed, args.force_rebuild_cache)
        seconds = args.demo_bar_seconds
    evaluation = EvalConfig(**{field: getattr(args, flag.replace("-", "_")) for flag, (field, _) in _EVAL.items()}, deep_validation=not args.no_deep, regime_enabled=not args.no_regime)
    size = args.batch if args.batch > 0 else host.resources(report_=host.capabilities())["batch"]
    cfg = ResearchConfig(dataset_id, args.store, args.seed, args.generations, size, args.search_mode, args.elite_size, args.elite_load, args.seen_max, evaluation=evaluation)
    manifest.write_manifest(args.run_manifest, manifest.manifest("", evaluation.eval_id, cfg, spark))
    done = search.run(spark, bars, seconds, cfg, args.minutes, lambda p: log.info("tested %d accepted %d (%.2f/s) best %.4f rejects %s", p.tested, p.accepted, p.tested_per_second, p.best_score, p.top_rejects()))
    print(f"dataset {dataset_id} evaluation {evaluation.eval_id} tested {done.tested} accepted {done.accepted}")
    return 0


_TOP = ["rank", "strategy_hash", "score", "sharpe_train", "sharpe_holdout", "mdd_holdout", "trades_holdout", "cv_med", "cv_min", "reg_cov"]


def _top(args, spark: SparkSession) -> int:
    rows = store.top(store.Store(spark, args.store).read("strategies"), args.dataset_id, args.limit, args.eval_id)
    print(manifest.format_rows(rows, _TOP, args.limit))
    return 0


def _audit(args, spark: SparkSession) -> int:
    kept = store.Store(spark, args.store).read("strategies")
    best = store.top(kept, args.dataset_id, max(1, args.rank), args.eval_id)
    if args.hash:
        evaluation = args.eval_id
        if evaluation is None:
            newest = store.latest_eval(kept, args.dataset_id).first()
            evaluation = newest.eval_id if newest else None
        row = kept.where((F.col("dataset_id") == args.dataset_id) & (F.col("eval_id") == F.lit(evaluation)) & (F.col("strategy_hash") == args.hash)).first()
    else:
        row = best.where(F.col("rank") == args.rank).first()
    if row is None:
        print("no such strategy", file=sys.stderr)
        return 2
    bars = spark.read.parquet(f"{args.cache}/{args.dataset_id}")
    cfg = EvalConfig(costs=Costs(args.cost_bps, args.slippage_bps), **{field: getattr(args, flag.replace("-", "_")) for flag, (field, _, _) in _AUDIT.items()})
    seconds = args.bar_seconds or B.bar_seconds(bars).first().bar_seconds
    numbers = lambda text, kind: tuple(kind(x) for x in text.split(",") if x.strip())
    for name, df in audits.audit(bars, json.loads(row.genome_json), cfg, seconds, numbers(args.cost_mults, float), numbers(args.delays, int)).items():
        print(f"\n{name}\n" + manifest.format_rows(df, [c for c in df.columns if c not in ("series_id", "genome_id") and not c.startswith("fold_")], 100))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = _session()
    if args.command == "benchmark":
        host.write_report(args.out, host.report(spark, not args.full))
        return 0
    return {"mine": _mine, "top": _top, "audit": _audit}[args.command](args, spark)



if __name__ == "__main__":
    sys.exit(main())
