"""Hand-made series and an independent numpy reading of the definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.config import Costs, EvalConfig
from barloom.functions.canonical import genome_hash, stable_json
from barloom.functions.scalar import split_index, to_double, to_long
from barloom.operators import backtest, gates, genomes as G, regime, signal, store, validate
from barloom.operators.features import features
from barloom.sources import bars as B


def series(spark, close, volume=None):
    rows = [("s", t, float(c), float(v)) for t, (c, v) in enumerate(zip(close, volume if volume is not None else [1.0] * len(close), strict=True))]
    df = spark.createDataFrame(rows, "series_id string, t long, close double, volume double")
    return df.withColumns({"close": F.col("close").cast("float"), "volume": F.col("volume").cast("float")})


def column(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


def walk(n, seed=3):
    return np.float32(1000 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.01, n))))


def test_features_match_numpy_across_blocks(spark):
    c = walk(400).astype(np.float64)
    v = np.random.default_rng(5).integers(1, 100, 400).astype(np.float64)
    got = features(series(spark, c, v), [("mr_z", 20), ("mom_ir", 20), ("volu_z", 20), ("vol_s", 20)], block=64)
    rows = got.orderBy("t").collect()
    r = np.r_[np.nan, c[1:] / c[:-1] - 1]
    vol = np.array([np.std(r[t - 19 : t + 1]) if t >= 20 else np.nan for t in range(400)])
    median = np.nanmedian(vol)
    for t in range(400):
        if t < 19:
            assert rows[t].mr_z_20 is None and rows[t].volu_z_20 is None
        else:
            w = c[t - 19 : t + 1]
            assert rows[t].mr_z_20 == pytest.approx(np.clip(-(c[t] - w.mean()) / (w.std() + 1e-12), -6, 6), abs=1e-4)
            w = v[t - 19 : t + 1]
            assert rows[t].volu_z_20 == pytest.approx(np.clip((v[t] - w.mean()) / (w.std() + 1e-12), -6, 6), abs=1e-4)
        if t < 20:
            assert rows[t].mom_ir_20 is None and rows[t].vol_s_20 is None
        else:
            w = r[t - 19 : t + 1]
            assert rows[t].mom_ir_20 == pytest.approx(np.clip(w.mean() / (w.std() + 1e-12), -6, 6), abs=1e-4)
            assert rows[t].vol_s_20 == pytest.approx(np.clip(vol[t] / median - 1, -8, 8), abs=1e-4)


def test_momentum_of_constant_and_nearly_constant_windows(spark):
    """Each price stands six times, so most windows of returns are 0 throughout; one price moves by very little."""
    c = np.repeat(1000 + np.random.default_rng(11).integers(0, 500_000, 500) / 10_000, 6)
    c[1500:1506] = c[1499] + 0.001
    c = np.float32(c)
    got = np.array(column(features(series(spark, c), [("mom_ir", 5)]), "mom_ir_5")[5:])
    c = c.astype(np.float64)
    w = np.lib.stride_tricks.sliding_window_view(c[1:] / c[:-1] - 1, 5)
    want = np.clip(w.mean(1) / (w.std(1) + 1e-12), -6, 6)
    assert (got[want == 0] == 0).all() and (want == 0).sum() > 400
    assert np.abs(got - want).max() < 2e-7
    assert column(features(series(spark, [1, 1, 1, 2, 2, 2, 2]), [("mom_ir", 2)]), "mom_ir_2")[3:] == [1.0, 1.0, 0.0, 0.0]


def test_feature_edges(spark):
    assert column(features(series(spark, [1, 2, 3]), [("mr_z", 5)]), "mr_z_5") == [None] * 3
    assert column(features(series(spark, [1, 2, 3]), [("mr_z", 1)]), "mr_z_1") == [None] * 3
    flat = column(features(series(spark, [1000.37] * 30), [("mr_z", 5)]), "mr_z_5")
    assert all(abs(x) < 1e-6 for x in flat[4:])
    assert column(features(series(spark, [1, 0, 2, 3, 4]), [("mom_ir", 2)]), "mom_ir_2")[:4] == [None, None, None, None]
    assert features(series(spark, []), [("vol_s", 5)]).count() == 0
    with pytest.raises(ValueError):
        features(series(spark, [1.0]), [("nope", 5)])


def test_past_does_not_depend_on_the_future(spark):
    c = walk(120)
    whole = column(features(series(spark, c), [("mr_z", 10)]), "mr_z_10")
    part = column(features(series(spark, c[:80]), [("mr_z", 10)]), "mr_z_10")
    assert whole[:80] == part


def positions(spark, close, pos):
    rows = [("s", 0, t, float(c), int(p)) for t, (c, p) in enumerate(zip(close, pos, strict=True))]
    return spark.createDataFrame(rows, "series_id string, genome_id long, t long, close double, pos int").withColumn("pos", F.col("pos").cast("byte"))


def slices(spark, *rows):
    return spark.createDataFrame([("s", *r) for r in rows], "series_id string, " + backtest.SLICE)


def numpy_pnl(close, pos, rate):
    close, pos = np.asarray(close, float), np.asarray(pos, float)
    turn = np.abs(np.diff(np.r_[0, pos]))
    return pos[:-1] * (close[1:] / close[:-1] - 1) - rate * turn[:-1], turn


def test_pnl_metrics_and_meta(spark):
    close, pos = walk(60).astype(float), [0, 1, 1, -1, -1, 0] * 10
    rows = backtest.pnl(backtest.sliced(positions(spark, close, pos), slices(spark, ("all", 0, 59, 0, 1.0), ("late", 30, 59, 1, 3.0))), Costs())
    m = {r.slice_id: r for r in backtest.metrics(rows, 86400).collect()}
    meta = {r.slice_id: r for r in backtest.trade_meta(rows).collect()}
    pnl, turn = numpy_pnl(close, pos, 0.00015)
    eq = np.cumprod(1 + pnl)
    assert m["all"].bars == 59 and m["all"].mean_bar_return == pytest.approx(pnl.mean())
    assert m["all"].sharpe == pytest.approx(math.sqrt(365.25) * pnl.mean() / pnl.std(ddof=1))
    assert m["all"].max_drawdown == pytest.approx((np.r_[1, eq] / np.maximum.accumulate(np.r_[1, eq]) - 1).min())
    assert meta["all"].turnover_sum == turn.sum() and meta["all"].trades == (turn > 0).sum()
    delayed = np.r_[0, pos[30:59]]
    pnl, turn = numpy_pnl(close[30:], delayed, 0.00045)
    assert m["late"].mean_bar_return == pytest.approx(pnl.mean()) and meta["late"].turnover_sum == turn.sum()
    assert abs(m["all"].calmar) <= 25


def test_metric_edges(spark):
    flat = backtest.pnl(backtest.sliced(positions(spark, [1, 2, 3, 4, 5, 6, 7], [0] * 7), slices(spark, ("all", 0, 6, 0, 1.0))), Costs())
    m = backtest.metrics(flat, 86400).first()
    assert (m.sharpe, m.total_return, m.max_drawdown) == (0.0, 0.0, 0.0)
    assert backtest.active_metrics(flat, 86400, 50).count() == 0
    short = backtest.pnl(backtest.sliced(positions(spark, [1, 2, 3, 4, 5], [1] * 5), slices(spark, ("all", 0, 4, 0, 1.0))), Costs())
    assert backtest.metrics(short, 86400).first().error == "too_few_bars"
    ruin = backtest.pnl(backtest.sliced(positions(spark, [1, 3, 3, 3, 3, 3, 3], [-1] * 7), slices(spark, ("all", 0, 6, 0, 1.0))), Costs())
    m = backtest.metrics(ruin, 86400).first()
    assert m.cagr == 0.0 and m.log_equity is None


def test_last_change_counts_but_is_not_charged(spark):
    rows = backtest.pnl(backtest.sliced(positions(spark, [1.0] * 7, [0, 0, 0, 0, 0, 0, 1]), slices(spark, ("all", 0, 6, 0, 1.0))), Costs())
    assert backtest.trade_meta(rows).first().turnover_sum == 1
    assert rows.agg(F.sum("pnl")).first()[0] == 0.0


def test_walkforward_segments(spark):
    close, pos = walk(801).astype(float), [1, -1, 1, 1] * 200 + [1]
    rows = backtest.pnl(backtest.sliced(positions(spark, close, pos), slices(spark, ("all", 0, 800, 0, 1.0), ("short", 0, 799, 0, 1.0))), Costs())
    w = {r.slice_id: r for r in validate.walkforward(rows, 86400).collect()}
    assert w["all"].n_segments == 4 and w["short"].n_segments == 1 and w["short"].std_sharpe == 0
    pnl, _ = numpy_pnl(close, pos, 0.00015)
    sums = [x.sum() for x in np.split(pnl, 4)]
    total = sum(sums)
    assert w["all"].dominance == pytest.approx((max if total > 0 else min)(sums) / total)


def test_split_index():
    assert split_index(100, 0.2) == 80 and split_index(100, 0.0) == 100 and split_index(100, 0.0, True) == 95
    assert split_index(3, 0.5) == 2


def genome(spark, parts, thr=0.5, gate=("any", 40), kind=signal.TYPE):
    g = {"type": kind, "features": [{"name": n, "window": w, "weight": x} for n, w, x in parts], "threshold": thr, "vol_gate": {"mode": gate[0], "window": gate[1]}}
    return spark.createDataFrame([(0, g)], f"genome_id long, genome {signal.GENOME}")


def test_positions_need_every_feature(spark):
    c = walk(60)
    got = signal.positions(series(spark, c), genome(spark, [("mr_z", 5, 1.0), ("mr_z", 20, 0.5)]), [("mr_z", 5), ("mr_z", 20), ("vol_s", 40)])
    rows = got.orderBy("t").collect()
    assert all(r.pos == 0 and r.alpha is None for r in rows[:19])
    assert all(r.pos == (1 if r.alpha > 0.5 else -1 if r.alpha < -0.5 else 0) for r in rows[19:])


def test_cv_folds_too_short(spark):
    sizes = spark.createDataFrame([("s", 1500)], "series_id string, n long")
    _, errors = validate.cv_slices(sizes, genome(spark, [("mr_z", 5, 1.0)]), EvalConfig())
    assert errors.first().error == "cv_fold_too_short"
    sizes = spark.createDataFrame([("s", 10_000)], "series_id string, n long")
    s, errors = validate.cv_slices(sizes, genome(spark, [("mr_z", 5, 1.0)]), EvalConfig())
    assert errors.first().error is None
    folds = sorted((r.lo, r.hi) for r in s.where("slice_id like '%base'").collect())
    assert len(folds) == 5 and folds[0][0] == 43 and folds[-1][1] == 9999


def test_gate_order(spark):
    row = {"n_train": 8000, "n_holdout": 2000, "type": "other", "train_exposure": 0.0}
    names = [n for n, _ in gates.stage1_checks(EvalConfig())]
    assert names.index("fail_type") < names.index("fail_train_exposure") < names.index("fail_holdout_sharpe")
    df = spark.createDataFrame([tuple(row.values())], "n_train long, n_holdout long, type string, train_exposure double")
    checks = [c for c in gates.stage1_checks(EvalConfig()) if c[0] in ("batch_train_too_short", "fail_type", "fail_train_exposure")]
    assert df.select(gates.first_failure(checks)).first()[0] == "fail_type"


def test_tertiles_need_200(spark):
    assert regime.labels(series(spark, walk(300)), 100, 100).where("vol_bin is not null").count() == 200
    assert regime.labels(series(spark, walk(299)), 100, 100).where("vol_bin is not null").count() == 0


def test_genomes_are_reproducible_and_in_range(spark):
    a, b = [G.random_genomes(spark, 50, 7).orderBy("genome_id").collect() for _ in range(2)]
    assert a == b
    for r in a:
        assert 2 <= len({p.name for p in r.genome.features}) == len(r.genome.features) <= 4
    m = G.mutate(G.random_genomes(spark, 50, 7), 9).collect()
    assert all(-2.5 <= p.weight <= 2.5 for r in m for p in r.genome.features)
    assert G.unseen(G.random_genomes(spark, 50, 7).union(G.random_genomes(spark, 50, 7).withColumn("genome_id", F.col("genome_id") + 100)), spark.createDataFrame([], "fp long")).count() <= 50


def test_canonical_json():
    assert stable_json({"b": 1e-05, "a": [1, "é"]}) == '{"a":[1,"é"],"b":1e-05}'
    assert genome_hash({"a": [1, 2]}) != genome_hash({"a": [2, 1]})


def test_csv(spark, tmp_path):
    p = tmp_path / "bars.csv"
    p.write_text("Time,Adj_Close,vol\n3,10,1\n1,20,nan\n2,30,5\n2,inf,5\n1,40,\n1,50,7\nbad,60,1\n")
    rows = B.read_csv(spark, str(p), "s").orderBy("t").collect()
    assert [(r.ts, r.close) for r in rows] == [(1, 50.0), (2, 30.0), (3, 10.0)]
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        B.read_csv(spark, str(tmp_path / "none.csv"), "s")


def test_cells(spark):
    df = spark.createDataFrame([("1.9",), (" nan ",), ("",), ("x",), (None,)], "x string")
    assert [r[0] for r in df.select(to_double(F.col("x"))).collect()] == [1.9, None, None, None, None]
    assert [r[0] for r in df.select(to_long(F.col("x"))).collect()] == [1, None, None, None, None]


def test_store(spark, tmp_path):
    def rows(*xs):
        base = {c: "x" for c in store.ALWAYS} | {m: 1 if m.startswith("trades") else 0.0 for m in store.METRICS}
        return spark.createDataFrame([{**base, "strategy_hash": h, "dataset_id": "d", "eval_id": e, "score": s, "metrics_json": j, "created_utc": c, "seq": i} for i, (h, e, s, j, c) in enumerate(xs)], store.STRATEGIES + ", seq long")

    kept = store.Store(spark, str(tmp_path / "store"))
    assert kept.read("strategies").count() == 0
    kept.upsert(rows(("a", "e1", 1.0, "j1", "2020"), ("b", "e1", 5.0, "j1", "2020"), ("a", "e2", 9.0, "j1", "2021")))
    kept.upsert(rows(("a", "e1", 0.5, "j2", "2020"), ("b", "e1", 6.0, "j2", "2020"), ("b", "e1", 6.0, "j3", "2020")))
    got = {(r.strategy_hash, r.eval_id): (r.score, r.metrics_json) for r in kept.read("strategies").collect()}
    assert got == {("a", "e1"): (1.0, "j2"), ("b", "e1"): (6.0, "j3"), ("a", "e2"): (9.0, "j1")}
    assert store.latest_eval(kept.read("strategies"), "d").first().eval_id == "e2"
    assert [r.strategy_hash for r in store.top(kept.read("strategies"), "d", 1, "e1").collect()] == ["b"]
    kept.insert_run({"run_id": "r", "dataset_id": "d"})
    kept.insert_run({"run_id": "r", "dataset_id": "e"})
    assert [r.dataset_id for r in kept.read("runs").collect()] == ["e"]


def test_bar_seconds(spark):
    def of(*ts):
        return B.bar_seconds(spark.createDataFrame([("s", i, t) for i, t in enumerate(ts)], "series_id string, t long, ts long")).first().bar_seconds

    assert of(0, 900, 1800) == 900 and of(0, 900) == 86400 and of(5, 5, 5) == 86400 and of(0, 10**7, 2 * 10**7) == 604800


def test_store_keeps_the_old_version_until_the_new_one_is_whole(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "store"))
    kept.insert_run({"run_id": "a", "dataset_id": "d"})
    reader = kept.read("runs")
    (tmp_path / "store/runs/v-2").mkdir()  # a write that ended halfway
    (tmp_path / "store/runs/v-2/part-0.parquet").write_bytes(b"half")
    assert [r.run_id for r in kept.read("runs").collect()] == ["a"]
    kept.insert_run({"run_id": "b", "dataset_id": "d"})
    kept.insert_run({"run_id": "c", "dataset_id": "d"})
    assert sorted(r.run_id for r in kept.read("runs").collect()) == ["a", "b", "c"]
    assert [r.run_id for r in reader.collect()] == ["a"]  # an older reader's files are still there
    kept.insert_run({"run_id": "e", "dataset_id": "d"})
    assert sorted(p.name for p in (tmp_path / "store/runs").iterdir()) == ["v-2", "v-3", "v-4"]


def test_delays_of_any_length_and_unnamed_ones(spark):
    rows = spark.createDataFrame([("s", 0, "x", t, 100.0 + t, t % 3 - 1, 0, 9, d, 1.0) for d in (5,) for t in range(10)], "series_id string, genome_id long, slice_id string, t long, close double, pos int, lo long, hi long, delay int, cost_mult double")
    got = [r.pos for r in backtest.pnl(rows, Costs(), delays=(5,)).orderBy("t").collect()]
    assert got == [0] * 5 + [t % 3 - 1 for t in range(5)]
    with pytest.raises(Exception, match="not named"):
        backtest.pnl(rows, Costs()).collect()


def test_host_advice():
    from barloom.operators import host

    assert host.recommended_ram_gb(15.86)["budget_gb"] == 10.35 and host.recommended_ram_gb(15.86)["reserve_gb"] == 3.0
    assert host.recommended_ram_gb(64)["budget_gb"] == 43.8 and host.recommended_ram_gb(2)["budget_gb"] == 1.0 and host.recommended_ram_gb(None)["budget_gb"] is None
    assert [host.recommended_io_workers(x) for x in (None, 799, 800, 1499, 1500)] == [2, 2, 4, 4, 6]
    assert host.resources(4) == {"workers": 4, "batch": 48, "inflight": 8} and host.resources(1) == {"workers": 1, "batch": 32, "inflight": 4} and host.resources(500)["batch"] == 4096
    assert host.human_bytes(None) == "n/a" and host.human_bytes(1023) == "1023 B" and host.human_bytes(1536) == "1.50 KB" and host.human_bytes(5 * 1024**3) == "5.00 GB"
    assert host.workers_of({"recommendations": {"recommended_cpu_workers": "8"}}) == 8 and host.workers_of({}) is None
    assert host.capabilities("/no/such/file.json") == {}


def test_every_gate_fires(spark):
    from barloom.plans import catalog

    codes = {r.reject_reason for r in catalog.gate_chain(spark, "/root/testdata/sf0.001").collect()}
    assert codes == {None, *(x[0] for x in catalog._CHAIN)} and len(catalog._CHAIN) == 30


def test_crossover_of_like_parents_takes_random_parts(spark):
    one = {"type": signal.TYPE, "features": [{"name": "mr_z", "window": 20, "weight": 2.0}, {"name": "mom_ir", "window": 5, "weight": -1.0}], "threshold": 0.5, "vol_gate": {"mode": "any", "window": 80}}
    pairs = spark.range(400).select(F.col("id").alias("genome_id")).crossJoin(spark.createDataFrame([(one, one)], f"a {signal.GENOME}, b {signal.GENOME}"))
    got = [r.genome for r in G.crossover(pairs, 3).collect()]
    sizes = {len(g.features) for g in got}
    assert sizes == {2, 3, 4}
    known = {("mr_z", 20): 2.0, ("mom_ir", 5): -1.0}
    foreign = [p.weight for g in got for p in g.features if (p.name, p.window) not in known]
    assert foreign and max(map(abs, foreign)) <= 1.5 and max(map(abs, foreign)) > 1.2
    assert all(abs(p.weight - known[p.name, p.window]) < 0.6 for g in got for p in g.features if (p.name, p.window) in known)
    assert all(len({(p.name, p.window) for p in g.features}) == len(g.features) for g in got)
    windows, modes = [g.vol_gate.window != 80 for g in got], [g.vol_gate["mode"] != "any" for g in got]
    assert 10 < sum(windows) < 90 and 10 < sum(modes) < 90


def test_generation_takes_seeds_first_and_nothing_seen(spark):
    from barloom.config import ResearchConfig
    from barloom.operators import search

    cfg = ResearchConfig("d", "store", 3, 1, 10)
    seeds = G.random_genomes(spark, 14, 99).select(F.col("genome_id").alias("place"), "genome")
    elite = spark.createDataFrame([], search.ELITE)
    seen = spark.createDataFrame([], "fp long, arrival long")
    first = search.generation(spark, cfg, 1, elite, seen, 0, seeds).collect()
    prints = [r.fp for r in seeds.orderBy("place").select(G.fingerprint(F.col("genome")).alias("fp")).collect()]
    assert [r.fp for r in sorted(first, key=lambda r: r.genome_id)] == prints[:10]
    seen = spark.createDataFrame([(r.fp, r.genome_id) for r in first], "fp long, arrival long")
    second = sorted(search.generation(spark, cfg, 2, elite, seen, 10, seeds).collect(), key=lambda r: r.genome_id)
    assert [r.fp for r in second[:4]] == prints[10:] and len(second) == 10 and not {r.fp for r in second} & {r.fp for r in first}


def test_equity_compounds_in_a_tree(spark):
    """Long losses end at 0, not at the smallest number that rounding holds; else equity and peaks are those of numpy."""
    n = 70_000
    pnl = np.random.default_rng(5).normal(0, 0.004, n)
    base = spark.createDataFrame([("s", 1, "all", t, float(x)) for t, x in enumerate(pnl)], "series_id string, genome_id int, slice_id string, t long, pnl double")
    loss = spark.range(3000).select(F.lit("s").alias("series_id"), F.lit(2).alias("genome_id"), F.lit("all").alias("slice_id"), F.col("id").alias("t"), F.lit(-0.3).alias("pnl"))
    got = backtest.equity(base.union(loss)).toPandas()
    one, two = (got[got.genome_id == i].sort_values("t") for i in (1, 2))
    eq = np.cumprod(1 + pnl)
    assert len(one) == n and np.allclose(one.equity, eq, rtol=1e-11, atol=0)
    assert np.allclose(one.drawdown, eq / np.maximum(1, np.maximum.accumulate(eq)) - 1, rtol=0, atol=1e-11)
    assert two.equity.iloc[-1] == 0 and two.drawdown.iloc[-1] == -1
    m = {r.genome_id: r for r in backtest.metrics(base.union(loss), 86400).collect()}
    assert m[2].log_equity is None and m[2].cagr == 0 and m[1].bars == n


def test_metrics_take_one_pass_and_stress_shares_rows(spark):
    """No list of a slice's rows is gathered, and costs and delays that leave a slice as it is add no rows of it."""
    rng = np.random.default_rng(8)
    n, c = 3000, np.float32(1000 * np.exp(np.cumsum(rng.normal(0, 0.01, 3000))))
    pos = rng.integers(-1, 2, n)
    base = spark.createDataFrame([("s", 1, t, float(x), int(p)) for t, (x, p) in enumerate(zip(c, pos, strict=True))], "series_id string, genome_id int, t long, close double, pos int")
    grid = validate.stress_grid(base, validate.series_sizes(base), Costs(), 86400, 0.2)
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "x5_d1_holdout" not in plan
    got = {r.slice_id: r for r in grid.collect()}
    assert set(got) == {f"x{m}_d{d}_{s}" for m in (1, 2, 3, 5) for d in (0, 1) for s in ("train", "holdout")}
    c, k = c.astype(np.float64), 2400
    for name, r in got.items():
        mult, delay, part = int(name[1]), int(name[4]), name[6:]
        lo, hi = (0, k) if part == "train" else (k, n - 1)
        p = pos[lo : hi + 1].astype(float)
        if part == "holdout" and delay:
            p = np.r_[0.0, p[:-1]]
        pnl = (p * np.r_[c[lo + 1 : hi + 1] / c[lo:hi] - 1, 0] - Costs().rate * mult * np.abs(np.diff(np.r_[0.0, p])))[:-1]
        eq = np.cumprod(1 + pnl)
        assert r.bars == hi - lo and r.mean_bar_return == pytest.approx(pnl.mean(), abs=1e-12) and r.std_bar_return == pytest.approx(pnl.std(ddof=1), rel=1e-9)
        assert r.log_equity == pytest.approx(np.log(eq[-1]), abs=1e-9)
        assert r.max_drawdown == pytest.approx((eq / np.maximum(1, np.maximum.accumulate(eq)) - 1).min(), abs=1e-9)


def test_one_pass_compounds_as_the_tree_of_rows_does(spark):
    """Ends are the last of ``equity`` to the bit, also among the smallest numbers, whatever the batches."""
    rng = np.random.default_rng(2)
    rows = [("s", g, "all", t, x) for g, n, at in ((1, 5000, 0.0), (2, 2000, -0.3), (3, 1, 0.5), (4, 256, 0.01)) for t, x in enumerate((rng.normal(at, 0.01, n)).tolist())]
    df = spark.createDataFrame(rows, "series_id string, genome_id int, slice_id string, t long, pnl double")
    ends = {r.genome_id: r.e for r in backtest.equity(df).groupBy("genome_id").agg(F.max_by("equity", "t").alias("e")).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {r.genome_id: r for r in backtest.metrics(df, 86400).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {g: r.bars for g, r in got.items()} == {1: 5000, 2: 2000, 3: 1, 4: 256} and got[3].error == "too_few_bars"
    for g in (1, 2, 4):
        assert got[g].total_return == ends[g] - 1


def test_generation_reads_bars_and_positions_that_were_written(spark):
    """The events are read once; the later steps read what was written, and results are those of one plan."""
    from barloom.plans import catalog, fixtures as X

    d = "/root/testdata/sf0.001"
    out = catalog.evaluate_generation(spark, d)
    assert "event_id" not in out._jdf.queryExecution().optimizedPlan().toString()
    plain = gates.evaluate(catalog._ticks(spark, d), X.genomes(spark), signal.needed(X.as_dicts()), X.CONFIG, X.BAR_SECONDS)
    assert {(r.genome_id, r.reject_reason) for r in out.collect()} == {(r.genome_id, r.reject_reason) for r in plain.select("genome_id", "reject_reason").collect()}


def test_quantiles_hold_no_series_in_one_buffer(spark):
    """Exact as Spark's percentile, which gathers all values of a series in one aggregation buffer."""
    from barloom.operators.features import quantiles

    x = np.random.default_rng(1).normal(0, 1, 5001)
    rows = [("a", float(v), None if i % 3 else float(round(v))) for i, v in enumerate(x)] + [("b", 2.5, float("inf"))] * 7 + [("c", None, None)]
    df = spark.createDataFrame(rows, "series_id string, u double, v double")
    at = [0.5, 1 / 3, 2 / 3]
    asked = quantiles(df, {"u": F.col("u"), "v": F.col("v")}, at)
    got = {r.series_id: r for r in asked.collect()}
    for r in df.where("series_id <> 'c'").groupBy("series_id").agg(*[F.percentile(k, F.array(*map(F.lit, at))).alias(k) for k in "uv"], *[F.count(k).alias(f"n_{k}") for k in "uv"]).collect():
        assert (got[r.series_id].u, got[r.series_id].v, got[r.series_id].n_u, got[r.series_id].n_v) == (r.u, r.v, r.n_u, r.n_v)
    assert "c" not in got
    vol = features(series(spark, walk(300)), [("vol_s", 20)])._jdf.queryExecution().toString()
    assert "median(" not in vol and "percentile(" not in vol
