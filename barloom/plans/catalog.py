"""Registered queries: each a DataFrame over the driver's tables and, where it can be, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import backtest, gates, genomes as G, regime, search, signal, store, validate
from barloom.operators.features import features, gate, rolling_mean, rolling_std, with_inputs
from barloom.plans import fixtures as X
from barloom.sources import bars as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r(x: str | Column, name: str | None = None, digits: int = 6) -> Column:
    col = F.col(x) if isinstance(x, str) else x
    return (F.round(col.cast("double"), digits) + 0.0).alias(name or x)  # no negative zeros


def rs(x: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name}"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events")


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return B.events_as_ticks(_events(spark, d))


def _positions(spark: SparkSession, d: str, ids=None) -> DataFrame:
    return signal.positions(_ticks(spark, d), X.genomes(spark, ids), signal.needed(X.as_dicts(ids)))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Numbering the bars keeps their count, so the raw events give it without the window."""
    return _events(spark, d).agg(F.count("*").alias("n")).select(F.lit("events").alias("series_id"), F.col("n"))


# ---------------------------------------------------------------- bars


@query("""SELECT date_trunc('hour', ts) AS ts, CAST(arg_min(p, (ts, event_id)) AS DOUBLE) AS open, CAST(max(p) AS DOUBLE) AS high, CAST(min(p) AS DOUBLE) AS low, CAST(arg_max(p, (ts, event_id)) AS DOUBLE) AS close, count(*) AS volume
FROM (SELECT ts, event_id, CAST(1000 + value / 10 AS FLOAT) AS p FROM events) GROUP BY 1""")
def bars_hourly(spark, d):
    bars = B.resampled(_events(spark, d))
    return bars.select(F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.col(k).cast("double").alias(k) for k in ("open", "high", "low", "close")], F.col("volume").cast("bigint").alias("volume"))


@query(f"WITH {X.BARS} SELECT t, CAST(close AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume, CAST(coalesce(lag(close) OVER (ORDER BY t), close) AS DOUBLE) AS open FROM bars")
def bars_tick(spark, d):
    return _ticks(spark, d).select("t", *[F.col(k).cast("double").alias(k) for k in ("close", "volume", "open")])


@query("""WITH b AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, CAST(CAST(1000 + value / 10 AS FLOAT) AS DOUBLE) AS c FROM events)
SELECT series_id, t, round(CASE WHEN count(c) OVER w = 20 THEN CAST(greatest(-6.0, least(6.0, -(c - avg(c) OVER w) / (stddev_pop(c) OVER w + 1e-12))) AS FLOAT) END, 5) AS mr_z_20 FROM b
WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""".replace("SELECT series_id, t, round(CASE", "SELECT series_id, t, round(CAST(CASE").replace("AS FLOAT) END, 5)", "AS FLOAT) END AS DOUBLE), 5)"))
def bars_panel(spark, d):
    bars = B.events_as_ticks(_events(spark, d), F.col("event_type"))
    return features(bars, [("mr_z", 20)]).select("series_id", "t", r("mr_z_20", digits=5))


@query(f"WITH {X.BARS} SELECT t, {rs('lead(c) OVER (ORDER BY t) / c - 1', 'ret', 9)} FROM inp")
def simple_returns(spark, d):
    bars = _ticks(spark, d).withColumn("genome_id", F.lit(0))
    one = backtest.sliced(bars.withColumn("pos", F.lit(0).cast("byte")), _whole(_sizes(spark, d)))
    return backtest.pnl(one, X.COSTS).select("t", r("ret", digits=9))


def _whole(sizes: DataFrame) -> DataFrame:
    return sizes.select("series_id", F.lit("all").alias("slice_id"), F.lit(0).cast("bigint").alias("lo"), (F.col("n") - 1).alias("hi"), F.lit(0).alias("delay"), F.lit(1.0).alias("cost_mult"))


WHOLE_SQL = "SELECT 'all' AS sid, 0 AS lo, count(*) - 1 AS hi, 0 AS delay, 1.0 AS mult, NULL AS gid FROM bars"


@query("SELECT 'events' AS series_id, CAST(greatest(1, least(604800, round_even(median(d) / 1e6, 0))) AS BIGINT) AS bar_seconds FROM (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) AS d FROM events)")
def bar_seconds(spark, d):
    """Steps in microseconds, as seconds: the unit is settled at ingest."""
    bars = _ticks(spark, d).select("series_id", "t", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return B.bar_seconds(bars)


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_totalprice AS close FROM orders)
SELECT row, round(coalesce(lag(close) OVER (ORDER BY row), close), 6) AS open, round(greatest(close, coalesce(lag(close) OVER (ORDER BY row), close)), 6) AS high,
round(least(close, coalesce(lag(close) OVER (ORDER BY row), close)), 6) AS low, round(close, 6) AS close, CAST(0 AS DOUBLE) AS volume FROM p""")
def csv_defaults(spark, d):
    """What a file with closes only is filled with."""
    raw = _table(spark, d, "orders").select(F.lit("orders").alias("series_id"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("close"))
    rows = B.filled(B.numbered(raw, "key").withColumnRenamed("t", "row"), "row")
    return rows.select("row", *[r(k) for k in ("open", "high", "low", "close", "volume")])


@query()
def demo_ohlcv(spark, d):
    return B.demo(spark)


# ---------------------------------------------------------------- features


@query(f"WITH {X.BARS} SELECT t, {rs(X.mean_sql('c', 20), 'mean_20')}, {rs('c', 'mean_1')} FROM inp")
def rolling_means(spark, d):
    rows = with_inputs(_ticks(spark, d), 21)
    rows = rows.select("t", "_halo", rolling_mean("close", 20).alias("mean_20"), rolling_mean("close", 1).alias("mean_1")).where(~F.col("_halo"))
    return rows.select("t", r("mean_20"), r("mean_1"))


@query(f"WITH {X.BARS} SELECT t, {rs(X.std_sql('c', 20), 'std_20')}, CAST(NULL AS DOUBLE) AS std_1 FROM inp")
def rolling_std_pop(spark, d):
    rows = with_inputs(_ticks(spark, d), 21)
    rows = rows.select("t", "_halo", rolling_std("close", 20).alias("std_20"), rolling_std("close", 1).alias("std_1")).where(~F.col("_halo"))
    return rows.select("t", r("std_20"), r("std_1"))


def _feature(name: str, ws: tuple[int, ...]):
    def run(spark, d):
        return features(_ticks(spark, d), [(name, w) for w in ws]).select("t", *[r(f"{name}_{w}", digits=5) for w in ws])

    run.__name__ = f"feat_{name}"
    query(f"WITH {X.BARS}, {X.features_sql([(name, w) for w in ws])} SELECT t, {', '.join(rs(f'{name}_{w}', f'{name}_{w}', 5) for w in ws)} FROM f")(run)


for _name in ("mom_ir", "mr_z", "vol_s", "volu_z"):
    _feature(_name, (5, 20, 80))


@query(f"WITH {X.BARS}, {X.features_sql([('vol_s', 40)])} SELECT t, coalesce(vol_s_40 > 0, FALSE) AS high, coalesce(vol_s_40 < 0, FALSE) AS low, TRUE AS any_mode FROM f")
def vol_gate_mask(spark, d):
    rows = features(_ticks(spark, d), [("vol_s", 40)])
    return rows.select("t", *[gate(F.col("vol_s_40"), F.lit(m)).alias(m if m != "any" else "any_mode") for m in ("high", "low", "any")])


@query(f"WITH {X.BARS} SELECT t, {rs(X.mean_sql('r', 160), 'trend_160', 9)} FROM inp")
def trend_mean(spark, d):
    return features(_ticks(spark, d), [], trends=[160]).select("t", r("trend_160", digits=9))


@query(f"""WITH g(gid, w) AS (VALUES {', '.join(f"({i}, {max([w for _, w, _ in parts] + [gt[1]])})" for i, parts, _, gt in X.GENOMES)})
SELECT CAST(gid AS BIGINT) AS genome_id, CAST(greatest(2, least(5000, w + 3)) AS BIGINT) AS warmup FROM g""")
def warmup_index(spark, d):
    return validate.warmup(X.genomes(spark))


# ---------------------------------------------------------------- signals and backtests


@query(f"WITH {X.positions_sql()} SELECT CAST(gid AS BIGINT) AS genome_id, t, {rs('alpha', 'alpha', 4)} FROM p")
def alpha_linear(spark, d):
    return _positions(spark, d).select("genome_id", "t", r("alpha", digits=4))


@query(f"WITH {X.positions_sql()} SELECT CAST(gid AS BIGINT) AS genome_id, t, CAST(pos AS INTEGER) AS pos FROM p")
def positions(spark, d):
    return _positions(spark, d).select("genome_id", "t", F.col("pos").cast("int").alias("pos"))


def _backtest(spark, d, slices: Callable[[DataFrame], DataFrame], ids=None, delays: tuple[int, ...] = (0, 1)) -> DataFrame:
    return backtest.pnl(backtest.sliced(_positions(spark, d, ids), slices(_sizes(spark, d))), X.COSTS, delays=delays)


_DELAYS = (1, 4, 7)
_DELAYED = " UNION ALL ".join(f"SELECT 'd{n}' AS sid, 0 AS lo, count(*) - 1 AS hi, {n} AS delay, 1.0 AS mult, NULL AS gid FROM bars" for n in _DELAYS)


@query(f"WITH {X.positions_sql()}, {X.slices_sql(_DELAYED)} SELECT CAST(gid AS BIGINT) AS genome_id, CAST(delay AS INTEGER) AS delay, t, CAST(pos AS INTEGER) AS pos FROM q")
def positions_delayed(spark, d):
    each = F.explode(F.array(*[F.lit(n) for n in _DELAYS]))
    rows = _backtest(spark, d, lambda s: _whole(s).withColumn("delay", each).withColumn("slice_id", F.concat(F.lit("d"), F.col("delay"))), delays=_DELAYS)
    return rows.select("genome_id", "delay", "t", F.col("pos").cast("int").alias("pos"))


@query(f"WITH {X.positions_sql()}, {X.slices_sql(WHOLE_SQL)} SELECT CAST(gid AS BIGINT) AS genome_id, t, {rs('pnl', 'pnl', 9)} FROM q")
def pnl_net(spark, d):
    return _backtest(spark, d, _whole).select("genome_id", "t", r("pnl", digits=9))


TH_SQL = """SELECT 'train' AS sid, 0 AS lo, least(k, n - 1) AS hi, 0 AS delay, 1.0 AS mult, NULL AS gid FROM z UNION ALL SELECT 'holdout', k, n - 1, 0, 1.0, NULL FROM z"""
Z_SQL = "z AS (SELECT n, greatest(2, least(n - 2, CAST(round_even(n * 0.8, 0) AS BIGINT))) AS k FROM (SELECT count(*) AS n FROM bars))"


def _th(sizes: DataFrame) -> DataFrame:
    return validate.train_holdout(sizes, 0.20)


META_SQL = "mt AS (SELECT gid, sid, sum(turnover) AS turnover_sum, avg(turnover) AS turnover_mean, sum((turnover > 0)::INT) AS trades, sum(CASE WHEN t < hi THEN (pos <> 0)::INT END) AS active_bars, avg(CASE WHEN t < hi THEN (pos <> 0)::INT END) AS exposure FROM q GROUP BY gid, sid)"


@query(f"WITH {X.positions_sql()}, {Z_SQL}, {X.slices_sql(TH_SQL)}, {META_SQL} SELECT CAST(gid AS BIGINT) AS genome_id, sid AS slice_id, {rs('turnover_sum', 'turnover_sum')}, {rs('turnover_mean', 'turnover_mean')}, CAST(trades AS BIGINT) AS trades, CAST(active_bars AS BIGINT) AS active_bars, {rs('exposure', 'exposure')} FROM mt")
def trade_meta(spark, d):
    m = backtest.trade_meta(_backtest(spark, d, _th))
    return m.select("genome_id", "slice_id", r("turnover_sum"), r("turnover_mean"), "trades", "active_bars", r("exposure"))


@query(f"WITH {X.positions_sql()}, {X.slices_sql(WHOLE_SQL)}, {X.metrics_sql()} SELECT CAST(gid AS BIGINT) AS genome_id, t, {rs('ln(eq)', 'log_equity')}, {rs('dd', 'drawdown')} FROM m1")
def equity_curve(spark, d):
    rows = backtest.equity(_backtest(spark, d, _whole).select(*backtest.KEYS, "t", "pnl"))
    log = F.when(F.col("equity") == 0, F.lit(float("-inf"))).otherwise(F.log("equity"))
    return rows.select("genome_id", "t", r(log, "log_equity"), r("drawdown"))


@query(f"WITH {X.positions_sql()}, {X.slices_sql(WHOLE_SQL)}, {X.metrics_sql()} SELECT CAST(gid AS BIGINT) AS genome_id, {rs('mdd', 'max_drawdown')} FROM m")
def max_drawdown(spark, d):
    return backtest.metrics(_backtest(spark, d, _whole), X.BAR_SECONDS).select("genome_id", r("max_drawdown"))


M_SQL = f"CAST(gid AS BIGINT) AS genome_id, sid AS slice_id, CASE WHEN NOT ok THEN 'too_few_bars' END AS error, CAST(bars AS BIGINT) AS bars, {rs('CASE WHEN ok THEN mu END', 'mean_bar_return', 9)}, {rs('CASE WHEN ok THEN sd END', 'std_bar_return', 9)}, {rs('CASE WHEN ok THEN sharpe END', 'sharpe')}, {rs('CASE WHEN ok THEN log_equity END', 'log_equity')}, {rs('CASE WHEN ok THEN mdd END', 'max_drawdown')}, {rs(f'CASE WHEN ok THEN {X.calmar_sql()} END', 'calmar', 4)}"


def _m(df: DataFrame) -> DataFrame:
    return df.select("genome_id", "slice_id", "error", "bars", r("mean_bar_return", digits=9), r("std_bar_return", digits=9), r("sharpe"), r("log_equity"), r("max_drawdown"), r("calmar", digits=4))


@query(f"WITH {X.positions_sql()}, {X.slices_sql(WHOLE_SQL)}, {X.metrics_sql()} SELECT {M_SQL} FROM m")
def metrics_from_pnl(spark, d):
    return _m(backtest.metrics(_backtest(spark, d, _whole), X.BAR_SECONDS))


@query(f"WITH {X.positions_sql()}, {X.slices_sql(WHOLE_SQL)}, {X.metrics_sql(min_bars=50, where='pos <> 0')} SELECT {M_SQL.replace('too_few_bars', 'too_few_masked_bars')} FROM m")
def metrics_active(spark, d):
    return _m(backtest.active_metrics(_backtest(spark, d, _whole), X.BAR_SECONDS, 50))


@query(f"WITH {X.positions_sql()}, {Z_SQL}, {X.slices_sql(TH_SQL)}, {X.metrics_sql()} SELECT {M_SQL} FROM m")
def train_holdout_metrics(spark, d):
    return _m(backtest.metrics(_backtest(spark, d, _th), X.BAR_SECONDS))


WF_SQL = f"""w0 AS (SELECT *, count(*) OVER (PARTITION BY gid, sid) AS nn FROM q WHERE pnl IS NOT NULL),
w1 AS (SELECT *, CASE WHEN nn // 4 < 200 THEN 0 ELSE least((t - lo) // (nn // 4), 3) END AS seg FROM w0),
{X.metrics_sql('w1', 'gid, sid, seg', 'wm')},
wf AS (SELECT gid, sid, count(*) AS n_segments, sum((ok AND total_return > 0)::INT) AS positive_segments, median(CASE WHEN ok THEN sharpe END) AS median_sharpe, coalesce(stddev_pop(CASE WHEN ok THEN sharpe END), 0.0) AS std_sharpe,
  CASE WHEN sum(pnl_sum) > 1e-12 THEN max(pnl_sum) / sum(pnl_sum) WHEN sum(pnl_sum) < -1e-12 THEN min(pnl_sum) / sum(pnl_sum) ELSE 1.0 END AS dominance, count(CASE WHEN ok THEN 1 END) AS usable FROM wm GROUP BY gid, sid)"""


@query(f"WITH {X.positions_sql()}, {Z_SQL}, {X.slices_sql(TH_SQL)}, {WF_SQL} SELECT CAST(gid AS BIGINT) AS genome_id, sid AS slice_id, CAST(n_segments AS BIGINT) AS n_segments, CAST(positive_segments AS BIGINT) AS positive_segments, {rs('median_sharpe', 'median_sharpe')}, {rs('std_sharpe', 'std_sharpe')} FROM wf")
def walkforward(spark, d):
    w = validate.walkforward(_backtest(spark, d, _th), X.BAR_SECONDS)
    return w.select("genome_id", "slice_id", "n_segments", "positive_segments", r("median_sharpe"), r("std_sharpe"))


@query(f"WITH {X.positions_sql()}, {Z_SQL}, {X.slices_sql(TH_SQL)}, {WF_SQL} SELECT CAST(gid AS BIGINT) AS genome_id, sid AS slice_id, {rs('dominance', 'dominance')} FROM wf")
def wf_dominance(spark, d):
    return validate.walkforward(_backtest(spark, d, _th), X.BAR_SECONDS).select("genome_id", "slice_id", r("dominance"))


_CV_ROWS = " UNION ALL ".join(
    f"SELECT printf('%04d', CAST(i AS INTEGER)) || ':{name}' AS sid, st + i * seg AS lo, CASE WHEN i < k - 1 THEN st + (i + 1) * seg ELSE n END - 1 AS hi, {delay} AS delay, {mult} AS mult, gid FROM cvk, range(0, 99) tt(i) WHERE i < k AND seg >= 800"
    for name, delay, mult in (("base", 0, 1.0), ("delay", 1, 1.0), ("cost", 0, 3.0))
)
_CVK = f"""wu(gid, w) AS (VALUES {', '.join(f"({i}, {max([w for _, w, _ in parts] + [gt[1]]) + 3})" for i, parts, _, gt in X.GENOMES)}),
cv0 AS (SELECT gid, n, least(w, n - 2) AS st, n - least(w, n - 2) AS ne FROM wu, (SELECT count(*) AS n FROM bars)),
cvk AS (SELECT *, ne // k AS seg FROM (SELECT *, CASE WHEN ne < 5 * 800 THEN greatest(2, ne // 800) ELSE 5 END AS k FROM cv0))"""
_CV = f"WITH {X.positions_sql()}, {_CVK}, {X.slices_sql(_CV_ROWS)}, {X.metrics_sql()}"


def _cv(spark, d):
    return validate.cv_folds(_positions(spark, d), _sizes(spark, d), X.genomes(spark), X.CONFIG, X.BAR_SECONDS)


@query(f"{_CV} SELECT CAST(gid AS BIGINT) AS genome_id, CAST(split_part(sid, ':', 1) AS INTEGER) AS fold, split_part(sid, ':', 2) AS scenario, {rs('sharpe', 'sharpe')}, {rs('max_drawdown', 'max_drawdown')} FROM (SELECT *, mdd AS max_drawdown FROM m) WHERE ok")
def cv_folds(spark, d):
    return _cv(spark, d)[0].select("genome_id", "fold", "scenario", r("sharpe"), r("max_drawdown"))


@query(f"""{_CV}, fw AS (SELECT gid, split_part(sid, ':', 1) AS fold, max(CASE WHEN sid LIKE '%:base' THEN sharpe END) AS b, max(CASE WHEN sid LIKE '%:delay' THEN sharpe END) AS dl, max(CASE WHEN sid LIKE '%:cost' THEN sharpe END) AS co,
  max(CASE WHEN sid LIKE '%:base' THEN total_return END) AS rb, max(CASE WHEN sid LIKE '%:cost' THEN total_return END) AS rc FROM m WHERE ok GROUP BY 1, 2)
SELECT CAST(cvk.gid AS BIGINT) AS genome_id, CASE WHEN seg < 800 THEN 'cv_fold_too_short' WHEN count(fold) < 2 THEN 'cv_insufficient_folds' END AS error, CAST(nullif(count(fold), 0) AS BIGINT) AS folds, {rs('median(b)', 'median_sharpe')}, {rs('min(b)', 'min_sharpe')}, {rs('stddev_pop(b)', 'std_sharpe')},
{rs('median(dl)', 'median_sharpe_delay')}, {rs('min(co)', 'min_sharpe_cost')}, CAST(sum((rb > 0)::INT) AS BIGINT) AS positive_folds, CAST(sum((rc > 0)::INT) AS BIGINT) AS positive_folds_cost FROM cvk LEFT JOIN fw USING (gid) GROUP BY cvk.gid, seg""")
def cv_summary(spark, d):
    s = validate.cv_summary(*_cv(spark, d))
    return s.select("genome_id", "error", "folds", *[r(x) for x in ("median_sharpe", "min_sharpe", "std_sharpe", "median_sharpe_delay", "min_sharpe_cost")], "positive_folds", "positive_folds_cost")


_STRESS = " UNION ALL ".join(
    f"SELECT 'x{c}_d{dl}_train' AS sid, 0 AS lo, least(k, n - 1) AS hi, 0 AS delay, {c} AS mult, NULL AS gid FROM z UNION ALL SELECT 'x{c}_d{dl}_holdout', k, n - 1, {dl}, {c}, NULL FROM z" for c in (1, 2, 3, 5) for dl in (0, 1)
)


@query(f"WITH {X.positions_sql()}, {Z_SQL}, {X.slices_sql(_STRESS)}, {X.metrics_sql()} SELECT CAST(gid AS BIGINT) AS genome_id, sid AS slice_id, {rs('sharpe', 'sharpe')}, {rs('log_equity', 'log_equity')}, {rs('mdd', 'max_drawdown')} FROM m")
def stress_grid(spark, d):
    g = validate.stress_grid(_positions(spark, d), _sizes(spark, d), X.COSTS, X.BAR_SECONDS, 0.20)
    return g.select("genome_id", "slice_id", r("sharpe"), r("log_equity"), r("max_drawdown"))


# ---------------------------------------------------------------- regimes

REGIME_SQL = f"""{X.features_sql([('vol_s', 160)], X.mean_sql('r', 160) + ' AS trend')},
qq AS (SELECT count(vol_s_160) AS nv, quantile_cont(CAST(vol_s_160 AS DOUBLE), [1/3, 2/3]) AS qv, count(trend) AS nt, quantile_cont(trend, [1/3, 2/3]) AS qt FROM f),
rg AS (SELECT t, CASE WHEN nv >= 200 AND vol_s_160 IS NOT NULL THEN CASE WHEN vol_s_160 <= qv[1] THEN 0 WHEN vol_s_160 <= qv[2] THEN 1 ELSE 2 END END AS vb,
  CASE WHEN nt >= 200 AND trend IS NOT NULL THEN CASE WHEN trend <= qt[1] THEN 0 WHEN trend <= qt[2] THEN 1 ELSE 2 END END AS tb FROM f, qq)"""


@query(f"WITH {X.BARS}, {REGIME_SQL} SELECT t, CAST(coalesce(vb, -1) AS INTEGER) AS vol_bin, CAST(coalesce(tb, -1) AS INTEGER) AS trend_bin, CAST(coalesce(vb * 3 + tb, -1) AS INTEGER) AS regime FROM rg")
def regime_bins(spark, d):
    rows = regime.labels(_ticks(spark, d))
    known = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c)
    return rows.select("t", known("vol_bin"), known("trend_bin"), known("regime"))


_RG = REGIME_SQL.replace("f0 AS", "rf0 AS").replace("f0.*", "rf0.*").replace("FROM f0", "FROM rf0").replace(" f AS (", " rf AS (").replace("FROM f,", "FROM rf,").replace("FROM f)", "FROM rf)").replace("med AS", "rmed AS").replace(", med)", ", rmed)")
ATTR_SQL = f"""WITH {X.positions_sql()}, {X.slices_sql(WHOLE_SQL)}, {_RG},
att AS (SELECT gid, vb * 3 + tb AS rid, count(*) AS bars, sum((pos <> 0)::INT) AS active, sum(pnl) AS s, avg(pnl) AS mu, stddev_pop(pnl) AS sd FROM q JOIN rg USING (t) WHERE pnl IS NOT NULL AND vb * 3 + tb IS NOT NULL GROUP BY 1, 2),
ar AS (SELECT g.gid, i.rid, coalesce(bars, 0) AS bars, coalesce(active, 0) AS active_bars, coalesce(active / bars, 0.0) AS exposure, coalesce(s, 0.0) AS pnl_sum, coalesce(mu, 0.0) AS pnl_mean, CASE WHEN sd > 1e-12 THEN mu / sd * sqrt(CAST(365.25 AS DOUBLE)) ELSE 0.0 END AS sharpe
  FROM (SELECT DISTINCT gid FROM q) g CROSS JOIN range(0, 9) i(rid) LEFT JOIN att ON att.gid = g.gid AND att.rid = i.rid)"""


def _attribution(spark, d):
    return regime.attribution(_backtest(spark, d, _whole), regime.labels(_ticks(spark, d)), X.BAR_SECONDS)


@query(f"{ATTR_SQL} SELECT CAST(gid AS BIGINT) AS genome_id, CAST(rid AS INTEGER) AS rid, CAST(bars AS BIGINT) AS bars, CAST(active_bars AS BIGINT) AS active_bars, {rs('exposure', 'exposure')}, {rs('pnl_sum', 'pnl_sum')}, {rs('pnl_mean', 'pnl_mean', 9)}, {rs('sharpe', 'sharpe')} FROM ar")
def regime_attribution(spark, d):
    a = _attribution(spark, d)
    return a.select("genome_id", "rid", F.col("bars").cast("bigint").alias("bars"), "active_bars", r("exposure"), r("pnl_sum"), r("pnl_mean", digits=9), r("sharpe"))


@query(f"{ATTR_SQL} SELECT CAST(gid AS BIGINT) AS genome_id, CAST(sum((bars >= 600 AND exposure >= 0.03)::INT) AS BIGINT) AS coverage, {rs('coalesce(min(CASE WHEN bars >= 600 AND exposure >= 0.03 THEN sharpe END), 0.0)', 'worst_sharpe')}, {rs('CASE WHEN sum(greatest(0.0, pnl_sum)) > 1e-12 THEN max(greatest(0.0, pnl_sum)) / sum(greatest(0.0, pnl_sum)) ELSE 0.0 END', 'dominance')} FROM ar GROUP BY gid")
def regime_summary(spark, d):
    return regime.summary(_attribution(spark, d)).select("genome_id", "coverage", r("worst_sharpe"), r("dominance"))


# ---------------------------------------------------------------- gates and scores

_ST = TH_SQL + " UNION ALL SELECT 'stress', k, n - 1, 0, 3.0, NULL FROM z"
_CHECKS = [
    ("batch_train_too_short", "tn < 5000"), ("batch_holdout_too_short", "hn < 1500"), ("fail_train_metrics_error", "NOT t_ok"), ("fail_train_exposure", "t_ex < 0.02"), ("fail_train_active_bars", "t_ab < 300"), ("fail_train_trades", "t_tr < 60"),
    ("fail_train_turnover", "t_to > 1.2"), ("fail_train_mdd", "abs(t_dd) > 0.75"), ("fail_train_sharpe", "t_sh < 0.25"), ("fail_train_wf_error", "usable = 0"), ("fail_train_wf_pos_segments", "positive_segments < 2"), ("fail_train_wf_dominance", "abs(dominance) > 0.85"),
    ("fail_holdout_metrics_error", "NOT h_ok"), ("fail_holdout_exposure", "h_ex < 0.01"), ("fail_holdout_active_bars", "h_ab < 80"), ("fail_holdout_trades", "h_tr < 10"), ("fail_holdout_turnover", "h_to > 1.5"), ("fail_holdout_mdd", "abs(h_dd) > 0.75"),
    ("fail_holdout_sharpe", "h_sh < 0.05"), ("fail_holdout_stress_metrics_error", "NOT s_ok"), ("fail_holdout_stress_sharpe", "s_sh < 0.0"),
]
_PIV = ", ".join(f"max(CASE WHEN m.sid = '{s}' THEN {v} END) AS {p}_{n}" for s, p in (("train", "t"), ("holdout", "h"), ("stress", "s")) for n, v in (("ok", "ok::INT"), ("sh", "sharpe"), ("dd", "mdd"), ("tr", "trades"), ("to", "turnover_mean"), ("ex", "exposure"), ("ab", "active_bars")))
STAGE1 = f"""WITH {X.positions_sql()}, {Z_SQL}, {X.slices_sql(_ST)}, {X.metrics_sql()}, {META_SQL}, {WF_SQL},
pv AS (SELECT gid, {_PIV} FROM m JOIN mt USING (gid, sid) GROUP BY gid),
g1 AS (SELECT pv.* REPLACE (t_ok = 1 AS t_ok, h_ok = 1 AS h_ok, s_ok = 1 AS s_ok), wf.positive_segments, wf.dominance, wf.usable, least(z.k, z.n - 1) AS tn, z.n - 1 - z.k AS hn FROM pv JOIN wf ON wf.gid = pv.gid AND wf.sid = 'train', z),
g2 AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{n}'" for n, c in _CHECKS)} END AS reject_reason,
  0.55 * h_sh + 0.25 * t_sh + 0.10 * coalesce(s_sh, h_sh) - 0.20 * greatest(0.0, t_sh - h_sh) - 0.15 * abs(h_dd) - 0.05 * h_to - 0.10 * greatest(0.0, abs(dominance) - 0.65) AS soft FROM g1)"""


def _stage1(spark, d):
    return gates.stage1(_positions(spark, d), _sizes(spark, d), X.genomes(spark), X.CONFIG, X.BAR_SECONDS)


@query(f"{STAGE1} SELECT CAST(gid AS BIGINT) AS genome_id, reject_reason FROM g2")
def gate_reasons(spark, d):
    return _stage1(spark, d).select("genome_id", "reject_reason")


# Every gate: its code, its column, a value that passes and one that fails, and the same check in SQL over x.
_CHAIN = [
    ("batch_train_too_short", "n_train", "5000", "4999", "x < 5000"), ("batch_holdout_too_short", "n_holdout", "1500", "1499", "x < 1500"), ("fail_type", "type", f"'{signal.TYPE}'", "'other'", f"x <> '{signal.TYPE}'"),
    ("fail_train_metrics_error", "train_error", "CAST(NULL AS STRING)", "'too_few_bars'", "x IS NOT NULL"), ("fail_train_exposure", "train_exposure", "0.02D", "0.0199D", "x < 0.02"), ("fail_train_active_bars", "train_active_bars", "300", "299", "x < 300"),
    ("fail_train_trades", "train_trades", "60", "59", "x < 60"), ("fail_train_turnover", "train_turnover_mean", "1.2D", "1.21D", "x > 1.2"), ("fail_train_mdd", "train_max_drawdown", "-0.75D", "-0.76D", "abs(x) > 0.75"), ("fail_train_sharpe", "train_sharpe", "0.25D", "0.24D", "x < 0.25"),
    ("fail_train_wf_error", "wf_usable", "1", "0", "x = 0"), ("fail_train_wf_pos_segments", "wf_positive_segments", "2", "1", "x < 2"), ("fail_train_wf_dominance", "wf_dominance", "-0.85D", "-0.86D", "abs(x) > 0.85"),
    ("fail_holdout_metrics_error", "holdout_error", "CAST(NULL AS STRING)", "'too_few_bars'", "x IS NOT NULL"), ("fail_holdout_exposure", "holdout_exposure", "0.01D", "0.0099D", "x < 0.01"), ("fail_holdout_active_bars", "holdout_active_bars", "80", "79", "x < 80"),
    ("fail_holdout_trades", "holdout_trades", "10", "9", "x < 10"), ("fail_holdout_turnover", "holdout_turnover_mean", "1.5D", "1.51D", "x > 1.5"), ("fail_holdout_mdd", "holdout_max_drawdown", "-0.75D", "-0.76D", "abs(x) > 0.75"), ("fail_holdout_sharpe", "holdout_sharpe", "0.05D", "0.04D", "x < 0.05"),
    ("fail_holdout_stress_metrics_error", "stress_error", "CAST(NULL AS STRING)", "'too_few_bars'", "x IS NOT NULL"), ("fail_holdout_stress_sharpe", "stress_sharpe", "0.0D", "-0.01D", "x < 0.0"),
    ("fail_cv_pos_folds", "cv_positive_folds", "3", "2", "x < greatest(1, least(5, ceil(5 * 0.6 - 1e-12)))"), ("fail_cv_min_sharpe", "cv_min_sharpe", "-0.2D", "-0.21D", "x < -0.2"), ("fail_cv_med_sharpe", "cv_median_sharpe", "0.2D", "0.19D", "x < 0.2"),
    ("fail_cv_med_delay1", "cv_median_sharpe_delay", "0.1D", "0.09D", "x < 0.1"), ("fail_cv_med_cost", "cv_median_sharpe_cost", "0.05D", "0.04D", "x < 0.05"), ("fail_cv_min_delay1", "cv_min_sharpe_delay", "-0.1D", "-0.11D", "x < -0.1"),
    ("fail_cv_min_cost", "cv_min_sharpe_cost", "-0.1D", "-0.11D", "x < -0.1"), ("fail_cv_pos_cost_folds", "cv_positive_folds_cost", "3", "2", "x < greatest(1, least(5, ceil(5 * 0.6 - 1e-12)))"),
]
# Of order k's values the one of gate k % 31 fails, and of later gates some more.
_CHAIN_BAD = [f"(k % 31 = {j} OR (k % 31 < {j} AND (k * 7 + {j}) % 3 = 0))" for j in range(len(_CHAIN))]


def _chain_sql() -> str:
    plain = lambda v: v.removesuffix("D").replace("STRING", "VARCHAR")
    columns = ", ".join(f"CASE WHEN {bad} THEN {plain(no)} ELSE {plain(yes)} END AS {name}" for (_, name, yes, no, _), bad in zip(_CHAIN, _CHAIN_BAD, strict=True))
    cases = " ".join(f"WHEN {check.replace('x ', name + ' ', 1) if check.startswith('x') else check.replace('(x)', f'({name})')} THEN '{code}'" for code, name, _, _, check in _CHAIN)
    return f"WITH v AS (SELECT k, {columns} FROM (SELECT o_orderkey AS k FROM orders)) SELECT k AS genome_id, CASE {cases} END AS reject_reason FROM v"


@query(_chain_sql())
def gate_chain(spark, d):
    """All gates in order over values spread by a key, each at its threshold or just beyond."""
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(5).alias("cv_folds"))
    rows = rows.withColumns({name: F.expr(f"CASE WHEN {bad} THEN {no} ELSE {yes} END") for (_, name, yes, no, _), bad in zip(_CHAIN, _CHAIN_BAD, strict=True)})
    chain = [*gates.stage1_checks(X.CONFIG), *gates.stage2_checks(X.CONFIG)]
    return rows.select(F.col("k").alias("genome_id"), gates.first_failure(chain).alias("reject_reason"))


@query(f"{STAGE1} SELECT reject_reason, count(*) AS n FROM g2 WHERE reject_reason IS NOT NULL GROUP BY 1")
def reject_counts(spark, d):
    return gates.reject_counts(_stage1(spark, d))



@query(f"{STAGE1} SELECT CAST(gid AS BIGINT) AS genome_id, {rs('soft', 'soft_score', 5)} FROM g2")
def soft_score(spark, d):
    rows = _stage1(spark, d).withColumn("s", gates.soft_score())
    return rows.select("genome_id", r("s", "soft_score", 5))


@query(f"""{STAGE1}, e AS (SELECT gid, soft, row_number() OVER (ORDER BY soft DESC, gid) AS rank, count(*) OVER () AS n FROM (SELECT gid, soft, 'x' AS reason FROM g2))
SELECT CAST(gid AS BIGINT) AS genome_id, CAST(rank AS INTEGER) AS rank, {rs('soft', 'soft_score', 5)} FROM e WHERE rank <= greatest(2, least(8, ceil(n * 0.06)))""")
def elite_topk(spark, d):
    """The elite rule over all genomes of the fixture, as if each were a near miss."""
    rows = _stage1(spark, d).withColumns({"soft_score": gates.soft_score(), "reject_reason": F.lit("x")})
    return gates.elite_updates(rows).select("genome_id", F.col("rank").cast("int").alias("rank"), r("soft_score", digits=5))


SCORE_SQL = """WITH s(genome_id, cv_median_sharpe, cv_min_sharpe, cv_std_sharpe, cv_median_sharpe_delay, cv_median_sharpe_cost, cv_positive_folds, cv_folds, train_sharpe, holdout_sharpe, stress_sharpe, holdout_max_drawdown, train_turnover_mean, wf_dominance, regime_coverage, regime_dominance, regime_worst_sharpe)
AS (SELECT o_orderkey, (o_orderkey % 7) / 3.0 - 0.5, (o_orderkey % 5) / 4.0 - 0.4, (o_orderkey % 3) / 5.0, (o_orderkey % 11) / 6.0 - 0.3, (o_orderkey % 13) / 9.0 - 0.2, o_orderkey % 6, 5, (o_orderkey % 17) / 5.0, (o_orderkey % 19) / 7.0 - 0.5, (o_orderkey % 23) / 11.0 - 0.4, -((o_orderkey % 29) / 40.0), (o_orderkey % 31) / 30.0, (o_orderkey % 37) / 25.0 - 0.3, o_orderkey % 10, (o_orderkey % 41) / 41.0, (o_orderkey % 43) / 20.0 - 1.0 FROM orders)
SELECT genome_id, round((0.55 * cv_median_sharpe + 0.22 * cv_min_sharpe + 0.10 * cv_median_sharpe_delay + 0.08 * cv_median_sharpe_cost + 0.05 * stress_sharpe + 0.04 * holdout_sharpe) * (0.85 + 0.15 * cv_positive_folds / cv_folds)
 - 0.22 * cv_std_sharpe - 0.22 * greatest(0.0, train_sharpe - holdout_sharpe) - 0.12 * abs(holdout_max_drawdown) - 0.05 * train_turnover_mean - 0.12 * greatest(0.0, abs(wf_dominance) - 0.60)
 + 0.10 * regime_coverage / 9.0 - 0.25 * greatest(0.0, regime_dominance - 0.55) - 0.08 * greatest(0.0, -regime_worst_sharpe - 0.20), 6) AS score FROM s""".replace("/ 3.0", "/ CAST(3.0 AS DOUBLE)")


@query(None)
def evaluate_generation(spark, d):
    """Both passes over the fixed genomes: gates, cross-validation, regimes and score.  Bars, positions and the first pass are written, as all later steps read them."""
    written = search.writer(spark, "evaluation")
    rows = gates.evaluate(written(_ticks(spark, d), "bars"), X.genomes(spark), signal.needed(X.as_dicts()), X.CONFIG, X.BAR_SECONDS, written)
    return rows.select("genome_id", "reject_reason", "pass_flags", r("score"))


def _spread(key: str) -> dict[str, Column]:
    k = F.col(key)
    m = lambda n: (k % n).cast("double")
    return {
        "cv_median_sharpe": m(7) / 3.0 - 0.5, "cv_min_sharpe": m(5) / 4.0 - 0.4, "cv_std_sharpe": m(3) / 5.0, "cv_median_sharpe_delay": m(11) / 6.0 - 0.3, "cv_median_sharpe_cost": m(13) / 9.0 - 0.2,
        "cv_positive_folds": k % 6, "cv_folds": F.lit(5), "train_sharpe": m(17) / 5.0, "holdout_sharpe": m(19) / 7.0 - 0.5, "stress_sharpe": m(23) / 11.0 - 0.4, "holdout_max_drawdown": -(m(29) / 40.0),
        "train_turnover_mean": m(31) / 30.0, "wf_dominance": m(37) / 25.0 - 0.3, "regime_coverage": k % 10, "regime_dominance": m(41) / 41.0, "regime_worst_sharpe": m(43) / 20.0 - 1.0,
    }


@query(SCORE_SQL)
def score_v4(spark, d):
    """The score formula over values spread by a key."""
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("genome_id")).withColumns(_spread("genome_id"))
    return rows.select("genome_id", r(gates.full_score(), "score"))


# ---------------------------------------------------------------- store

_STORE_SQL = """st AS (SELECT 'h' || (o_orderkey % 200) AS strategy_hash, 'd' || (o_custkey % 3) AS dataset_id, 'e' || (o_orderkey % 4) AS eval_id, o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%d') AS created_utc, 'r' || o_orderkey AS run_id, round(o_totalprice / 1000, 3) AS score FROM orders)"""


def _store_rows(spark, d) -> DataFrame:
    o = _table(spark, d, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        F.concat(F.lit("h"), k % 200).alias("strategy_hash"), F.concat(F.lit("d"), F.col("o_custkey") % 3).alias("dataset_id"), F.concat(F.lit("e"), k % 4).alias("eval_id"), k.alias("seq"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_utc"), F.concat(F.lit("r"), k).alias("run_id"), F.lit("{}").alias("genome_json"),
        F.format_string('{"cv":{"median_sharpe":%d}}', k % 10).alias("metrics_json"), F.lit("train").alias("pass_flags"), F.round(F.col("o_totalprice") / 1000, 3).alias("score"),
    )
    more = {m: (k % 3 if m.startswith("trades") else F.col("score")) for m in store.METRICS[1:]}
    return rows.withColumns({m: (F.col("seq") % 3).cast("bigint") if m.startswith("trades") else F.col("score") for m in more})


def _condensed(spark, d) -> DataFrame:
    return store.condensed(_store_rows(spark, d))


@query(f"""WITH {_STORE_SQL}, a AS (SELECT * FROM st WHERE seq % 3 <> 0), b AS (SELECT * FROM st WHERE seq % 3 = 0),
ca AS (SELECT strategy_hash, dataset_id, eval_id, arg_max(run_id, seq) AS run_id, arg_max(created_utc, seq) AS created_utc, max(score) AS score, first(seq % 3 ORDER BY score DESC, seq) AS trades FROM a GROUP BY 1, 2, 3),
cb AS (SELECT strategy_hash, dataset_id, eval_id, arg_max(run_id, seq) AS run_id, arg_max(created_utc, seq) AS created_utc, max(score) AS score, first(seq % 3 ORDER BY score DESC, seq) AS trades FROM b GROUP BY 1, 2, 3),
j AS (SELECT strategy_hash, dataset_id, eval_id, coalesce(cb.run_id, ca.run_id) AS run_id, coalesce(cb.created_utc, ca.created_utc) AS created_utc, ca.score IS NULL OR coalesce(cb.score > ca.score, FALSE) AS b, ca.score AS sa, cb.score AS sb, ca.trades AS ta, cb.trades AS tb FROM ca FULL OUTER JOIN cb USING (strategy_hash, dataset_id, eval_id))
SELECT strategy_hash, dataset_id, eval_id, run_id, created_utc, '{{}}' AS genome_json, 'train' AS pass_flags, CASE WHEN b THEN sb ELSE sa END AS score, CASE WHEN b THEN sb ELSE sa END AS sharpe_train, CASE WHEN b THEN sb ELSE sa END AS turnover_holdout,
CAST(CASE WHEN b THEN tb ELSE ta END AS BIGINT) AS trades_train, CAST(CASE WHEN b THEN tb ELSE ta END AS BIGINT) AS trades_holdout FROM j""")
def upsert_merge(spark, d):
    rows = _store_rows(spark, d)
    out = store.merged(store.condensed(rows.where(F.col("seq") % 3 != 0)), rows.where(F.col("seq") % 3 == 0))
    return out.select(*store.KEY, "run_id", "created_utc", "genome_json", "pass_flags", "score", "sharpe_train", "turnover_holdout", "trades_train", "trades_holdout")


@query(f"WITH {_STORE_SQL} SELECT eval_id, max(created_utc) AS latest FROM st WHERE dataset_id = 'd1' GROUP BY 1 ORDER BY latest DESC, eval_id LIMIT 1")
def latest_eval(spark, d):
    return store.latest_eval(_store_rows(spark, d), "d1")


@query(f"WITH {_STORE_SQL}, c AS (SELECT strategy_hash, dataset_id, eval_id, max(score) AS score, max(seq) AS seq FROM st GROUP BY 1, 2, 3) SELECT CAST(row_number() OVER (ORDER BY score DESC, strategy_hash) AS INTEGER) AS rank, strategy_hash, score, CAST(seq % 10 AS DOUBLE) AS cv_med FROM c WHERE dataset_id = 'd1' AND eval_id = 'e2' ORDER BY score DESC, strategy_hash LIMIT 10")
def top_strategies(spark, d):
    return store.top(_condensed(spark, d), "d1", 10, "e2").select("rank", "strategy_hash", "score", "cv_med")


@query(f"WITH {_STORE_SQL} SELECT strategy_hash, dataset_id, eval_id FROM st WHERE dataset_id = 'd1' AND eval_id = 'e2' AND strategy_hash = 'h2' GROUP BY ALL")
def strategy_lookup(spark, d):
    return store.lookup(_condensed(spark, d), "d1", "e2", "h2").select(*store.KEY)


@query("""WITH o AS (SELECT 'h' || o_orderkey AS strategy_hash, 'd' AS dataset_id, o_totalprice AS sharpe FROM orders), cur AS (SELECT * FROM o WHERE CAST(substr(strategy_hash, 2) AS BIGINT) % 2 = 0)
SELECT strategy_hash, 'legacy_v1' AS eval_id, round(CASE WHEN CAST(substr(strategy_hash, 2) AS BIGINT) % 2 = 0 THEN -1.0 ELSE sharpe END, 4) AS sharpe_train, round(CASE WHEN CAST(substr(strategy_hash, 2) AS BIGINT) % 2 = 0 THEN -1.0 ELSE sharpe END, 4) AS sharpe_holdout FROM o""")
def migrate_legacy(spark, d):
    o = _table(spark, d, "orders")
    old = o.select(F.concat(F.lit("h"), F.col("o_orderkey")).alias("strategy_hash"), F.lit("d").alias("dataset_id"), *[F.lit("x").alias(c) for c in store.ALWAYS], F.lit(0.0).alias("score"), F.col("o_totalprice").alias("sharpe"), F.lit(0.0).alias("calmar"), F.lit(0.0).alias("max_drawdown"), F.lit(1).cast("bigint").alias("trades"), F.lit(0.0).alias("turnover"), F.lit(0.0).alias("exposure"), "o_orderkey")
    here = old.where(F.col("o_orderkey") % 2 == 0).select("strategy_hash", "dataset_id", F.lit("legacy_v1").alias("eval_id"), *store.ALWAYS, "score", *[(F.lit(1).cast("bigint") if m.startswith("trades") else F.lit(-1.0)).alias(m) for m in store.METRICS[1:]])
    return store.migrated(old.drop("o_orderkey"), here).select("strategy_hash", "eval_id", r("sharpe_train", digits=4), r("sharpe_holdout", digits=4))


# ---------------------------------------------------------------- search


@query("""SELECT min(o_orderkey) AS genome_id, CAST(o_custkey AS BIGINT) AS customer FROM orders
WHERE o_custkey % 97 NOT IN (SELECT c_custkey % 97 FROM customer WHERE c_custkey % 97 < 40) GROUP BY o_custkey""")
def seen_dedupe(spark, d):
    """Genomes that differ by customer only, less those seen: of customers whose key modulo 97 is below 40."""

    def genome(key):
        part = F.struct(F.lit("mr_z").alias("name"), key.cast("int").alias("window"), F.lit(1.0).alias("weight"))
        return F.struct(F.lit(signal.TYPE).alias("type"), F.array(part).alias("features"), F.lit(0.5).alias("threshold"), F.struct(F.lit("any").alias("mode"), F.lit(80).alias("window")).alias("vol_gate")).alias("genome")

    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("genome_id"), genome(F.col("o_custkey")))
    known = rows.where(F.col("genome.features")[0]["window"] % 97 < 40).select(G.fingerprint(F.col("genome")).alias("fp"))
    return G.unseen(rows, known.distinct()).select("genome_id", F.col("genome.features")[0]["window"].cast("bigint").alias("customer"))


@query("WITH m(workers, rate) AS (SELECT l_linenumber, sum(l_quantity) FROM lineitem GROUP BY 1) SELECT CAST(min(workers) AS INTEGER) AS workers FROM m WHERE rate >= 0.97 * (SELECT max(rate) FROM m)")
def near_peak_workers(spark, d):
    from barloom.operators.host import near_peak

    m = _table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("workers")).agg(F.sum("l_quantity").alias("rate"))
    return near_peak(m)


@query()
def genome_random(spark, d):
    return G.random_genomes(spark, 200, 7)


@query()
def genome_mutate(spark, d):
    return G.mutate(G.random_genomes(spark, 200, 7), 8)


@query()
def genome_crossover(spark, d):
    a = G.random_genomes(spark, 200, 7).withColumnRenamed("genome", "a")
    b = G.random_genomes(spark, 200, 9).withColumnRenamed("genome", "b")
    return G.crossover(a.join(b, "genome_id"), 10)


@query()
def genome_hash(spark, d):
    from barloom.functions.canonical import genome_hash_column

    return X.genomes(spark).select("genome_id", genome_hash_column(F.col("genome")).alias("strategy_hash"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Backtest metrics of the fixed genomes."""
    return metrics_from_pnl(spark, d)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
