"""Fixed genomes and configurations of the registered queries, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.config import Costs, EvalConfig
from barloom.operators.signal import GENOME, TYPE

#: Literal spacing of the tick bars, for annualisation.
BAR_SECONDS = 86400
COSTS = Costs()
CONFIG = EvalConfig()

#: (id, parts, threshold, gate) (fixed values).
GENOMES = [
    (0, [("mr_z", 20, 1.0), ("mom_ir", 5, -0.5)], 0.5, ("any", 80)),
    (1, [("mr_z", 20, -1.0), ("volu_z", 10, 0.3)], 0.5, ("any", 80)),
    (2, [("mr_z", 80, 0.5), ("vol_s", 40, 0.5)], 1.4, ("high", 40)),
    (3, [("vol_s", 320, 0.1), ("volu_z", 320, 0.01)], 1.5, ("any", 160)),
    (4, [("mr_z", 5, 2.0), ("mom_ir", 10, -1.0), ("volu_z", 20, 0.4)], 0.2, ("low", 80)),
    (5, [("volu_z", 40, 1.5), ("vol_s", 160, 1.0)], 0.9, ("any", 40)),
    (6, [("mr_z", 40, 0.3), ("volu_z", 40, 0.3)], 1.2, ("any", 40)),
]


def as_dicts(ids=None) -> list[dict]:
    return [
        {"type": TYPE, "features": [{"name": n, "window": w, "weight": x} for n, w, x in parts], "threshold": thr, "vol_gate": {"mode": mode, "window": gw}}
        for i, parts, thr, (mode, gw) in GENOMES
        if ids is None or i in ids
    ]


def genomes(spark: SparkSession, ids=None) -> DataFrame:
    own = [i for i, *_ in GENOMES if ids is None or i in ids]
    return spark.createDataFrame(list(zip(own, as_dicts(ids), strict=True)), f"genome_id long, genome {GENOME}")


# SQL of the same definitions, for DuckDB.

BARS = """bars AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS t, ts, CAST(1000 + value / 10 AS FLOAT) AS close, CAST(user_id AS FLOAT) AS volume FROM events),
inp AS (SELECT t, ts, close, CAST(close AS DOUBLE) AS c, CAST(volume AS DOUBLE) AS v, CAST(close AS DOUBLE) / lag(CAST(close AS DOUBLE)) OVER (ORDER BY t) - 1 AS r FROM bars)"""


def _frame(w: int) -> str:
    return f"OVER (ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def mean_sql(x: str, w: int) -> str:
    return f"CASE WHEN count({x}) {_frame(w)} = {w} THEN avg({x}) {_frame(w)} END"


def std_sql(x: str, w: int) -> str:
    return f"CASE WHEN count({x}) {_frame(w)} = {w} THEN stddev_pop({x}) {_frame(w)} END"


def clip_sql(x: str, c: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(CAST(-{c} AS DOUBLE), least(CAST({c} AS DOUBLE), {x})) END"


def feature_sql(name: str, w: int) -> str:
    """Of table inp; vol_s as the plain deviation."""
    if name == "mom_ir":
        x = clip_sql(f"({mean_sql('r', w)}) / (({std_sql('r', w)}) + 1e-12)", 6)
    elif name == "mr_z":
        x = clip_sql(f"-(c - ({mean_sql('c', w)})) / (({std_sql('c', w)}) + 1e-12)", 6)
    elif name == "volu_z":
        x = clip_sql(f"(v - ({mean_sql('v', w)})) / (({std_sql('v', w)}) + 1e-12)", 6)
    else:
        return std_sql("r", w)
    return f"CAST({x} AS FLOAT)"


def features_sql(wanted: list[tuple[str, int]], more: str = "") -> str:
    """WITH-list that ends in table f: inp and the features; needs BARS before."""
    raw = ", ".join(f"{feature_sql(n, w)} AS {n}_{w}" for n, w in wanted)
    vols = [w for n, w in wanted if n == "vol_s"]
    out = f"f0 AS (SELECT *, {raw}{', ' + more if more else ''} FROM inp)"
    if not vols:
        return out + ", f AS (SELECT * FROM f0)"
    medians = ", ".join(f"median(CASE WHEN vol_s_{w} > 0 THEN vol_s_{w} END) AS m_{w}" for w in vols)
    cols = ", ".join(f"CAST({clip_sql(f'vol_s_{w} / coalesce(CASE WHEN m_{w} > 1e-12 THEN m_{w} END, 1.0) - 1', 8)} AS FLOAT) AS vol_s_{w}" for w in vols)
    drop = ", ".join(f"vol_s_{w}" for w in vols)
    return out + f", med AS (SELECT {medians} FROM f0), f AS (SELECT f0.* EXCLUDE ({drop}), {cols} FROM f0, med)"


def positions_sql(ids=None) -> str:
    """WITH-list that ends in table p: (gid, t, c, alpha, pos)."""
    own = [g for g in GENOMES if ids is None or g[0] in ids]
    wanted = sorted({(n, w) for _, parts, _, _ in own for n, w, _ in parts} | {("vol_s", gate[1]) for *_, gate in own})
    unions = []
    for i, parts, thr, (mode, gw) in own:
        alpha = " + ".join(["CAST(0 AS FLOAT)"] + [f"CAST({x} AS FLOAT) * {n}_{w}" for n, w, x in parts])
        gate = {"any": "TRUE", "high": f"coalesce(vol_s_{gw} > 0, FALSE)", "low": f"coalesce(vol_s_{gw} < 0, FALSE)"}[mode]
        unions.append(f"SELECT {i} AS gid, t, c, {alpha} AS alpha, {gate} AS open_, CAST({thr} AS FLOAT) AS thr FROM f")
    return f"{BARS}, {features_sql(wanted)}, a AS ({' UNION ALL '.join(unions)}), p AS (SELECT gid, t, c, alpha, CASE WHEN open_ AND alpha > thr THEN 1 WHEN open_ AND alpha < -thr THEN -1 ELSE 0 END AS pos FROM a)"


def slices_sql(rows: str) -> str:
    """Table s from SELECTs of (sid, lo, hi, delay, mult[, gid]); then table q: pnl per slice."""
    rate = COSTS.rate
    return f"""s AS ({rows}),
q0 AS (SELECT p.gid, s.sid, p.t, p.c, s.lo, s.hi, s.delay, s.mult, p.pos AS pos0 FROM p JOIN s ON p.t BETWEEN s.lo AND s.hi AND (s.gid IS NULL OR s.gid = p.gid)),
q1 AS (SELECT *, CASE WHEN delay = 0 THEN pos0 ELSE coalesce(lag(pos0, delay) OVER (PARTITION BY gid, sid ORDER BY t), 0) END AS pos, lead(c) OVER (PARTITION BY gid, sid ORDER BY t) / c - 1 AS ret FROM q0),
q2 AS (SELECT *, CAST(abs(pos - coalesce(lag(pos) OVER (PARTITION BY gid, sid ORDER BY t), 0)) AS DOUBLE) AS turnover FROM q1),
q AS (SELECT *, CASE WHEN t < hi THEN pos * ret - {rate} * mult * turnover END AS pnl FROM q2)"""


def metrics_sql(src: str = "q", keys: str = "gid, sid", out: str = "m", min_bars: int = 5, where: str = "TRUE") -> str:
    """Tables {out}0.. to {out}: metrics per keys of table src."""
    ann = 365.25 * 86400 / BAR_SECONDS
    return f"""{out}0 AS (SELECT *, product(1 + pnl) OVER (PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING) AS eq FROM {src} WHERE pnl IS NOT NULL AND {where}),
{out}1 AS (SELECT *, eq / greatest(1.0, max(eq) OVER (PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM {out}0),
{out}2 AS (SELECT {keys}, count(*) AS bars, avg(pnl) AS mu, stddev_samp(pnl) AS sd, sum(pnl) AS pnl_sum, arg_max(eq, t) AS fin, least(0.0, min(dd)) AS mdd FROM {out}1 GROUP BY {keys}),
{out} AS (SELECT {keys}, bars, pnl_sum, mu, sd, mdd, fin, bars >= {max(5, min_bars)} AS ok,
  CASE WHEN sd > 1e-12 THEN sqrt(CAST({ann} AS DOUBLE)) * mu / sd ELSE 0.0 END AS sharpe, fin - 1 AS total_return,
  CASE WHEN fin > 0 THEN ln(fin) END AS log_equity,
  CASE WHEN fin > 0 THEN exp(least(700.0, ln(fin) * {ann} / bars)) - 1 ELSE 0.0 END AS cagr FROM {out}2)"""


def calmar_sql(floor: float = 0.02, cap: float = 25.0) -> str:
    return f"greatest(-{cap}, least({cap}, CASE WHEN cagr > 1e300 THEN 0.0 ELSE cagr / greatest(abs(mdd), {floor}) END))"
