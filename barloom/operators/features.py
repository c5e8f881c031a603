"""Rolling-window features.

A series is cut into blocks along time and every block gets the last bars of the one before as a halo,
so windows run on (series, block) and one long series uses the whole cluster.  Within a block running
sums of the inputs (less the block's first value, which keeps them small) are taken once; the moments
of any window are then differences of two of them, whatever its width.  Returns, which may all be 0 or
nearly so in one window and not in the block, have sums in two parts: whole multiples of a small number,
which add up without rounding, and the rest.  Windows of one value have it as mean and no deviation.
All features of a call share one shuffle and one sort.  Frames hold exactly w values; before that a
feature is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import EPS, clip, safe_div

#: Bars in one block.
BLOCK = 4096
#: Inputs whose sums are kept in two parts, and the multiples in which the first parts of sums and sums of squares go.
FINE, UNITS = ("ret",), {1: 2.0**-30, 2: 2.0**-36}


def _order():
    return Window.partitionBy("series_id", "_block").orderBy("t")


def _last(total: str, w: int) -> Column:
    """Of a running sum, the part of the last w rows."""
    return F.col(total) - F.coalesce(F.lag(total, w).over(_order()), F.lit(0))


def _moment(x: str, k: int, w: int) -> Column:
    """Mean of the last w values (less the first of the block), or of their squares."""
    whole = _last(f"_{k}_{x}", w)
    return (whole + _last(f"_{k}r_{x}", w) if x in FINE else whole) / w


def rolling_mean(x: str, w: int) -> Column:
    """Mean of the last w values of input x, null until there are w; the value itself for w <= 1."""
    if w <= 1:
        return F.col(f"_{x}")
    return F.when(F.col(f"_n_{x}") >= w, F.when(F.col(f"_k_{x}") >= w, F.col(f"_{x}")).otherwise(F.col(f"_0_{x}") + _moment(x, 1, w)))


def rolling_std(x: str, w: int) -> Column:
    """Population standard deviation of the last w values; null for w <= 1."""
    if w <= 1:
        return F.lit(None).cast("double")
    mean = _moment(x, 1, w)
    return F.when(F.col(f"_n_{x}") >= w, F.when(F.col(f"_k_{x}") >= w, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), _moment(x, 2, w) - mean * mean))))


def momentum(w: int) -> Column:
    return clip(rolling_mean("ret", w) / (rolling_std("ret", w) + EPS), -6.0, 6.0)


def reversion(w: int) -> Column:
    return clip(-(F.col("_close") - rolling_mean("close", w)) / (rolling_std("close", w) + EPS), -6.0, 6.0)


def volume_score(w: int) -> Column:
    return clip((F.col("_volume") - rolling_mean("volume", w)) / (rolling_std("volume", w) + EPS), -6.0, 6.0)


def volatility(w: int) -> Column:
    """The rolling deviation of returns; ``features`` relates it to its median."""
    return rolling_std("ret", w)


#: name -> builder of the windowed expression
REGISTRY: dict[str, Callable[[int], Column]] = {"mom_ir": momentum, "mr_z": reversion, "vol_s": volatility, "volu_z": volume_score}


def column(name: str, w: int) -> str:
    return f"{name}_{w}"


def blocked(bars: DataFrame, halo: int, block: int = BLOCK) -> DataFrame:
    """``bars`` with _block and _halo; rows at the end of a block appear again before the next one."""
    block = max(block, halo + 1)
    own = F.floor(F.col("t") / block).cast("bigint")
    again = F.col("t") % block >= block - halo
    copies = F.when(again, F.array(F.struct(own.alias("b"), F.lit(False).alias("h")), F.struct((own + 1).alias("b"), F.lit(True).alias("h")))).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("h"))))
    return bars.withColumn("_c", F.explode(copies)).withColumns({"_block": F.col("_c")["b"], "_halo": F.col("_c")["h"]}).drop("_c")


def with_inputs(bars: DataFrame, halo: int, block: int = BLOCK, inputs: tuple[str, ...] = ("close", "ret", "volume")) -> DataFrame:
    """Blocked bars with close, volume and backward return as doubles, and the running sums of ``inputs``."""
    rows = blocked(bars, halo, block).withColumns({"_close": F.col("close").cast("double"), "_volume": F.col("volume").cast("double")})
    rows = rows.withColumn("_ret", safe_div(F.col("_close"), F.lag("_close").over(_order())) - 1)
    upto = _order().rowsBetween(Window.unboundedPreceding, 0)
    first = {f"_0_{x}": F.coalesce(F.first(f"_{x}", ignorenulls=True).over(upto), F.lit(0.0)) for x in inputs}
    rows = rows.withColumns(first | {f"_c_{x}": (~F.col(f"_{x}").eqNullSafe(F.lag(f"_{x}").over(_order()))) for x in inputs})
    sums = {}
    for x in inputs:
        away = F.coalesce(F.col(f"_{x}") - F.col(f"_0_{x}"), F.lit(0.0))
        # How many rows in a row have a value, and the same one.
        since = lambda c: F.col("t") - F.coalesce(F.max(F.when(c, F.col("t"))).over(upto), F.min("t").over(upto) - 1)
        sums |= {f"_n_{x}": since(F.col(f"_{x}").isNull()), f"_k_{x}": since(F.col(f"_c_{x}")) + 1}
        for k, value in ((1, away), (2, away * away)):
            whole = F.rint(value / UNITS[k]) * UNITS[k] if x in FINE else value
            sums[f"_{k}_{x}"] = F.sum(whole).over(upto)
            if x in FINE:
                sums[f"_{k}r_{x}"] = F.sum(value - whole).over(upto)
    return rows.withColumns(sums)


def quantiles(rows: DataFrame, wanted: dict[str, Column], at: list[float]) -> DataFrame:
    """(series_id, <name>, n_<name>): exact quantiles of each value, as an array, and how many aren't null.

    No buffer holds a series' values: counts of magnitudes name the few ranges that hold the ranks, and
    only distinct values of those are put in order.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), x.cast("double").alias("x")) for name, x in wanted.items()]))
    long = rows.select("series_id", each.alias("_v")).select("series_id", "_v.name", "_v.x").where(F.col("x").isNotNull())
    size = F.floor(F.least(F.log2(F.abs("x")) * 256, F.lit(float(1 << 19))))  # 0 has none
    long = long.withColumn("range", F.when(F.isnan("x"), F.lit(1 << 40)).when(F.col("x") == 0, F.lit(0)).otherwise(F.signum("x") * (size + (1 << 20))).cast("bigint"))
    key = ["series_id", "name"]
    order = Window.partitionBy(*key).orderBy("range")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ranges = long.groupBy(*key, "range").agg(F.count("*").alias("_n")).withColumns({"_to": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(*key))})
    ranges = ranges.withColumn("_at", F.array(*[(F.col("_all") - 1) * F.lit(float(p)) for p in at]))
    ranks = F.array_distinct(F.flatten(F.transform("_at", lambda p: F.array(F.floor(p), F.ceil(p)))))
    ranges = ranges.withColumn("_ranks", F.filter(ranks, lambda k: (k >= F.col("_to") - F.col("_n")) & (k < F.col("_to")))).where(F.size("_ranks") > 0)
    inside = long.join(F.broadcast(ranges.select(*key, "range", (F.col("_to") - F.col("_n")).alias("_before"), "_all", "_ranks")), [*key, "range"])
    inside = inside.groupBy(*key, "range", "x").agg(F.count("*").alias("_n"), F.first("_before").alias("_before"), F.first("_all").alias("_all"), F.first("_ranks").alias("_ranks"))
    through = Window.partitionBy(*key, "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_to", F.col("_before") + F.sum("_n").over(through))
    own = F.filter("_ranks", lambda k: (k >= F.col("_to") - F.col("_n")) & (k < F.col("_to")))
    found = inside.withColumn("_rank", F.explode(own)).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "x"))).alias("_x"), F.first("_all").alias("_all"))

    def value(p: float) -> Column:
        place = (F.col("_all") - 1) * F.lit(float(p))
        low, high = F.element_at("_x", F.floor(place)), F.element_at("_x", F.ceil(place))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    found = found.select(*key, F.array(*[value(p) for p in at]).alias("q"), F.col("_all").alias("n"))
    pick = lambda name, c: F.first(F.when(F.col("name") == name, F.col(c)), ignorenulls=True)
    per = found.groupBy("series_id").agg(*[pick(name, "q").alias(name) for name in wanted], *[F.coalesce(pick(name, "n"), F.lit(0)).alias(f"n_{name}") for name in wanted])
    return per


#: Inputs of each feature.
INPUTS = {"mom_ir": "ret", "mr_z": "close", "vol_s": "ret", "volu_z": "volume"}


def features(bars: DataFrame, wanted: list[tuple[str, int]], block: int = BLOCK, trends: list[int] | None = None) -> DataFrame:
    """``bars`` with a FLOAT column per (name, window), and mean returns ``trend_<w>`` as doubles.

    vol_s is relative to the median of its positive deviations over the whole series.
    """
    unknown = [n for n, _ in wanted if n not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    wanted, trends = list(dict.fromkeys(wanted)), trends or []
    halo = max([w for _, w in wanted] + [max(1, w) for w in trends] + [1]) + 1
    used = {INPUTS[n] for n, _ in wanted} | ({"ret"} if trends else set())
    rows = with_inputs(bars, halo, block, tuple(sorted(used)))
    rows = rows.select("*", *[REGISTRY[n](w).alias(f"_f_{column(n, w)}") for n, w in wanted], *[rolling_mean("ret", max(1, w)).alias(f"trend_{w}") for w in trends])
    rows = rows.where(~F.col("_halo"))
    vols = [column(n, w) for n, w in wanted if n == "vol_s"]
    if vols:
        raw = lambda c: F.col(f"_f_{c}")
        medians = quantiles(rows, {f"_m_{c}": F.when(raw(c) > 0, raw(c)) for c in vols}, [0.5])
        rows = rows.join(F.broadcast(medians.select("series_id", *[F.col(f"_m_{c}")[0].alias(f"_m_{c}") for c in vols])), "series_id", "left")
        for c in vols:
            median = F.coalesce(F.when(F.col(f"_m_{c}") > EPS, F.col(f"_m_{c}")), F.lit(1.0))
            rows = rows.withColumn(f"_f_{c}", clip(raw(c) / median - 1, -8.0, 8.0))
    return rows.select(*bars.columns, *[F.col(f"_f_{column(n, w)}").cast("float").alias(column(n, w)) for n, w in wanted], *[f"trend_{w}" for w in trends])


def gate(vol: Column, mode: Column) -> Column:
    """Whether a bar may trade: any (and unknown modes) always; high and low by the sign of vol_s."""
    return F.when(mode == "high", F.coalesce(vol > 0, F.lit(False))).when(mode == "low", F.coalesce(vol < 0, F.lit(False))).otherwise(F.lit(True))
