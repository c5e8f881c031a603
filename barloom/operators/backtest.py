"""Backtests over slices of positions.

A slice is a range of positions (lo to hi, both included) of one series, with a delay and a cost
multiplier.  Its returns are those of all its positions but the last.  Every slice starts flat, so its
first position is charged in full; the last position is counted in turnover but not charged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Costs
from barloom.functions.scalar import annual_factor, safe_div
from barloom.operators import compound

SLICE = "slice_id string, lo long, hi long, delay int, cost_mult double"


def sliced(pos: DataFrame, slices: DataFrame, on: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Positions of every slice that holds them; a few rows of slices per series or genome."""
    s = slices.select(*[F.col(c).alias(f"_{c}") for c in on], "slice_id", "lo", "hi", "delay", "cost_mult")
    inside = (F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi"))
    for c in on:
        inside = inside & (F.col(c) == F.col(f"_{c}"))
    return pos.join(F.broadcast(s), inside).drop(*[f"_{c}" for c in on])


KEYS = ("series_id", "genome_id", "slice_id")


def pnl(rows: DataFrame, costs: Costs, keys: tuple[str, ...] = KEYS, delays: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Sliced positions with ret, their delayed position, turnover and pnl (null on a slice's last bar).

    ``delays`` names the delays of the slices; a slice with any other fails, as would one below 0.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    close = F.col("close").cast("double")
    # The delay is a column; each delay in use is a lag of its own over the one window.
    later = F.when(F.col("delay") == 0, F.col("pos"))
    for d in sorted({int(x) for x in delays} - {0}):
        if d < 0:
            raise ValueError(f"a delay can't be negative: {d}")
        later = later.when(F.col("delay") == d, F.lag("pos", d, 0).over(w))
    later = later.otherwise(F.raise_error(F.concat(F.lit("a slice has a delay that was not named: "), F.col("delay").cast("string"))).cast("int"))
    rows = rows.withColumns({"pos": later, "ret": safe_div(F.lead(close).over(w), close) - 1})
    rows = rows.withColumn("turnover", F.abs(F.col("pos") - F.lag("pos", 1, 0).over(w)).cast("double"))
    return rows.withColumn("pnl", net(costs, F.col("cost_mult")))


def net(costs: Costs, cost_mult: Column) -> Column:
    """Return of a position less its costs, null on a slice's last bar."""
    charge = F.lit(costs.rate) * cost_mult * F.col("turnover")
    return F.when(F.col("t") < F.col("hi"), F.col("pos") * F.col("ret") - charge)


def trade_meta(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Turnover and trades over all positions, active bars and exposure over those with a return."""
    held = F.when(F.col("t") < F.col("hi"), (F.col("pos") != 0).cast("double"))
    return rows.groupBy(*keys).agg(
        F.sum("turnover").alias("turnover_sum"), F.avg("turnover").alias("turnover_mean"), F.sum((F.col("turnover") > 0).cast("long")).alias("trades"),
        F.sum(held).cast("long").alias("active_bars"), F.avg(held).alias("exposure"),
    )


#: Returns are compounded in a tree of the fan-out of ``compound``; a block has two levels of it, and above blocks there are so many more.
FAN, LEVELS = compound.FAN, 6


def _running(first: Column, values: Column, step) -> Column:
    """``first`` and what ``step`` makes of the value before and each of (few) ``values``."""
    return F.aggregate(values, F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))


def _before(blocks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds _upto, the product of all blocks so far, from _node, that of a whole block (null for a partial last one)."""
    at = [f"_c{k}" for k in range(LEVELS, 0, -1)]
    blocks = blocks.withColumns({f"_c{k}": F.floor(F.col("_b") / FAN**k) for k in range(1, LEVELS + 1)})
    # Every window has the one order (keys, at, _b), so that there is one sort.
    over = lambda k: Window.partitionBy(*keys, *at[: LEVELS + 1 - k]).orderBy(*at[LEVELS + 1 - k :], "_b")
    run = lambda x, k: F.product(x).over(over(k).rowsBetween(Window.unboundedPreceding, 0))
    ends = lambda k: (F.col("_b") + 1) % FAN**k == 0
    for k in range(1, LEVELS + 1):
        blocks = blocks.withColumn("_run", run(F.col(f"_u{k - 1}") if k > 1 else F.col("_node"), k)).withColumn(f"_u{k}", F.when(ends(k), F.col("_run")))
    blocks = blocks.withColumn("_upto", F.coalesce(run(F.col(f"_u{LEVELS}"), LEVELS + 1), F.lit(1.0)))
    for k in range(LEVELS - 1, -1, -1):
        node = F.col(f"_u{k}") if k else F.col("_node")
        first = F.floor((F.col("_b") + 1) / FAN**k) % FAN == 1
        next_ = F.when(~ends(k + 1), F.when(first, F.col("_upto") * node).otherwise(node))
        blocks = blocks.withColumn("_run", run(next_, k + 1)).withColumn("_upto", F.when(ends(k + 1), F.col("_upto")).otherwise(F.coalesce("_run", "_upto")))
    order = over(LEVELS + 1)
    return blocks.withColumn("_from", F.lag("_upto", 1, 1.0).over(order)).drop("_run", *at, *[f"_u{k}" for k in range(1, LEVELS + 1)])


def equity(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows with a pnl, their equity from 1 and the drop from its peak so far.

    Growth is multiplied in a tree: rows in order up to each ``FAN`` of them, these up to each ``FAN``
    again, and so on; an equity is the product of the largest whole nodes before it, the larger first.
    So rounding grows with the depth only, and long losses go to 0 where one product after another
    stays at the smallest numbers above it.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    rows = rows.where(F.col("pnl").isNotNull())
    names = [c for c in rows.columns if c not in keys]
    rows = rows.withColumn("_j", (F.row_number().over(w) - 1).cast("long"))
    block = F.floor(F.col("_j") / FAN**2).alias("_b")
    out = rows.groupBy(*keys, block).agg(F.sort_array(F.collect_list(F.struct("_j", *names))).alias("_rows"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / FAN).cast("int")), lambda i: F.transform(F.slice("_rows", i * FAN + 1, F.lit(FAN)), lambda x: F.lit(1.0) + x["pnl"]))
    times = lambda x, y: x * y
    out = out.withColumn("_parts", parts).withColumn("_nodes", F.transform("_parts", lambda g: F.aggregate(g, F.lit(1.0), times)))
    out = _before(out.withColumn("_node", F.when(F.size("_rows") == FAN**2, F.aggregate("_nodes", F.lit(1.0), times))), keys)
    out = out.withColumn("_starts", _running(F.col("_from"), F.col("_nodes"), times))
    last = lambda i: F.when(i == FAN - 1, F.col("_upto")).otherwise(F.get("_starts", i + 1))
    along = lambda g, i: F.concat(F.slice(_running(F.get("_starts", i), F.slice(g, 1, FAN - 1), times), 2, FAN - 1), F.when(F.size(g) == FAN, F.array(last(i))).otherwise(F.array().cast("array<double>")))
    out = out.withColumn("_eq", F.transform("_parts", along)).withColumn("_tops", F.transform("_eq", F.array_max))
    order = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_top", F.max(F.array_max("_tops")).over(order)).withColumn("_peaks", _running(F.greatest(F.lit(1.0), "_top"), F.col("_tops"), F.greatest))
    peaks = F.flatten(F.transform("_eq", lambda g, i: F.slice(_running(F.get("_peaks", i), g, F.greatest), 2, FAN)))
    out = out.select(*keys, F.explode(F.arrays_zip("_rows", F.flatten("_eq").alias("equity"), peaks.alias("peak"))).alias("_x"))
    out = out.select(*keys, *[F.col(f"_x._rows.{c}").alias(c) for c in names], F.col("_x.equity").alias("equity"), F.col("_x.peak").alias("_peak"))
    return out.withColumn("drawdown", safe_div(F.col("equity"), F.col("_peak")) - 1).drop("_peak")


def metrics(rows: DataFrame, bar_seconds: int, keys: tuple[str, ...] = KEYS, mdd_floor: float = 0.02, calmar_cap: float = 25.0, min_bars: int = 5, values: tuple[str, ...] = ("pnl",)) -> DataFrame:
    """Per slice: error, bars, mean_bar_return, std_bar_return, sharpe, total_return, log_equity, cagr,
    max_drawdown, calmar.  Fewer bars than ``min_bars`` (5 at least) give an error and null values.

    ``values`` may name several columns of returns, null in the same rows; the column ``value`` then tells them apart.
    """
    ann = annual_factor(bar_seconds)
    rows = rows.where(F.col(values[0]).isNotNull()).select(*keys, "t", *values)
    rows = rows.withColumn("_j", F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1)
    # The window has brought each slice's rows to one task, sorted; the sort is there if a plan ever leaves them otherwise.
    rows = rows.sortWithinPartitions(*keys, "t").select(F.when(F.col("_j") == 0, F.struct(*keys)).alias("_key"), "_j", *values)
    kind = rows.schema["_key"].dataType.simpleString()
    per = rows.mapInArrow(compound.summaries(list(values)), f"_key {kind}, value string, {compound.RESULT}")
    keys = (*keys, "value") if len(values) > 1 else keys
    per = per.select("_key.*", *[c for c in per.columns if c != "_key"])
    sharpe = F.when(F.col("std_bar_return") > 1e-12, F.sqrt(F.lit(ann)) * F.col("mean_bar_return") / F.col("std_bar_return")).otherwise(F.lit(0.0))
    years = F.col("bars") / F.lit(ann)
    cagr = F.when(F.col("_end") > 0, F.pow(F.col("_end"), F.lit(1.0) / years) - 1).otherwise(F.lit(0.0))
    ratio = F.col("cagr") / F.greatest(F.abs("max_drawdown"), F.lit(mdd_floor))
    sane = F.when(ratio.isNull() | F.isnan(ratio) | (F.abs(ratio) == float("inf")), F.lit(0.0)).otherwise(ratio)
    per = per.withColumns({"sharpe": sharpe, "total_return": F.col("_end") - 1, "log_equity": F.when(F.col("_end") > 0, F.log("_end")), "cagr": cagr})
    per = per.withColumn("calmar", F.greatest(F.lit(-abs(calmar_cap)), F.least(F.lit(abs(calmar_cap)), sane)))
    enough = F.col("bars") >= max(5, min_bars)
    error = "too_few_bars" if min_bars <= 5 else "too_few_masked_bars"
    values = ("mean_bar_return", "std_bar_return", "sharpe", "total_return", "log_equity", "cagr", "max_drawdown", "calmar")
    return per.select(*keys, F.when(~enough, F.lit(error)).alias("error"), "bars", "pnl_sum", *[F.when(enough, F.col(c)).alias(c) for c in values])


def active_metrics(rows: DataFrame, bar_seconds: int, min_bars: int, keys: tuple[str, ...] = KEYS, mdd_floor: float = 0.02, calmar_cap: float = 25.0) -> DataFrame:
    """Metrics of the bars with a position only; equity compounds over just those."""
    return metrics(rows.where(F.col("pos") != 0), bar_seconds, keys, mdd_floor, calmar_cap, min_bars)
