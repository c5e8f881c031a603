"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

A document's size is its number of words.  Sources in code-point order, null last, take the weights
in turn and share ``SHARE`` times all sizes; a target stops at ``MOST`` times its source's size, and
the excess goes to the others by weight until none is above.

Rates closest to 1 in relative entropy, subject to each source's token constraint and the ceiling
MOST, are exponential tilts ``least(MOST, exp(m * size / scale))`` of one multiplier per source.  The
multipliers solve the convex dual; its Newton iterations run over the counts of documents by source
and size, safeguarded by bisection.  Rates are then rounded into whole copies: systematically down
the sizes of each source, so the error stays within one document, and what remains is settled by
the smaller documents.  Documents of one source and size take their copies by the order of a hash.

Null and empty texts have size 0 and take nothing.  A null source is a source of its own.  Rows with
one id are separate documents; equal rows may take different copies, but the same on every rerun.
Texts may have any length.  Further columns are kept, those named like a result give way; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Iterations at most.  Every third halves the bracket, so this many reach double precision from any start.
ITERATIONS = 240
#: Hash buckets that the documents of one source and size are dealt into before they are ranked.
SALTS = 64

_SPACES = "[\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; null counts as empty."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, _SPACES))).cast("bigint")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(s_null, s, n, target) of sources with their sizes n.

    A source stops at its ceiling once the level L (target = weight * L) passes most * n / weight.
    In the order of that ratio the stopped sources are a prefix, so one running sum finds the level.
    """
    by_name = Window.orderBy("s_null", "s")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = totals.withColumn("w", w).withColumn("cap", F.col("n") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "s_null", "s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("n").over(Window.partitionBy()) * F.lit(share)
    level = F.greatest(F.lit(0.0), total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    rows = rows.withColumn("level", level)
    # The first source whose own ratio is not below the level there, and all after it, share that level.
    free = F.first(F.when(F.col("ratio") >= F.col("level"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(free.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * free))
    return rows.select("s_null", "s", "n", target.alias("target"))


def _rate(m: Column, most: float) -> Column:
    return F.least(F.lit(most), F.exp(F.least(F.lit(50.0), m * F.col("x"))))


def balance(counts: DataFrame, goal: DataFrame, scratch: Scratch, most: float = MOST, iterations: int = ITERATIONS) -> DataFrame:
    """(s_null, s, scale, m): each source's multiplier; counts: (s_null, s, size, docs), sizes above 0.

    The dual's gradient in m is the sum of docs * size * rate less the target: increasing, so a
    bracket always holds the root.  A Newton step that leaves the bracket becomes a bisection, and every
    third step is one.
    """
    per = counts.groupBy("s_null", "s").agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("scale"), F.min("size").alias("small"), F.max("size").alias("large"))
    state = goal.join(per, ["s_null", "s"]).select(
        "s_null", "s", "n", "target", "scale",
        F.lit(0.0).alias("m"),
        # at lo no document keeps a word of account, at hi every one is at the ceiling
        (F.lit(-40.0) * F.col("scale") / F.col("small")).alias("lo"),
        ((F.log(F.lit(most)) + 1e-9) * F.col("scale") / F.col("small")).alias("hi"),
        (F.col("target") <= 0).alias("done"),
    )
    # Targets at an end of the range need no iterations.
    full = F.col("target") >= F.col("n") * most * (1 - 1e-12)
    state = state.withColumn("m", F.when(F.col("done"), F.col("lo")).when(full, F.col("hi")).otherwise(F.col("m")))
    state = scratch.write(state.select("s_null", "s", "target", "scale", "m", "lo", "hi", (F.col("done") | full).alias("done")), "newton-0")
    for k in range(1, iterations + 1):
        rows = counts.join(state, ["s_null", "s"]).withColumn("x", F.col("size") / F.col("scale"))
        rate = _rate(F.col("m"), most)
        words = F.col("size") * F.col("docs")
        sums = rows.groupBy("s_null", "s").agg(
            F.sum(words * rate).alias("got"),
            F.sum(F.when(rate < most, words * rate * F.col("x")).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap <= 0, F.col("m")).otherwise(F.col("lo")), F.when(gap >= 0, F.col("m")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("m") - gap / F.col("slope"))
        inside = newton.isNotNull() & (newton > lo) & (newton < hi) & F.lit(k % 3 > 0)
        close = F.col("done") | (F.abs(gap) <= F.greatest(F.lit(1e-6), F.col("target") * 1e-9)) | (hi - lo <= 1e-12)
        step = state.join(sums, ["s_null", "s"]).select(
            "s_null", "s", "target", "scale",
            F.when(close, F.col("m")).when(inside, newton).otherwise((lo + hi) / 2).alias("m"),
            lo.alias("lo"), hi.alias("hi"), close.alias("done"),
        )
        state = scratch.write(step, f"newton-{k}")
        scratch.drop(f"newton-{k - 1}")
        if state.where(~F.col("done")).isEmpty():
            break
    else:
        raise RuntimeError(f"sources without a balance after {iterations} iterations")
    return state.select("s_null", "s", "scale", "m", "target")


def round_copies(rows: DataFrame, most: float = MOST, rounds: int = 4) -> DataFrame:
    """Whole copies per source and size: (s_null, s, size, docs, copies) from (..., rate, target).

    Systematic rounding down the sizes keeps every partial sum of copies within a half of the ideal.
    Each further round lets documents no larger than what is left settle it, the largest first.
    """
    down = Window.partitionBy("s_null", "s").orderBy(F.desc("size"))
    through = down.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("s_null", "s")
    ideal = F.sum(F.col("docs") * F.col("rate")).over(through)
    rows = rows.withColumn("_upto", F.floor(ideal + 0.5))
    rows = rows.withColumn("copies", F.greatest(F.lit(0), F.least((F.col("docs") * most).cast("bigint"), F.col("_upto") - F.coalesce(F.lag("_upto").over(down), F.lit(0)))))
    for _ in range(rounds):
        rows = rows.withColumn("_gap", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole))
        fits = F.col("size") <= F.abs("_gap")
        room = F.when(F.col("_gap") > 0, (F.col("docs") * most).cast("bigint") - F.col("copies")).otherwise(F.col("copies"))
        rows = rows.withColumn("_room", F.when(fits, room).otherwise(F.lit(0)))
        before = F.coalesce(F.sum(F.col("_room") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        use = F.least(F.col("_room"), F.floor(F.greatest(F.lit(0.0), F.abs("_gap") - before) / F.col("size")))
        rows = rows.withColumn("copies", F.col("copies") + F.when(F.col("_gap") > 0, use).otherwise(-use))
    return rows.select("s_null", "s", "size", "docs", "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, salts: int = SALTS) -> DataFrame:
    """``docs`` with size, source_size, target and copies."""
    scratch = Scratch(docs.sparkSession)
    results = ("size", "source_size", "target", "copies")
    base = docs.drop(*results)
    keys = ["s_null", "s"]
    key = (F.col("source").isNull().alias("s_null"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s"))
    sized = base.withColumns({"size": size_of(F.col("text")), "s_null": key[0], "s": key[1]})
    sized = sized.withColumn("_h", F.xxhash64("doc_id", "text")).withColumn("salt", F.pmod("_h", F.lit(salts)))
    small = scratch.write(sized.select(*keys, "size", "salt").groupBy(*keys, "size", "salt").agg(F.count("*").alias("docs")), "counts")
    counts = scratch.write(small.where(F.col("size") > 0).groupBy(*keys, "size").agg(F.sum("docs").alias("docs")), "sizes")
    totals = small.groupBy(*keys).agg(F.sum(F.col("size") * F.col("docs")).alias("n"))
    goal = scratch.write(targets(totals, weights, share, most), "targets")
    multipliers = balance(counts, goal, scratch, most)
    rated = counts.join(multipliers, keys).withColumn("x", F.col("size") / F.col("scale"))
    rated = rated.select(*keys, "size", "docs", "target", _rate(F.col("m"), most).alias("rate"))
    copies = round_copies(rated, most)
    # Each salt takes the copies between the running shares of its documents: whole numbers that add up.
    per = Window.partitionBy(*keys, "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    quota = small.where(F.col("size") > 0).withColumnRenamed("docs", "own").join(copies, [*keys, "size"]).withColumn("_d", F.sum("own").over(per))
    upto = F.floor(F.col("_d") * F.col("copies") / F.col("docs"))
    earlier = F.floor((F.col("_d") - F.col("own")) * F.col("copies") / F.col("docs"))
    quota = scratch.write(quota.select(*keys, "size", "salt", "own", (upto - earlier).alias("quota")), "quotas")

    order = Window.partitionBy(*keys, "size", "salt").orderBy("_h", "doc_id")
    rank = (F.row_number().over(order) - 1).cast("bigint")
    out = sized.withColumn("_rank", rank).join(quota, [*keys, "size", "salt"], "left")
    each = F.floor(F.col("quota") / F.col("own"))
    more = F.col("quota") - each * F.col("own")
    out = out.withColumn("copies", F.coalesce(each + F.when(F.col("_rank") < more, 1).otherwise(0), F.lit(0)).cast("bigint"))
    # Sources may be many: a plain join, which adaptive execution broadcasts or splits as their size has it.
    out = out.join(goal.withColumnRenamed("n", "source_size"), keys)
    return out.select(*[c for c in base.columns], "size", "source_size", "target", "copies")
