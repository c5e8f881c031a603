"""Generation, mutation, crossover and identity of genomes, as columns.

Each random choice is a hash of (seed, genome, step), so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import SearchSpace
from barloom.operators.signal import TYPE


def uniform(seed: int, *of) -> Column:
    """In [0, 1), from a hash."""
    key = F.xxhash64(F.lit(seed), *[x if isinstance(x, Column) else F.lit(x) for x in of])
    return F.pmod(key, F.lit(1 << 52)).cast("double") / float(1 << 52)


def normal(seed: int, *of) -> Column:
    """Standard normal, by the Box-Muller transform."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, "n1", *of))) * F.cos(2 * 3.141592653589793 * uniform(seed, "n2", *of))


def pick(values, u: Column) -> Column:
    a = F.array(*[F.lit(v) for v in values])
    return F.element_at(a, (F.floor(u * len(values)) + 1).cast("int"))


def _genome(parts: Column, threshold: Column, mode: Column, window: Column) -> Column:
    return F.struct(F.lit(TYPE).alias("type"), parts.alias("features"), threshold.alias("threshold"), F.struct(mode.alias("mode"), window.cast("int").alias("window")).alias("vol_gate"))


def _part(name: Column, window: Column, weight: Column) -> Column:
    return F.struct(name.alias("name"), window.cast("int").alias("window"), weight.cast("double").alias("weight"))


def random_genomes(spark: SparkSession, n: int, seed: int, space: SearchSpace | None = None, start: int = 0) -> DataFrame:
    """(genome_id, genome): two to four distinct features, uniform windows, weights, threshold and gate."""
    s = space or SearchSpace()
    i = F.col("genome_id")
    between = lambda u, lo, hi: F.lit(lo) + u * (hi - lo)
    k = (F.floor(uniform(seed, "k", i) * (s.max_parts - s.min_parts + 1)) + s.min_parts).cast("int")
    order = F.array_sort(F.array(*[F.struct(uniform(seed, "f", name, i).alias("u"), F.lit(name).alias("name")) for name in s.features]))
    parts = F.transform(F.slice(order, 1, k), lambda x: _part(x["name"], pick(s.windows, uniform(seed, "w", x["name"], i)), between(uniform(seed, "g", x["name"], i), *s.weight_range)))
    genome = _genome(parts, between(uniform(seed, "t", i), *s.threshold_range), pick(s.gate_modes, uniform(seed, "m", i)), pick(s.gate_windows, uniform(seed, "v", i)))
    return spark.range(start, start + n).select(F.col("id").alias("genome_id")).select("genome_id", genome.alias("genome"))


def fingerprint(genome: Column) -> Column:
    """Equal for genomes that differ only in the order of their parts or past the fourth decimal."""
    parts = F.array_sort(F.transform(genome["features"], lambda p: F.struct(p["name"], p["window"], F.bround(p["weight"], 4))))
    return F.xxhash64(genome["type"], parts, F.bround(genome["threshold"], 4), genome["vol_gate"]["mode"], genome["vol_gate"]["window"])


def _step(values, x: Column, u: Column) -> Column:
    """A neighbour of x among the sorted values."""
    a = F.array(*[F.lit(v) for v in values])
    at = F.array_position(a, x).cast("int")
    moved = F.greatest(F.lit(1), F.least(F.lit(len(values)), at + F.when(u < 0.5, -1).otherwise(1)))
    return F.when(at > 0, F.element_at(a, moved)).otherwise(x)


def mutate(df: DataFrame, seed: int, space: SearchSpace | None = None) -> DataFrame:
    """``genome`` changed: weights, threshold, windows by a step, one feature swapped, the gate; each at its own rate."""
    s = space or SearchSpace()
    i, g = F.col("genome_id"), F.col("genome")
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))

    def change(p: Column, at: Column) -> Column:
        u = lambda what: uniform(seed, what, i, at)
        weight = F.when(u("pw") < 0.95, clamp(p["weight"] + 0.20 * normal(seed, "w", i, at), *s.weight_range)).otherwise(p["weight"])
        window = F.when(u("pn") < 0.45, _step(s.windows, p["window"], u("dn"))).otherwise(p["window"])
        return _part(p["name"], window, weight)

    parts = F.transform(g["features"], change)
    absent = F.array_except(F.array(*[F.lit(x) for x in s.features]), F.transform(g["features"], lambda p: p["name"]))
    swap = (uniform(seed, "ps", i) < 0.18) & (F.size(absent) > 0)
    place = F.floor(uniform(seed, "sp", i) * F.size(g["features"])).cast("int")
    fresh = F.element_at(absent, (F.floor(uniform(seed, "sf", i) * F.greatest(F.size(absent), F.lit(1))) + 1).cast("int"))
    swapped = F.transform(parts, lambda p, at: F.when(swap & (at == place), _part(fresh, p["window"], p["weight"])).otherwise(p))
    threshold = F.when(uniform(seed, "pt", i) < 0.75, clamp(g["threshold"] + 0.08 * normal(seed, "t", i), *s.threshold_range)).otherwise(g["threshold"])
    gated = uniform(seed, "pg", i) < 0.25
    mode = F.when(gated & (uniform(seed, "gm", i) < 0.5), pick(s.gate_modes, uniform(seed, "m", i))).otherwise(g["vol_gate"]["mode"])
    window = F.when(gated & (uniform(seed, "gw", i) < 0.7), pick(s.gate_windows, uniform(seed, "v", i))).otherwise(g["vol_gate"]["window"])
    return df.withColumn("genome", _genome(swapped, threshold, mode, window))


def crossover(pairs: DataFrame, seed: int, space: SearchSpace | None = None) -> DataFrame:
    """(genome_id, genome) from (genome_id, a, b): two to four parts of either parent, in any order.

    Weights are averaged where both parents have a part and shifted a little.  Parents with fewer parts
    than the child takes leave room for random ones of 0.6 times the usual weights.  The gate is that of
    either parent; of one child in five its mode and its window may change.
    """
    s = space or SearchSpace()
    i, a, b = F.col("genome_id"), F.col("a"), F.col("b")
    key = lambda p: F.struct(p["name"].alias("name"), p["window"].cast("int").alias("window"))
    both = F.concat(a["features"], b["features"])
    n = (F.floor(uniform(seed, "k", i) * (s.max_parts - s.min_parts + 1)) + s.min_parts).cast("int")
    own = F.array_distinct(F.transform(both, key))
    fresh = F.array(*[F.struct(pick(s.features, uniform(seed, "rn", i, j)).alias("name"), pick(s.windows, uniform(seed, "rw", i, j)).cast("int").alias("window")) for j in range(s.max_parts)])
    keys = F.array_distinct(F.concat(own, F.slice(fresh, F.lit(1), F.greatest(F.lit(0), n - F.size(own)))))
    place = lambda k: F.struct(uniform(seed, "o", i, k["name"], k["window"]).alias("u"), k.alias("k"))
    shuffled = F.transform(F.array_sort(F.transform(keys, place)), lambda x: x["k"])

    def part(k: Column) -> Column:
        held = F.filter(both, lambda p: (p["name"] == k["name"]) & (p["window"] == k["window"]))
        low, high = s.weight_range
        foreign = 0.6 * (F.lit(low) + uniform(seed, "rg", i, k["name"], k["window"]) * (high - low))
        mean = F.aggregate(held, F.lit(0.0), lambda acc, p: acc + p["weight"]) / F.greatest(F.lit(1), F.size(held))
        weight = F.when(F.size(held) == 0, foreign).otherwise(mean + 0.10 * normal(seed, "w", i, k["name"], k["window"]))
        return _part(k["name"], k["window"], F.greatest(F.lit(low), F.least(F.lit(high), weight)))

    parts = F.transform(F.slice(shuffled, F.lit(1), n), part)
    threshold = F.greatest(F.lit(s.threshold_range[0]), F.least(F.lit(s.threshold_range[1]), (a["threshold"] + b["threshold"]) / 2 + 0.06 * normal(seed, "t", i)))
    gate = F.when(uniform(seed, "g", i) < 0.5, a["vol_gate"]).otherwise(b["vol_gate"])
    changed = uniform(seed, "pg", i) < 0.20
    mode = F.when(changed & (uniform(seed, "gm", i) < 0.5), pick(s.gate_modes, uniform(seed, "m", i))).otherwise(gate["mode"])
    window = F.when(changed & (uniform(seed, "gw", i) < 0.7), pick(s.gate_windows, uniform(seed, "v", i))).otherwise(gate["window"])
    return pairs.select("genome_id", _genome(parts, threshold, mode, window).alias("genome"))


def unseen(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose fingerprint is neither seen nor an earlier row's."""
    rows = df.withColumn("fp", fingerprint(F.col("genome")))
    first = rows.groupBy("fp").agg(F.min("genome_id").alias("genome_id"))
    return rows.join(first, ["fp", "genome_id"], "left_semi").join(seen.select("fp"), "fp", "left_anti")
