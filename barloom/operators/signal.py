"""Alpha, gate and position of many genomes over the same bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.features import column, features, gate

GENOME = "struct<type:string,features:array<struct<name:string,window:int,weight:double>>,threshold:double,vol_gate:struct<mode:string,window:int>>"
TYPE = "linear_alpha_v1"
#: Genomes whose plan is broadcast at once; a generation is evaluated in lots of this many.
LOT = 4096


def needed(genomes: list[dict]) -> list[tuple[str, int]]:
    """Distinct features of the genomes, those of gates included."""
    own = [(p["name"], int(p["window"])) for g in genomes for p in g["features"]]
    gates = [("vol_s", int(g["vol_gate"]["window"])) for g in genomes]
    return sorted(set(own + gates))


def positions(bars: DataFrame, genomes: DataFrame, feats: list[tuple[str, int]], keep: tuple[str, ...] = ()) -> DataFrame:
    """(series_id, genome_id, t, close, alpha, pos, *keep) from (genome_id, genome).

    ``feats`` lists every feature that the genomes use, in any order.  The sum over parts runs in
    FLOAT and in the genome's order; a null feature makes alpha null, which takes no position.
    """
    rows = features(bars, feats) if not {column(*f) for f in feats} <= set(bars.columns) else bars
    slots = {f: i + 1 for i, f in enumerate(feats)}
    slot_of = F.create_map(*[x for f, i in slots.items() for x in (F.lit(f"{f[0]}_{f[1]}"), F.lit(i))])
    parts = F.transform("genome.features", lambda p: F.struct(F.element_at(slot_of, F.concat_ws("_", p["name"], p["window"].cast("string"))).alias("slot"), p["weight"].cast("float").alias("weight")))
    plans = genomes.select(
        "genome_id",
        parts.alias("_parts"),
        F.col("genome.threshold").cast("float").alias("_thr"),
        F.lower("genome.vol_gate.mode").alias("_mode"),
        F.element_at(slot_of, F.concat(F.lit("vol_s_"), F.col("genome.vol_gate.window").cast("string"))).alias("_gate"),
    )
    wide = rows.select("series_id", "t", "close", *keep, F.array(*[F.col(column(*f)) for f in feats]).alias("_f"))
    both = wide.crossJoin(F.broadcast(plans))
    alpha = F.aggregate("_parts", F.lit(0.0).cast("float"), lambda acc, p: (acc + p["weight"] * F.element_at(F.col("_f"), p["slot"])).cast("float"))
    both = both.withColumn("alpha", alpha)
    open_ = gate(F.element_at(F.col("_f"), F.col("_gate")), F.col("_mode"))
    pos = F.when(open_ & (F.col("alpha") > F.col("_thr")), 1).when(open_ & (F.col("alpha") < -F.col("_thr")), -1).otherwise(0)
    return both.select("series_id", "genome_id", "t", "close", "alpha", pos.cast("byte").alias("pos"), *keep)
