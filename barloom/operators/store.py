"""The store of runs and strategies: Parquet, in numbered versions.

Every write makes the next version beside the older ones; it counts once its success mark is written,
which is the last step, so readers see the version before or the whole new one.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNS = "run_id string, created_utc string, mode string, dataset_id string, eval_id string, config_json string"
#: Versions that stay after a write, for readers that still hold an older one.
KEPT = 3
KEY = ["strategy_hash", "dataset_id", "eval_id"]
ALWAYS = ["created_utc", "run_id", "genome_json", "metrics_json", "pass_flags"]
#: Taken from the row of the better score only.
METRICS = [
    "score", "sharpe_train", "sharpe_holdout", "calmar_train", "calmar_holdout", "mdd_train", "mdd_holdout", "trades_train", "trades_holdout",
    "exposure_train", "exposure_holdout", "turnover_train", "turnover_holdout",
]
STRATEGIES = "strategy_hash string, dataset_id string, eval_id string, created_utc string, run_id string, genome_json string, metrics_json string, pass_flags string, " + ", ".join(f"{m} {'bigint' if m.startswith('trades') else 'double'}" for m in METRICS)


def condensed(batch: DataFrame) -> DataFrame:
    """One row per key as if the rows came one by one in the order of ``seq``: texts of the last, metrics
    of the first that reaches the best score."""
    best = F.max_by(F.struct(*METRICS), F.struct(F.coalesce("score", F.lit(float("-inf"))), -F.col("seq"))).alias("_m")
    last = F.max_by(F.struct(*ALWAYS), "seq").alias("_a")
    return batch.groupBy(*KEY).agg(last, best).select(*KEY, "_a.*", "_m.*")


def merged(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert: new texts always, new metrics only with a strictly greater score."""
    new = condensed(batch)
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, KEY, "full_outer")
    here = F.col("n.run_id").isNotNull() | F.col("n.genome_json").isNotNull() | F.col("n.metrics_json").isNotNull()
    absent = F.col("o.run_id").isNull() & F.col("o.genome_json").isNull() & F.col("o.metrics_json").isNull()
    better = here & (absent | (F.col("n.score") > F.col("o.score")))
    take = lambda c, when: F.when(when, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(*KEY, *[take(c, here) for c in ALWAYS], *[take(c, better) for c in METRICS])


def latest_eval(strategies: DataFrame, dataset_id: str) -> DataFrame:
    per = strategies.where(F.col("dataset_id") == dataset_id).groupBy("eval_id").agg(F.max("created_utc").alias("latest"))
    return per.orderBy(F.desc("latest"), "eval_id").limit(1)


#: Fields of the metrics text that the top-k view shows.
DETAILS = {
    "cv_med": "$.cv.median_sharpe", "cv_min": "$.cv.min_sharpe", "cv_std": "$.cv.std_sharpe", "cv_med_delay": "$.cv.median_sharpe_delay", "cv_min_delay": "$.cv.min_sharpe_delay",
    "cv_med_cost": "$.cv.median_sharpe_cost", "cv_min_cost": "$.cv.min_sharpe_cost", "cv_folds": "$.cv.folds", "cv_pos": "$.cv.positive_folds", "cv_pos_cost": "$.cv.positive_folds_cost",
    "reg_cov": "$.regime.coverage", "reg_dom": "$.regime.dominance", "reg_worst": "$.regime.worst_sharpe",
}


def top(strategies: DataFrame, dataset_id: str, k: int, eval_id: str | None = None) -> DataFrame:
    """The k best of the evaluation (by default the latest), with rank and the details of their metrics."""
    rows = strategies.where(F.col("dataset_id") == dataset_id)
    if eval_id is None:
        rows = rows.join(F.broadcast(latest_eval(strategies, dataset_id).select("eval_id")), "eval_id", "left_semi")
    else:
        rows = rows.where(F.col("eval_id") == eval_id)
    best = rows.orderBy(F.desc("score"), "strategy_hash").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "strategy_hash"))
    return best.select(rank.alias("rank"), *strategies.columns, *[F.get_json_object("metrics_json", path).try_cast("double").alias(name) for name, path in DETAILS.items()])


def lookup(strategies: DataFrame, dataset_id: str, eval_id: str, strategy_hash: str) -> DataFrame:
    from barloom.operators.signal import GENOME

    rows = strategies.where((F.col("dataset_id") == dataset_id) & (F.col("eval_id") == eval_id) & (F.col("strategy_hash") == strategy_hash))
    return rows.limit(1).select(*KEY, F.from_json("genome_json", GENOME).alias("genome"))


def migrated(legacy: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of the old layout under the evaluation legacy_v1: each metric serves train and holdout; existing keys stay."""
    rows = legacy.withColumn("eval_id", F.lit("legacy_v1"))
    old = {"sharpe": "sharpe", "calmar": "calmar", "mdd": "max_drawdown", "trades": "trades", "exposure": "exposure", "turnover": "turnover"}
    both = {f"{k}_{part}": F.col(v) for k, v in old.items() for part in ("train", "holdout")}
    rows = rows.select(*KEY, *ALWAYS, "score", *[both[m].alias(m) for m in METRICS[1:]])
    return current.unionByName(rows.join(current.select(*KEY), KEY, "left_anti"))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)

    def _versions(self, name: str) -> list[int]:
        """Numbers of the finished versions, ascending: those with a written success mark."""
        folder = self._path(f"{self.root}/{name}")
        fs = self.fs(folder)
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v-") and p.getName()[2:].isdigit() and fs.exists(self._path(f"{p.toString()}/_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        schema = RUNS if name == "runs" else STRATEGIES
        versions = self._versions(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v-{versions[-1]}") if versions else self.spark.createDataFrame([], schema)

    def _swap(self, name: str, df: DataFrame) -> None:
        """Write the next version, which counts once its success mark is there; the latest ``KEPT`` stay for readers."""
        versions = self._versions(name)
        out = df.write.mode("overwrite")  # a number without a mark is a write that never ended
        number = (versions[-1] if versions else 0) + 1
        (out.partitionBy("dataset_id", "eval_id") if name == "strategies" else out).parquet(f"{self.root}/{name}/v-{number}")
        for old in versions[: -(KEPT - 1)]:
            folder = self._path(f"{self.root}/{name}/v-{old}")
            self.fs(folder).delete(folder, True)

    def insert_run(self, run: dict) -> None:
        new = self.spark.createDataFrame([tuple(run.get(f.split()[0]) for f in RUNS.split(", "))], RUNS)
        self._swap("runs", self.read("runs").join(new.select("run_id"), "run_id", "left_anti").unionByName(new))

    def upsert(self, batch: DataFrame) -> None:
        self._swap("strategies", merged(self.read("strategies"), batch))

    def migrate(self, legacy: DataFrame) -> None:
        self._swap("strategies", migrated(legacy, self.read("strategies")))
