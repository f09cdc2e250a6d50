"""Labels, predictions, trades, reports and the run table."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_labels(labels: DataFrame, path: str) -> None:
    """Ordered by symbol and time; the range split also divides a symbol with very many labels."""
    (
        labels.repartitionByRange("symbol", "entry_time")
        .sortWithinPartitions("symbol", "entry_time")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("symbol")
        .parquet(path)
    )


def read_labels(
    spark: SparkSession, path: str, *, symbol: str | None = None, start: date | None = None, end: date | None = None
) -> DataFrame:
    d = spark.read.parquet(path)
    if symbol is not None:
        d = d.where(F.col("symbol") == symbol)
    if start is not None:
        d = d.where(F.col("session_date") >= F.lit(start))
    if end is not None:
        d = d.where(F.col("session_date") <= F.lit(end))
    return d


def write_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Store rows, or none, as one run of a table; other runs, whatever their columns, stay."""
    rows.drop("run_id").write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def run_ids(spark: SparkSession, path: str) -> list[str]:
    """The runs a table holds, oldest first; run ids sort by time. Reads folder names, not rows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n.removeprefix("run_id=") for n in names if n.startswith("run_id="))


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """One run with its own columns: a class that only some runs know is a column of those runs only."""
    if run_id not in run_ids(spark, path):
        raise ValueError(f"no run {run_id!r}")
    d = spark.read.option("basePath", path).parquet(f"{path}/run_id={run_id}")
    return d.withColumn("run_id", F.lit(run_id))


def read_runs(spark: SparkSession, path: str, which: list[str] | None = None) -> DataFrame:
    """Several runs (all by default) in one table; a column that a run lacks is null in its rows."""
    wanted = run_ids(spark, path) if which is None else which
    if not wanted:
        raise ValueError("no run found")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_run(spark, path, r) for r in wanted])


def write_predictions(scored: DataFrame, path: str, run_id: str, export: str = "val") -> bool:
    """Store the validation rows, or all rows, under the run; `none` stores nothing."""
    if export == "none":
        return False
    write_run(scored if export == "all" else scored.where(F.col("split") == "val"), path, run_id)
    return True


def read_predictions(spark: SparkSession, path: str, *, run_id: str | None = None, split: str = "val") -> DataFrame:
    """Predictions of a run (the latest by default) and split; an empty selection is an error."""
    if split not in ("val", "train", "all"):
        raise ValueError("split must be val, train or all")
    d = read_run(spark, path, run_id or latest_run(spark, path))
    if split != "all":
        d = d.where(F.col("split") == split)
    if d.isEmpty():
        raise ValueError(f"no prediction rows for split={split!r}")
    return d


def latest_run(spark: SparkSession, path: str) -> str:
    """The newest run that stored something in the table at `path`."""
    found = run_ids(spark, path)
    if not found:
        raise ValueError("no run found")
    return found[-1]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
