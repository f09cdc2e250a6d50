"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "barwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package assumes; cluster settings come from the caller."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # HotSpot never compiles methods above 8000 bytes of bytecode; split those instead
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # call-site capture doubles the cost of building wide plans
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Local dates come from `from_utc_timestamp`, which is only right in a UTC session."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    if tz not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, got {tz!r}")


def cut_lineage(df, name: str):
    """Checkpoint into the folder the cluster names; without one the plan is returned as it is.

    Only reliable (shared-storage) checkpoints are used, so a lost executor costs nothing.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        spark.sparkContext.setJobDescription(f"checkpoint {name}")
        return df.checkpoint(eager=True)
    return df
