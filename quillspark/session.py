"""Session factory and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that every session of this engine starts from. Sizes are left to AQE.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


#: Bounds of what goes to Python at once, as texts may be long: setting, Spark's default, ours.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b"))


def small_batches(spark: SparkSession) -> None:
    """Smaller batches for the session, unless it has bounds of its own. They are read when a plan runs, so they stay."""
    for setting, default, ours in BATCHES:
        if spark.conf.get(setting) == default:
            spark.conf.set(setting, ours)


def get_session(app: str = "quillspark", **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
