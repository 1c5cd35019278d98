"""Session factory used by tests, the bench and scripts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "strideframe", **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps; extra settings by keyword
    with underscores for dots (``spark_sql_shuffle_partitions="8"``)."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("_", "."): v for k, v in conf.items()})
    spark = SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder all executors share and read back: what reads them does not depend on any executor. The
    cluster names the folder in ``spark.checkpoint.dir``; only under a local master may it be unset."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="strideframe-"))
    return df.checkpoint()
