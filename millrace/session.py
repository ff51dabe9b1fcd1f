"""Session factory shared by the tests, the bench and interactive use."""

from __future__ import annotations

import os
import shlex

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

#: Settings every millrace session starts from, where nothing else sets them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def _given() -> dict[str, str]:
    """Settings that spark-submit or the environment has made already."""
    found = {}
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit: its JVM knows
        SparkContext._ensure_initialized()
        found |= dict(SparkConf().getAll())
    words = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    for at, word in enumerate(words[:-1]):
        if word == "--master":
            found["spark.master"] = words[at + 1]
        elif word == "--conf" and "=" in words[at + 1]:
            key, _, value = words[at + 1].partition("=")
            found[key] = value
    return found


def session(
    app: str = "millrace",
    cores: int | str | None = None,
    shuffle_partitions: int | None = None,
    endpoint: str | None = None,
    **conf: str,
) -> SparkSession:
    """Return the running session, or start one.

    Where nothing names a master, neither spark-submit nor the environment nor
    ``endpoint`` (a master, or a Spark Connect address), it is local with ``cores``
    (default: every core).  Extra ``conf`` keys use ``__`` in place of dots.
    """
    builder, given = SparkSession.builder.appName(app), _given()
    if endpoint:
        builder = builder.remote(endpoint) if endpoint.startswith("sc://") else builder.master(endpoint)
    elif "spark.master" not in given and "SPARK_REMOTE" not in os.environ and "MASTER" not in os.environ:
        builder = builder.master(f"local[{cores or '*'}]")
    for key, value in DEFAULTS.items():
        if key not in given:
            builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    if not (endpoint or "").startswith("sc://"):
        spark.sparkContext.setLogLevel("ERROR")
    return spark
