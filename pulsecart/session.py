"""Session settings the operators rely on."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Needed for right results: all dates and hours are UTC.
_REQUIRED = {"spark.sql.session.timeZone": "UTC"}

# Needed for scale: adaptive joins that split hot keys even when the split costs one more
# exchange, and state that lives on disk instead of on the executor heap.
_SCALE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session someone else built.

    ``spark.sql.shuffle.partitions`` and ``spark.checkpoint.dir`` belong to the cluster and are
    left alone.
    """
    for key, value in {**_REQUIRED, **_SCALE}.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def with_settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Settings of the session meanwhile; a stream keeps those it was started with."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def build_session(
    app: str = "pulsecart",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Build a session. On a cluster, leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())
