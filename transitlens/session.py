"""Session settings and the shared scratch folder.

The library never creates a session for the caller; :func:`local_session` is only for
tests, the benchmark and local experiments.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR_KEY = "spark.checkpoint.dir"

# Settings the library is tuned for; none of them changes results. AQE coalesces the small
# per-line shuffles. Turning off PySpark's DataFrame debugging context drops the Python
# call-site capture (several JVM round trips and a stack walk) from every Column and
# DataFrame call, which otherwise dominates the driver-side cost of building a report; it
# only shortens error messages.
RECOMMENDED_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.csv.filterPushdown.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def scratch_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    Intermediate tables are written below it, never to a machine-local temp folder, so
    they survive the loss of any executor.
    """
    path = spark.conf.get(CHECKPOINT_DIR_KEY, None)
    if path:
        return path.rstrip("/")
    try:
        sc = spark.sparkContext  # not available on a Spark Connect session
    except Exception as exc:  # noqa: BLE001
        raise RuntimeError(
            f"{CHECKPOINT_DIR_KEY} is not set; point it at a folder every executor can reach"
        ) from exc
    path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_DIR_KEY} is not set; point it at a folder every executor can reach"
            )
        # Single-machine session: the only "cluster" is this machine, so a local folder is
        # shared by every executor thread.
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="transitlens-ckpt-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder below :func:`scratch_dir`."""
    return f"{scratch_dir(spark)}/transitlens/{name}-{uuid.uuid4().hex}"


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int | None = None,
    checkpoint_dir: str | None = None,
    app_name: str = "transitlens",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """A ``local[cores]`` session with the recommended settings (tests, bench).

    Where the session names no ``spark.checkpoint.dir``, ``checkpoint_dir`` (or, in this
    single-machine mode only, a fresh local temporary folder) becomes the scratch folder.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    if shuffle_partitions is None:
        shuffle_partitions = 8 if cores == "*" else int(cores)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RECOMMENDED_CONF, **(extra_conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Only set a checkpoint folder where the cluster did not name one.
    if not spark.conf.get(CHECKPOINT_DIR_KEY, None) and not spark.sparkContext.getCheckpointDir():
        if checkpoint_dir:
            spark.sparkContext.setCheckpointDir(checkpoint_dir)
        else:
            scratch_dir(spark)
    return spark
