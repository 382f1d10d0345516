"""Session helpers.

Library code never hard-codes a cluster setting; it only reads the
session.  ``get_session`` is a convenience for tests, benchmarks and
local runs: on a real cluster pass in the session you already have.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    "spark.sql.ansi.enabled": "true",
}


def get_session(master: str | None = None, app: str = "vantage", conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the local defaults above.

    ``master`` defaults to ``local[$BENCH_CPUS]`` or ``local[*]``.
    """
    if master is None:
        master = f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    builder = SparkSession.builder.master(master).appName(app)
    settings = {**LOCAL_CONF, **(conf or {})}
    if master.startswith("local") and "spark.checkpoint.dir" not in settings:
        settings["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="vantage-ckpt-")
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``; we only invent one
    when it is unset *and* Spark runs in local mode (tests, laptops).  A
    cluster without the setting is an error: a machine-local folder would
    not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative operators")
        d = tempfile.mkdtemp(prefix="vantage-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, unless their PYTHONPATH has it.

    Python functions that run on executors refer to the package's modules.
    The archive is served by the driver while the session lasts.
    """
    root = Path(__file__).resolve().parents[1]
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in on_path or app in _SHIPPED:
        return
    _SHIPPED.add(app)
    name = Path(tempfile.mkdtemp(prefix="vantage-"), "vantage-library.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.glob("vantage/**/*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(name))
