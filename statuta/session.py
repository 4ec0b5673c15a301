"""Giving executors this package, and the folder that all of them share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Spark's own bound of an Arrow batch, and ours: batches of texts are held several times over by the JVM and by Python.
BATCH_BYTES, OWN, OURS = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for an application; their Python workers import it. Arrow batches are bounded by OURS where the session leaves Spark's own bound."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_BYTES) == OWN:
        spark.conf.set(BATCH_BYTES, OURS)
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # else it is in an archive that was sent before
        out = os.path.join(os.path.realpath(tempfile.mkdtemp()), "statuta_package.zip")
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, f"{package.name}/{p.relative_to(package)}")
        sc.addPyFile(out)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine if Spark runs in one process (tests), else an error."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not given and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(given or f"{tempfile.gettempdir()}/statuta-{uuid.uuid4().hex[:12]}")
    return given or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
