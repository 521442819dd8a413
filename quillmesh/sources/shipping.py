"""Gets this package to where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless their path already leads to it."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(root) in path or getattr(sc, "_quillmesh_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    made = Path(tempfile.mkdtemp(prefix="quillmesh-")) / "quillmesh.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(made))
    sc._quillmesh_shipped = True
