"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, unless they find it by PYTHONPATH or the working directory."""
    sc = spark.sparkContext
    known = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {Path.cwd().resolve()}
    if ROOT in known or sc.applicationId in _shipped or (Path.cwd() / "sparkmat").exists():
        return
    path = os.path.join(tempfile.mkdtemp(), "sparkmat.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "sparkmat").rglob("*")):
            if f.is_file() and f.suffix in (".py", ".csv"):
                z.write(f, f.relative_to(ROOT))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
