"""Making the library importable on executors that have not got it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application, unless their Python path already holds it.

    Python workers inherit the driver's PYTHONPATH and working folder where these exist for them; elsewhere
    (a driver that only changed sys.path) their tasks could not load the operators' functions.
    """
    package = Path(__file__).resolve().parent
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    application = spark.sparkContext.applicationId
    if application in _shipped or any(p and Path(p).resolve() == package.parent for p in known):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="skyaccord-"), "skyaccord.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
