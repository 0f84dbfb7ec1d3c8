"""Make this package importable in the executors' Python workers.

Functions given to ``mapInArrow`` and pandas UDFs are pickled by reference, so the workers must be able to
import the package.  ``ship`` sends it as one zip through Spark's own file server, once per application.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors; further calls in the same application do nothing."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="tidemark-")
    target = os.path.join(folder, "tidemark_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for top, _, names in sorted(os.walk(_ROOT)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
    sc.addPyFile(os.path.abspath(target))
    _shipped.add(sc.applicationId)
