"""Where queries keep tables of their own: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from tidemark.errors import EngineError
from tidemark.sources.catalog import Catalog

_own: dict[str, str] = {}


def one_machine(spark: SparkSession) -> None:
    """An error on a cluster: a temporary folder there is another one on each machine."""
    if not spark.sparkContext.master.startswith("local"):
        raise EngineError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset (a single machine)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    one_machine(spark)
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidemark-lake-")
    return _own[app]


def lake(spark: SparkSession) -> Catalog:
    """A new, empty catalog."""
    return Catalog(spark, f"{scratch(spark)}/lake-{uuid.uuid4().hex}")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's executors, once: they import it when they run its functions."""
    import zipfile
    from pathlib import Path

    import tidemark

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(tidemark.__file__).parent
    # the driver serves this file as long as it runs
    d = tempfile.mkdtemp(prefix="tidemark-package-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    path = f"{d}/tidemark_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"tidemark/{p.relative_to(top)}")
    context.addPyFile(path)
    _shipped.add(context.applicationId)
