"""Session helpers shared by every operator: shipping the package, cutting lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once per Spark application.

    Functions used by ``mapInArrow`` and friends are pickled by reference, so the workers
    need the package; it is zipped and distributed with ``addPyFile``. Arrow batches are made
    smaller where nobody has set their size, so that a batch of whole texts stays small.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:  # rows hold whole texts; a setting of one's own stays
        spark.conf.set(_BATCH, "2000")
    if getattr(sc, "_quillstream_shipped", False):
        return spark
    target = os.path.join(tempfile.mkdtemp(), "quillstream_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quillstream", os.path.relpath(full, _PACKAGE)))
    sc.addPyFile(target)
    sc._quillstream_shipped = True
    return spark


#: Bytes for each core up to which an input counts as small.
SMALL_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores where its files are so small that a scan would use a few only.

    A small file is one row group and so one task, whatever is computed on it. Inputs of
    more than ``SMALL_BYTES`` a core have enough tasks and are not shuffled.
    """
    sc = df.sparkSession.sparkContext
    files, cores = df.inputFiles(), sc.defaultParallelism
    if len(files) >= cores:
        return df
    conf = sc._jsc.hadoopConfiguration()
    paths = [sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(f)) for f in files]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return df.repartition(cores) if size <= cores * SMALL_BYTES else df


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once for each row, however often they are used.

    Spark merges projections and moves filters down, and so repeats an expression for each use,
    inside a higher-order function for each element. It does neither through a generator.
    """
    return df.select(*(c for c in df.columns if c not in columns), F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session, set up where it is not yet."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp())
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a
    local session (tests, notebooks) gets a temporary one; on a cluster, whose machines do
    not share local folders, this is an error.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new path beside the checkpoints, for tables that several steps of a query share."""
    return f"{_checkpoint_folder(spark)}/{uuid.uuid4()}"
