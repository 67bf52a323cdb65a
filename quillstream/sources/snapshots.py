"""Versioned tables with an atomic pointer: readers see one whole version while writers publish the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that stay when older ones are removed.
KEPT_VERSIONS = 3


class Snapshots:
    """A table as numbered versions under a folder that driver and executors share.

    A version is written in full to a folder of its own. It exists from the moment when its
    marker file is created, which only one writer can do; a version without a marker is
    invisible. ``read`` settles on one version, so what it returns does not change while others
    write. A version is never changed, and old ones go only when ``vacuum`` is called.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def versions(self) -> list[int]:
        """Numbers of the published versions, ascending."""
        fs, p = self._fs(f"{self.path}/_published")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []

    def folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest version (or the one asked for); None where there is none."""
        known = self.versions()
        if version is None and not known:
            return None
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"no version {version}")
        return self.spark.read.parquet(self.folder(version))

    def publish(self, rows: DataFrame, version: int | None = None) -> bool:
        """Write ``rows`` as the next version (or this one) and publish it; False if another writer came first.

        With a version given, publishing it again changes nothing, so a repeated batch is harmless.
        """
        known = self.versions()
        number = (known[-1] + 1 if known else 0) if version is None else version
        if number in known:
            return False
        # a lost attempt may have left files; each attempt has its own folder until it is renamed
        draft = f"{self.path}/_draft/{self._jvm.java.util.UUID.randomUUID()}"
        rows.write.parquet(draft)
        fs, target = self._fs(self.folder(number))
        if number not in self.versions() and fs.exists(target):
            fs.delete(target, True)
        fs.mkdirs(target.getParent())
        if not fs.rename(self._jvm.org.apache.hadoop.fs.Path(draft), target):
            return False
        fs.mkdirs(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_published"))
        try:
            fs.create(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_published/{number}"), False).close()
        except Exception as e:  # the JVM says that the marker exists
            if "exist" in str(e).lower():
                return False
            raise
        return True

    def update(self, change: Callable[[DataFrame | None], DataFrame], version: int | None = None) -> bool:
        """Publish what ``change`` makes of the newest version."""
        return self.publish(change(self.read()), version)

    def vacuum(self, keep: int = KEPT_VERSIONS) -> None:
        """Remove all but the newest ``keep`` versions; markers go first."""
        for number in self.versions()[:-keep]:
            fs, marker = self._fs(f"{self.path}/_published/{number}")
            fs.delete(marker, False)
            fs.delete(self._jvm.org.apache.hadoop.fs.Path(self.folder(number)), True)


def replaced(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """``old`` with all rows of the keys of ``new`` replaced by its rows; columns that one side lacks are null."""
    if old is None:
        return new
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


#: What a session has where nothing is stored.
SESSION_KIND, SESSION_SCOPE = "academic_impact_analysis", "candidate_spans"


def with_defaults(sessions: DataFrame) -> DataFrame:
    """Sessions (session_id and whatever else is stored) with every field that readers rely on."""
    have = {f.name: f for f in sessions.schema.fields}
    text = lambda name, default: F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in have else F.lit(default)
    flag = lambda name: F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in have else F.lit(False)
    count = F.coalesce(F.col("paper_count").cast("long"), F.lit(0).cast("long")) if "paper_count" in have else F.lit(0).cast("long")
    warnings = F.coalesce(F.col("warnings"), F.array().cast("array<string>")) if "warnings" in have else F.array().cast("array<string>")
    defaults = {
        "query": text("query", ""), "session_kind": text("session_kind", SESSION_KIND), "analysis_scope": text("analysis_scope", SESSION_SCOPE),
        "task_status": text("task_status", "idle"), "task_active": flag("task_active"), "paper_count": count, "warnings": warnings,
    }
    return sessions.select("session_id", *(c.alias(n) for n, c in defaults.items()), *(n for n in have if n not in {"session_id", *defaults}))
