"""Identity of rows where a doc_id is null or not unique, and rows that share a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups that are broadcast at most: those that hold more than this part of all rows.
HOT_GROUPS = 4096


def row_key() -> Column:
    """64-bit digest of doc_id and text: rows with both equal share it, all others differ."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """``rows`` with the columns of their group (one row per ``keys``; ``size`` is how many rows it has).

    Groups of more than 1 / ``hot_groups`` of all ``total`` rows are so few that they are
    broadcast, and their rows stay where they are; the rest meets in a shuffled join, in which
    no key has more than that part. Give checkpointed inputs, as both are read twice.
    """
    most = max(1, total // hot_groups)
    hot = F.broadcast(groups.where(F.col(size) > most))
    others = rows.join(F.broadcast(groups.where(F.col(size) > most).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(others.join(groups.where(F.col(size) <= most), keys))
