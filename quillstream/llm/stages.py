"""The operators as stages that take documents and return documents (or packed pieces).

Defined results, for all stages: documents need the columns doc_id and text; any others pass
through the stages that return documents, whatever their names (n_chars, if present, is that
of the text that stays). A null text counts as empty. A row is a document of its own: rows
that lack an id, or share one, are told apart by their texts, and rows equal in both are kept
or dropped as one document that occurs once. An empty table gives an empty result.
``keep_good`` scores a null or empty text as one empty line; ``drop_copies`` keeps one of all
empty texts; ``drop_near_copies`` keeps every text without words; ``cut_repeats`` turns a null
text into an empty one; ``pack`` gives an empty text the end token alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from . import exact_dedup, near_dedup, packing, quality, suffix_dedup
from .queries import WORD_MODEL
from .rows import row_key

#: Keys of rows to drop are broadcast up to this count; beyond it the join shuffles.
BROADCAST_IDS = 500_000
#: Near duplicates: word shingles of this length, of this similarity or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _matching(docs: DataFrame, rows: DataFrame, kind: str, broadcast_ids: int) -> DataFrame:
    """``docs`` with ('left_semi') or without ('left_anti') the rows of these distinct keys (doc_id, row_key)."""
    id_name, key_name = _free(docs, "id_to_match"), _free(docs, "key_to_match")
    rows = rows.select(F.col("doc_id").alias(id_name), F.col("row_key").alias(key_name))
    if rows.count() <= broadcast_ids:
        rows = F.broadcast(rows)
    return docs.join(rows, (row_key() == F.col(key_name)) & F.col("doc_id").eqNullSafe(F.col(id_name)), kind)


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every column but doc_id and text under a name that no operator uses; new names to old ones."""
    names = {c if c in ("doc_id", "text") else f"carried_{k}": c for k, c in enumerate(docs.columns)}
    return docs.toDF(*names), names


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(quality.training_rows(docs), quality.training_rows(labels))
    plain, names = _renamed(docs)
    return quality.score_quality(plain, model).where("score >= 0.5").drop("score").toDF(*names.values())


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row of each group of equal texts, whether or not ids are null or repeated."""
    found = exact_dedup.exact_duplicates(docs, keys=True).groupBy("doc_id", "row_key").agg(F.max("kept").alias("stays"), F.min("kept").alias("once"))
    found = checkpointed(found.where("NOT stays OR NOT once"))
    rest = _matching(docs, found.where("NOT stays"), "left_anti", broadcast_ids)
    repeated = found.where("stays")
    if repeated.isEmpty():
        return rest
    again = _matching(rest, repeated, "left_semi", broadcast_ids)
    once = again.dropDuplicates(["doc_id", "text"])
    return _matching(rest, repeated, "left_anti", broadcast_ids).unionByName(once)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One document (the smallest doc_id, null after all others) of each group of near duplicates."""
    found = near_dedup.near_duplicates(docs, NEAR_WORDS, NEAR_PERCENT, 100, by_row=True)
    return _matching(docs, checkpointed(found.where("NOT kept").select("doc_id", "row_key").distinct()), "left_anti", broadcast_ids)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that start earlier as well; n_chars follows the text."""
    plain, names = _renamed(docs)
    carried = tuple(n for n, c in names.items() if c not in ("doc_id", "text", "n_chars"))
    found = suffix_dedup.remove_repeats(plain, carry=carried, characters=True)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*(new.get(c, F.col(n)).alias(c) for n, c in names.items()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: where it lies in which sequence."""
    pieces = packing.window_pieces(docs, WORD_MODEL)
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests, *packing.extent(docs))


def written(df: DataFrame) -> DataFrame:
    """Write to a new folder beside the checkpoints and read it again."""
    spark = df.sparkSession
    checkpointed(spark.range(0))  # makes sure that there is a checkpoint folder
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)
