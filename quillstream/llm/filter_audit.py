"""Audit of five filters in all 120 orders: what each removes, alone and after the others.

A document fails a set of filters, a mask of five bits. Which step of an order removes it is a
lookup in a table of 32 masks by 120 orders, made once. Masks of the four filters of a text are
Columns; the fifth (a text that a smaller doc_id has as well) comes from the groups of equal
texts, told by their sha256. Documents meet the table as counts by part, mask and label: each
task looks its counts up, np.bincount adds them by part, order and step, and the partial
arrays of all tasks are summed.

Copies of a text are pre-aggregated before they move, so that a text that a third of all rows
share reaches a task as one row a part and label.

Defined results: a null text counts as empty, and fails A and (from its second id on) E; a null
source and an empty one are the part of the empty string; a null doc_id comes after all others,
and rows sharing the smallest doc_id of a text are none of them copies; a document has a label
where any row of labels with its doc_id says 1, and a null doc_id has none; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 50, 65, 5, "[#$%&*|]"
#: Parts whose arrays a task holds before it hands them on.
HELD_PARTS = 256
#: Rows without an id are spread over this many keys where they look for labels.
NULL_SALTS = 1024

_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_WHITE = r"[\x20\x09-\x0D]+"


def first_failures() -> np.ndarray:
    """[mask, order]: the step (0 to 4) whose filter is the first of the order that the mask fails; 5 if none."""
    place = np.array([[order.index(f) for f in FILTERS] for order in ORDERS])
    fails = (np.arange(1 << len(FILTERS))[:, None] >> np.arange(len(FILTERS))) & 1
    return np.where(fails[:, None, :] == 1, place[None], len(FILTERS)).min(2)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: how many documents of a part and label fail which filters (A is bit 0)."""
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    words = F.array_remove(F.split("body", _WHITE), "")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("body"), digest.alias("digest"))
    rows = rows.withColumn("words", words).withColumn("distinct", F.size(F.array_distinct("words"))).withColumn("words", F.size("words"))
    capitals = F.length("body") - F.length(F.regexp_replace("body", "[A-Z]+", ""))
    mask = (
        F.when(F.col("words") < LEAST_WORDS, 1).otherwise(0)
        + F.when(100 * F.col("distinct").cast("long") < DISTINCT_PERCENT * F.col("words").cast("long"), 2).otherwise(0)
        + F.when(100 * capitals.cast("long") > CAPITAL_PERCENT * F.length("body").cast("long"), 4).otherwise(0)
        + F.when(F.col("body").rlike(SIGNS), 8).otherwise(0)
    )
    rows = rows.select("doc_id", "part", "digest", mask.alias("mask")).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias
    named = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("named")).agg(says("quality")("good"), says("toxic")("toxic"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_SALTS))).otherwise(0)
    rows = rows.withColumn("salt", salt).join(named.withColumn("named_salt", F.lit(0).cast("long")), (F.col("doc_id") == F.col("named")) & (F.col("salt") == F.col("named_salt")), "left")
    rows = rows.withColumn("good", F.coalesce("good", F.lit(False))).withColumn("toxic", F.coalesce("toxic", F.lit(False)))
    held = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.coalesce(F.min_by("n", "doc_id"), F.sum("n")).alias("n_low")
    )
    lowest = held.withColumn("lowest", F.min("low").over(Window.partitionBy("digest")))
    firsts = F.when(F.col("low").eqNullSafe(F.col("lowest")), F.col("n_low")).otherwise(0)
    split = lowest.withColumn("firsts", firsts).select(
        "part", "good", "toxic",
        F.inline(F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))),
    )
    return split.where("n > 0")


def audit_arrays(counts: np.ndarray, table: np.ndarray) -> dict[str, np.ndarray]:
    """The seven counts as [part, order, step], from ``counts``, [part, mask, (all, good, toxic)]."""
    parts, steps, orders = len(counts), len(FILTERS), len(ORDERS)
    at = (np.arange(parts)[:, None, None] * orders + np.arange(orders)) * (steps + 1) + table[None]  # [part, mask, order]
    tally = lambda kind: np.bincount(at.ravel(), np.repeat(counts[:, :, kind].ravel(), orders), parts * orders * (steps + 1)).reshape(parts, orders, -1)[:, :, :steps].astype(np.int64)
    removed, letter = tally(0), np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    fails = (np.arange(1 << steps)[:, None] >> np.arange(steps)) & 1
    failing, alone = counts[:, :, 0] @ fails, counts[:, 1 << np.arange(steps), 0]
    by_filter = np.zeros((parts, steps), np.int64)
    np.add.at(by_filter, (np.arange(parts)[:, None, None], letter[None]), removed)
    return {
        "kept": counts[:, :, 0].sum(1)[:, None, None] - removed.cumsum(2),
        "removed": removed,
        "redundant": failing[:, letter] - removed,
        "unique_fails": alone[:, letter],
        "good_lost": tally(1),
        "toxic_lost": tally(2),
        "shapley": by_filter[:, letter],
    }


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step with the seven counts."""
    ship(docs.sparkSession)
    table, width = first_failures(), 1 << len(FILTERS)

    def arrays(names: list[str], counts: np.ndarray) -> pa.RecordBatch:
        found, rows = audit_arrays(counts, table), len(ORDERS) * len(FILTERS)
        columns = [pa.array(np.repeat(np.array(names, object), rows), pa.string()), pa.array(np.tile(np.repeat(np.array(ORDERS, object), len(FILTERS)), len(names)), pa.string())]
        columns.append(pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(names) * len(ORDERS))))
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(found[c].ravel()) for c in _COUNTS)], ["part", "filter_order", "step", *_COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            names, part = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            n, mask = batch.column("n").to_numpy(), batch.column("mask").to_numpy()
            kinds = [n, n * batch.column("good").to_numpy(zero_copy_only=False), n * batch.column("toxic").to_numpy(zero_copy_only=False)]
            sums = np.stack([np.bincount(part * width + mask, k, len(names) * width).astype(np.int64).reshape(-1, width) for k in kinds], 2)
            for k, name in enumerate(names):
                held[name] = held[name] + sums[k] if name in held else sums[k]
                if len(held) >= HELD_PARTS:
                    yield arrays(list(held), np.stack(list(held.values())))
                    held = {}
        if held:
            yield arrays(list(held), np.stack(list(held.values())))

    kind = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)
    partial = masks(docs, labels).mapInArrow(run, kind)
    return partial.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in _COUNTS))
