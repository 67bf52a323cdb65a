"""Sharding by sampled splitters: quantiles of a size-weighted key sample cut ranges of equal bytes.

The key of a record is (hash of its text, number of its row), so copies of a text lie side by
side. A size-weighted sample of keys gives the splitters of many fine ranges; ranges that
come out overfull are sampled again and subdivided. Exact byte counts per range, carried on as
prefix sums, then place the shard boundaries inside the ranges, so shards differ by about one
document and not by the sampling error.

The law comes first: shards of near equal bytes. Texts that weigh more than ``BIG_SHARE`` of a
shard (single documents and groups of copies alike; so few that the driver may know them) are
dealt before all others, the largest to the emptiest shard, and the line of all other records
fills what these leave, so shards differ by about that share of a shard. Copies of a text
share a shard: small groups never straddle a boundary, and large ones stay whole unless that
took a shard above the mean by more than ``TOLERANCE``. Then the group is cut between its rows.

Defined results: a null text has size 8 like an empty one and the group of the empty text;
rows repeating a doc_id are placed each on its own, and rows equal in all columns too; an
empty table gives an empty result; fewer documents than shards leave shards empty; other
columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Ranges for each shard, and rows that a range holds at most on average.
RANGES_A_SHARD, RANGE_ROWS = 8, 2_000_000
#: Rows of a part of a large group: this share of all rows, within these bounds.
PART_SHARE, PART_ROWS = 256, 256
#: Sampled keys for each range.
SAMPLES_A_RANGE = 40
#: A text whose copies hold more than this part of a shard is dealt before all others.
BIG_SHARE = 0.001
#: How far above the mean a shard may come, as a part of it, to keep a group whole.
TOLERANCE = 0.002

LOWEST = -(1 << 63)


def splitters(sample: list[tuple[int, int, float]], ranges: int) -> list[tuple[int, int]]:
    """Quantile boundaries of weighted keys (hash, row, weight); each stands before all rows of its hash."""
    sample = sorted(sample)
    total, passed, cuts = sum(w for *_, w in sample), 0.0, []
    for h, _, w in sample:
        if passed > 0 and int(passed * ranges / total) < int((passed + w) * ranges / total):
            cuts.append((h, LOWEST))
        passed += w
    return sorted(set(cuts))


def _range_of(cuts: list[tuple[int, int]]):
    heads = np.array([h for h, _ in cuts], np.int64)

    @F.pandas_udf("int")
    def number(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(heads, h.to_numpy(), "right").astype(np.int32))

    return number(F.col("h"))


def _sample(records: DataFrame, total: int, wanted: int, seed: int) -> list[tuple[int, int, float]]:
    """About ``wanted`` keys, drawn with chances in proportion to size."""
    chance = F.col("size") * F.lit(wanted / total)
    drawn = F.pmod(F.xxhash64("row", "h", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = records.where(drawn < chance).select("h", "row", F.greatest(F.col("size").cast("double"), F.lit(total / wanted)))
    return [(r[0], r[1], r[2]) for r in rows.collect()]


def deal_groups(groups: list[tuple[int, int, int]], shards: int, total: int, tolerance: float = TOLERANCE) -> tuple[dict[int, list[tuple[int, int]]], list[float]]:
    """Shards of the groups (hash, bytes, rows), and where the shards begin on the line of all the rest.

    A group is a list of (shard, rows). The largest goes to the emptiest shard. Where that
    comes above the mean by more than ``tolerance``, the shard takes the rows that it has room
    for, one at least, and the others are a group of their own. The rest then levels the shards:
    each takes what it lacks to the lowest level at which all of the rest finds room.
    """
    mean = total / shards
    empty, into = [(0, s) for s in range(shards)], {h: Counter() for h, *_ in groups}
    waiting = [(-size, h, n) for h, size, n in groups]
    heapify(waiting)
    while waiting:
        size, h, n = heappop(waiting)
        load, shard = heappop(empty)
        row, taken = -size // n, n
        if n > 1 and load - size > mean * (1 + tolerance):
            taken = min(n, max(1, int((mean - load) // row)))
        into[h][shard] += taken
        heappush(empty, (load + row * taken, shard))
        if taken < n:
            heappush(waiting, (-row * (n - taken), h, n - taken))
    loads = [0] * shards
    for load, shard in empty:
        loads[shard] = load
    rest, level, below = total - sum(loads), 0.0, sorted(loads)
    for n in range(1, shards + 1):
        level = (rest + sum(below[:n])) / n
        if n == shards or level <= below[n]:
            break
    begins, at = [], 0.0
    for own in loads:
        begins.append(at)
        at += max(0.0, level - own)
    return {h: list(own.items()) for h, own in into.items()}, begins


def shard_documents(docs: DataFrame, shards: int = 24, big_share: float = BIG_SHARE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    records = checkpointed(
        docs.select(
            "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"),
        )
    )
    n, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    held = records.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    ranges = max(RANGES_A_SHARD * shards, -(-n // range_rows))
    least = min(big_share, shards / (2 * ranges))  # of a shard; never more than half a range
    big = held.where(F.col("bytes") * shards > least * total).collect()  # shards / least of them at most
    where, begins = deal_groups([(r["h"], r["bytes"], r["n"]) for r in big], shards, total)
    # rows of big groups are numbered in parts of bounded size; the parts come after all ranges
    parts, part_of, part_rows = 0, [], min(range_rows, max(PART_ROWS, n // PART_SHARE))
    for r in big:
        own = -(-r["n"] // part_rows)
        placed, ends = where[r["h"]], np.cumsum([k for _, k in where[r["h"]]]).tolist()
        part_of.append((r["h"], [shard for shard, _ in placed], ends, parts, own))
        parts += own
    layout = F.broadcast(spark.createDataFrame(part_of, "h long, into array<int>, ends array<long>, first_part int, parts int"))
    records = records.join(layout, "h", "left")

    line_bytes, line_rows = total - sum(r["bytes"] for r in big), n - sum(r["n"] for r in big)
    line = records.where("parts IS NULL")
    cuts = splitters(_sample(line, line_bytes, SAMPLES_A_RANGE * ranges, 0), ranges) if line_rows else []
    for seed in range(1, 6):
        tagged = line.withColumn("range", _range_of(cuts))
        found = {r["range"]: (r["n"], r["bytes"]) for r in tagged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
        full = {k: b for k, (rows, b) in found.items() if rows > 1 and (b > 2 * line_bytes / ranges or rows > 2 * range_rows)}
        if not full or seed == 5:
            break
        more = []
        inside = _sample(tagged.where(F.col("range").isin(list(full))), sum(full.values()), SAMPLES_A_RANGE * 2 * len(full), seed)
        of_range: dict[int, list] = {}
        for x in inside:
            of_range.setdefault(bisect_right(cuts, x[:2]), []).append(x)
        for k, size in full.items():
            more += splitters(of_range.get(k, []), max(2, round(size * ranges / line_bytes)))
        if set(more) <= set(cuts):
            break
        cuts = sorted({*cuts, *more})

    passed, bases = 0, []
    for k in sorted(found):
        bases.append((k, passed))
        passed += found[k][1]
    base = F.broadcast(spark.createDataFrame(bases, "range int, bytes_before long"))
    order = Window.partitionBy("range").orderBy("h", "row")
    copies = Window.partitionBy("range", "h")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = (
        tagged.withColumn("number", F.row_number().over(order)).withColumn("before", before).join(base, "range")
        # the groups on the line go where they begin
        .withColumn("before", F.col("bytes_before") + F.min("before").over(copies))
        .withColumn("shard", (F.size(F.filter(F.array(*map(F.lit, begins)), lambda b: b <= F.col("before"))) - 1).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "range", "number")
    )
    part = F.col("first_part") + F.pmod("row", F.col("parts")).cast("int") + F.lit(1 + max(found, default=0))
    dealt = records.where("parts IS NOT NULL").withColumn("range", part)
    # a row's number in its group says which of the group's shards it goes to
    earlier = Window.partitionBy("h").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead_of = dealt.groupBy("h", "range").agg(F.count("*").alias("n")).select("h", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    dealt = dealt.withColumn("number", F.row_number().over(order)).join(ahead_of, ["h", "range"]).withColumn("at", F.col("ahead") + F.col("number"))
    shard = F.element_at("into", F.size(F.filter("ends", lambda e: e < F.col("at"))) + 1)
    dealt = dealt.select("doc_id", "size", "text_crc32", shard.alias("shard"), "range", "number")
    placed = checkpointed(placed.unionByName(dealt))
    # rows of a shard and a range are numbered without gaps; the ranges of a shard follow one another
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"), F.min("number").alias("lowest"))
    ahead = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "range", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("lowest")).alias("shift"))
    return placed.join(firsts, ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("shift") + F.col("number")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, shards: int = 24) -> None:
    """Write documents of unique ids as one folder a shard, ordered by slot within each file."""
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
