"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sources share a wanted total by weight; a target stops at ``repeats`` times the words of its
source, and the excess is shared by the others until none is above. Slot i of the schedule has
the golden-ratio point frac(i * 0.618...); the cumulative targets cut [0, 1) into one interval
a source, and the interval that holds the point says whose turn it is. The r-th slot of a
source takes its r-th block of ``block_words`` words: block r of the line of all its
documents, shuffled anew for each time round. The last block ends where the target does, so
a source gives its target to the word. The points leave a source a few blocks short at most
(their discrepancy grows with the logarithm of the slots); these follow after the last point.

Everything is DataFrame functions. No window holds a whole source: documents are summed in
buckets of their shuffled order and slots in chunks, and the totals of buckets and chunks
carry the sums on. A window over all sources (one row each) orders and levels them.

Defined results: a null or empty text, or one of white space only, has size 0 and is taken 0
times; a null source is a source of its own, after all others; a source without words has
target 0; rows that lack or share a doc_id are documents of their own, and so are rows equal
in all columns (which of these is taken more often is left open, as they do not differ); an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Weights of the sources in order, repeating; their part of all words; how often a document may be taken.
WEIGHTS, SHARE, REPEATS = (3.0, 1.0, 2.0), 1.5, 2
#: Words of a block.
BLOCK_WORDS = 2048
#: Points are integers below 2**40; the step is the golden section of that, made odd.
POINT_BITS = 40
GOLDEN = int(2**POINT_BITS * 0.6180339887498949) | 1
#: Buckets and chunks in all, where these have a size within the bounds (rows of one).
PARTS, BUCKET_ROWS, CHUNK_SLOTS = 4096, (256, 100_000), (1024, 65_536)
#: Equal rows that lie on the line as one entry.
ENTRY_COPIES = 10_000
#: Source tables up to this many rows are broadcast; beyond it the joins shuffle.
BROADCAST_SOURCES = 10_000
SEED = 11

_WHITE = r"[\x20\x09-\x0D]+"


def entries(docs: DataFrame, copies: int = ENTRY_COPIES) -> DataFrame:
    """doc_id, source, size, digest, part, copies: rows equal in doc_id, source and text as one entry, or several of bounded size."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", "source", F.size(F.array_remove(F.split(text, _WHITE), "")).cast("long").alias("size"), F.unhex(F.md5(text.cast("binary"))).alias("digest")
    )
    held = rows.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("held"))
    held = held.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((held - 1) DIV {copies} AS INT)"))).alias("part"))
    return held.withColumn("copies", F.least(F.lit(copies), F.col("held") - F.col("part") * copies)).drop("held")


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, number, source_size, entries, weight, target: one row per source of ``entries``.

    With the sources in the order of cap / weight, those at their cap are a first part of the
    order; the others share what is left by weight.
    """
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("entries"))
    numbered = sums.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    capped = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order, everything = Window.orderBy("ratio", "number"), Window.partitionBy()
    filled = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    goal = F.sum("source_size").over(everything) * F.lit(share)
    levelled = capped.withColumn("level", (goal - filled) / open_weight)
    free = F.col("ratio") > F.col("level")
    shared = F.max(F.when(free, F.col("level"))).over(everything)
    target = F.when(free, F.col("weight") * shared).otherwise(F.col("cap").cast("double"))
    return levelled.withColumn("target", target).select("source", "number", "source_size", "entries", "weight", "target")


def _point(slot):
    """slot * GOLDEN modulo 2**40, without leaving 64 bits."""
    half, golden = 1 << (POINT_BITS // 2), F.lit(GOLDEN)
    high, low = F.floor(slot / half) % half, slot % half
    return ((high * golden) % half * half + low * golden) % F.lit(1 << POINT_BITS)


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """slot, number, block: which block of which source stands at which slot.

    ``sources`` is that of ``targets``. Slots that fall to a source whose blocks are used up
    stay free.
    """
    spark = sources.sparkSession
    words = F.floor("target").cast("long")
    total, count = sources.agg(F.coalesce(F.sum(words), F.lit(0)), F.count("*")).first()
    slots = -(-total // block_words)
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    high = F.round(F.sum("target").over(before) / F.sum("target").over(Window.partitionBy()) * float(1 << POINT_BITS)).cast("long")
    cut = sources.where("target >= 1").select("number", F.ceil(words / block_words).alias("quota"), "target", high.alias("high"))
    cut = cut.withColumn("low", F.lag("high", 1, 0).over(Window.orderBy("number"))).select("number", "quota", "low", "high")

    # a point meets the interval that holds it on a grid of equal cells: about one interval a cell
    bits = max(10, (16 * count).bit_length())
    cell = 1 << (POINT_BITS - bits)
    grid = cut.where("high > low").select("number", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))).alias("cell"))
    chunk_slots = min(max(-(-slots // PARTS), CHUNK_SLOTS[0]), CHUNK_SLOTS[1])
    points = spark.range(slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("point"), F.floor(F.col("id") / chunk_slots).alias("chunk"))
    small = count <= broadcast_sources
    turns = points.withColumn("cell", F.floor(F.col("point") / cell)).join(F.broadcast(grid) if small else grid, "cell")
    turns = turns.where("point >= low AND point < high").select("slot", "chunk", "number")

    in_chunk = Window.partitionBy("chunk", "number").orderBy("slot")
    earlier = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = turns.groupBy("chunk", "number").agg(F.count("*").alias("n"))
    firsts = counts.select("chunk", "number", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    ranked = turns.withColumn("at", F.row_number().over(in_chunk) - 1).join(firsts, ["chunk", "number"]).withColumn("block", F.col("first") + F.col("at"))
    quotas = cut.select("number", "quota")
    used = ranked.join(F.broadcast(quotas) if small else quotas, "number").where("block < quota").select("slot", "number", "block")

    given = counts.groupBy("number").agg(F.sum("n").alias("given"))
    short = quotas.join(given, "number", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("quota > given")
    late = short.select("number", "given", F.explode(F.sequence("given", F.col("quota") - 1)).alias("block"))
    late = late.select((F.lit(slots) + (F.col("block") - F.col("given")) * count + F.col("number")).alias("slot"), "number", "block")
    return used.unionByName(late)


def lines(rows: DataFrame, sources: DataFrame, seed: int = SEED, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The entries with number, start and end: where they lie on the shuffled line of their source, up to its target."""
    total, count = sources.agg(F.coalesce(F.sum("entries"), F.lit(0)), F.count("*")).first()
    bucket_rows = min(max(-(-total // PARTS), BUCKET_ROWS[0]), BUCKET_ROWS[1])
    own = sources.select("source", "number", F.floor("target").cast("long").alias("words"), "source_size", F.ceil(F.col("entries") / bucket_rows).alias("buckets"))
    named = own.withColumnRenamed("source", "named").where("words > 0")
    named = F.broadcast(named) if count <= broadcast_sources else named
    placed = rows.where("size > 0").join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    placed = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.expr("CAST((words - 1) DIV source_size AS INT)"))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lower(F.hex("digest")), "part"))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("key", key).withColumn("bucket", F.floor(place * F.col("buckets") / float(1 << 32)))
    placed = placed.withColumn("width", F.col("size") * F.col("copies"))
    inside = Window.partitionBy("number", "epoch", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("number").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("number", "epoch", "bucket").agg(F.sum("width").alias("all"))
    firsts = sums.select("number", "epoch", "bucket", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("first"))
    placed = placed.withColumn("inside", F.sum("width").over(inside) - F.col("width")).join(firsts, ["number", "epoch", "bucket"])
    placed = placed.withColumn("start", F.col("first") + F.col("inside")).where("start < words")
    return placed.select("doc_id", "source", "size", "digest", "part", "copies", "number", "start", F.least(F.col("start") + F.col("width"), "words").alias("end"))


def pieces(laid: DataFrame, plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: slot, offset in it, and doc_id, source, digest, part, copy, word, length of the words that stand there.

    ``laid`` is that of ``lines``, ``plan`` that of ``schedule``.
    """
    b = F.lit(block_words)
    cut = laid.withColumn("block", F.explode(F.expr(f"sequence(start DIV {block_words}, (end - 1) DIV {block_words})")))
    cut = cut.withColumn("low", F.greatest("start", F.col("block") * b)).withColumn("high", F.least("end", (F.col("block") + 1) * b))
    met = cut.join(plan, ["number", "block"])
    met = met.withColumn("copy", F.explode(F.expr("sequence((low - start) DIV size, (high - 1 - start) DIV size)")))
    begin = F.col("start") + F.col("copy") * F.col("size")
    met = met.withColumn("begin", begin).withColumn("low", F.greatest("low", "begin")).withColumn("high", F.least("high", F.col("begin") + F.col("size")))
    return met.select(
        "slot", (F.col("low") - F.col("block") * b).alias("offset"), "doc_id", "source", "size", "digest", "part", "copy",
        (F.col("low") - F.col("begin")).alias("word"), (F.col("high") - F.col("low")).alias("length"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pieces of the mix, the entries of ``docs`` and the targets of their sources."""
    rows = checkpointed(entries(docs))
    sources = checkpointed(targets(rows, weights, share, repeats))
    return pieces(lines(rows, sources, seed), schedule(sources, block_words), block_words), rows, sources


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words the mix takes of each document, repeats counted."""
    found, rows, sources = mix(docs, **how)
    keys = ["doc_id", "source", "size", "digest", "part", "copy"]
    none = rows.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).select(*keys, F.lit(0).cast("long").alias("length"))
    taken = none.unionByName(found.select(*keys, "length")).groupBy(*keys).agg(F.sum("length").alias("taken"))
    named = sources.select(F.col("source").alias("named"), "source_size", "target")
    named = F.broadcast(named) if sources.count() <= BROADCAST_SOURCES else named
    return taken.join(named, F.col("source").eqNullSafe(F.col("named"))).select("doc_id", "size", "source_size", "target", "taken")
