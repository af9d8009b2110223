"""Sharding by sampled splitters: range partition of records at size-weighted quantiles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarf.llm.common import checkpointed, shared_folder, unpacked
from swarf.operators.scan import order_blocks, running

LOWEST = -(1 << 63)


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are not above the key (_hash, _tie): a binary search in steps of falling powers of two."""
    if not splitters:
        return F.lit(0)
    depth = len(splitters).bit_length()
    padded = splitters + [(None, None)] * ((1 << depth) - 1 - len(splitters))
    hashes = F.array(*[F.lit(h).cast("long") for h, _ in padded])
    ties = F.array(*[F.lit(t).cast("long") for _, t in padded])

    def step(at: Column, width: Column) -> Column:
        h, t = F.get(hashes, at + width - 1), F.get(ties, at + width - 1)
        above = (F.col("_hash") > h) | ((F.col("_hash") == h) & (F.col("_tie") >= t))
        return F.when(F.coalesce(above, F.lit(False)), at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(depth))]), F.lit(0), step)


def _sample(keys: DataFrame, chance: Column, seed: int) -> list:
    """Keys drawn with the given chance by a hash of the key; the caller bounds the expected number."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "_hash", "_tie"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return keys.filter(draw < chance).select("_hash", "_tie", "_weight").distinct().sort("_hash", "_tie").collect()


def _quantiles(rows: list, least: float, step: float) -> list[tuple[int, int]]:
    """Keys after each ``step`` of weight; a drawn key stands for its weight, at least ``least``."""
    found, gathered = [], 0.0
    for row in rows:
        gathered += max(least, row["_weight"])
        if gathered >= step:
            found.append((row["_hash"], row["_tie"]))
            gathered = 0.0
    return found


def splitters(keys: DataFrame, ranges: int, draws: int, seed: int, rounds: int = 3) -> list[tuple[int, int]]:
    """Boundaries of about ``ranges`` key ranges of equal weight (_weight sums to 1).

    The first draw holds about ``ranges * draws`` keys, weighted by size.  Ranges measured above twice their share are
    drawn again at a higher rate and subdivided, at most ``rounds`` times.  Both samples are bounded by these parameters.
    """
    share = 1.0 / ranges
    least = share / draws
    found = _quantiles(_sample(keys, F.col("_weight") / least, seed), least, share)
    for k in range(rounds):
        measured = keys.groupBy(_range_of(found).alias("_range")).agg(F.sum("_weight").alias("w"), F.max("_weight").alias("most"), F.min(F.struct("_hash", "_tie")).alias("lo"), F.max(F.struct("_hash", "_tie")).alias("hi"))
        over = measured.filter((F.col("w") > 2 * share) & (F.col("lo") < F.col("hi")) & (F.col("w") > F.col("most") + share)).select("_range").collect()
        if not over:
            break
        drawn = _sample(keys.filter(_range_of(found).isin([r["_range"] for r in over])), F.col("_weight") * 4 / least, seed + k + 1)
        more = sorted({*found, *_quantiles(drawn, least / 4, share)})
        if more == found:
            break
        found = more
    return found


def shard(docs: DataFrame, shards: int = 8, ranges: int = 512, draws: int = 32, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents (or their columns ``keep``) with ``_size`` (UTF-8 bytes and 1), ``_crc``, ``_shard`` and ``_slot``; law ``bytes``.

    The key is (hash of the text, hash of the id), so equal texts are neighbours and share a shard unless a boundary falls
    within them.  Ranges bound both bytes and rows: a record weighs half its part of the bytes and half its part of the
    rows.  Within its range a record's place is a running sum over blocks of bounded length, whatever the size of the
    range; ranges add the bytes before them, and a shard takes the records that begin within its equal part of all bytes.
    Slots count from 0 in the same order.

    Null and empty texts have size 1 and equal keys but for their ids; repeated rows are neighbours in any order; an empty
    table gives an empty result; other columns pass through, but those named like an added one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = docs.select(*keep) if keep is not None else docs
    row = F.struct(*[F.col(f"`{c}`") for c in carried.columns]).alias("_row")
    keyed = docs.select(row, (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), F.xxhash64(text).alias("_hash"), F.xxhash64(F.col(id_col)).alias("_tie"))
    keys = checkpointed(keyed.select("_size", "_hash", "_tie"))
    rows, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    weighed = keys.withColumn("_weight", F.col("_size") / F.lit(2.0 * max(total, 1)) + F.lit(0.5 / max(rows, 1)))
    # written with its range as a table, so that the text is read for it once and the plan forgets how ranges come about
    folder = f"{shared_folder(docs.sparkSession)}/ranged-{uuid.uuid4().hex}"
    keyed.withColumn("_range", _range_of(splitters(weighed, ranges, draws, seed))).write.parquet(folder)
    ranged = docs.sparkSession.read.parquet(folder)
    per_range = ranged.groupBy("_range").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"))
    order = ["_hash", "_tie", "_size"]
    ran = running(order_blocks(ranged, ["_range"], order), ["_range"], order, index="_rank", sums={"_end": F.col("_size")})
    # one row per range: bounded by the parameters of splitters()
    at = ran.join(F.broadcast(offsets), "_range")
    begin = F.col("_end") - F.col("_size") + F.col("_bytes_before")
    placed = checkpointed(at.withColumns({"_shard": F.floor(begin * F.lit(shards) / F.lit(max(total, 1))).cast("int"), "_rank": F.col("_rank") + F.col("_rows_before")}))
    firsts = {r["_shard"]: r["_first"] for r in placed.groupBy("_shard").agg(F.min("_rank").alias("_first")).collect()}
    first = F.lit(0)
    for number, begin in firsts.items():
        first = F.when(F.col("_shard") == number, F.lit(begin)).otherwise(first)
    slotted = placed.withColumn("_slot", (F.col("_rank") - first).cast("long"))
    return unpacked(slotted, carried, "_size", "_crc", "_shard", "_slot")


def op8_shard(docs: DataFrame) -> DataFrame:
    """Shard and slot of every document."""
    return digest(shard(docs, keep=["doc_id"]))


def digest(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
