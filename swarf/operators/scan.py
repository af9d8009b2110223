"""Order-dependent building blocks that never hold one key in one task.

A plain ``Window.partitionBy(key)`` sorts a whole key inside one task.  The functions here split every
key into *blocks* of consecutive rows first:

* ``order_blocks``  cuts large keys into blocks at sampled quantiles of their order, small keys keep one;
* ``running``       does prefix work (row index, running sums, last known values) in two levels: inside
  each block, and over one summary row per block;
* ``with_neighbours`` copies the rows next to a block border into the neighbouring block, so that
  bounded frames (lag, lead, moving averages) can be evaluated per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000
#: Drawn rows per block, and blocks per slice of a large key.
SAMPLES, SLICES = 64, 256
BLOCK = "_block"


def _cuts(picked: DataFrame, by: Sequence[str]) -> DataFrame:
    return picked.groupBy(*by).agg(F.sort_array(F.collect_list("_on")).alias("_cuts"))


def _passed(cuts: Column, place: Column) -> Column:
    """How many cuts are not above the place, by halving."""
    widths = F.array(*[F.lit(1 << k) for k in reversed(range(20))])
    step = lambda at, width: F.when(F.coalesce(F.get(cuts, at + width - 1) <= place, F.lit(False)), at + width).otherwise(at)
    return F.when(F.size(cuts) > 0, F.aggregate(widths, F.lit(0), step)).otherwise(0).cast("long")


def order_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block``: consecutive stretches of about ``rows`` rows of each key, in the order of the columns ``order``.

    Blocks are cut at sampled quantiles of the whole order, ties included, so neither a burst at one time nor a
    constant order value makes a large block; only rows equal in all of ``order`` stay together.  Rows are drawn by a hash
    of key and place, SAMPLES for each block, and ranked within their key; every SAMPLES-th is a cut.  Cuts form slices of
    SLICES blocks, so a row meets the few cuts between slices first and then those of its slice.  Keys far below
    ``rows`` rows are rarely drawn and keep one block.  Order columns may be numbers, dates or text; without keys the
    table is one sequence.
    """
    keys, chance = list(keys), SAMPLES / rows
    step = rows if chance >= 1 else SAMPLES
    placed = df.withColumn("_on", F.struct(*order))
    draw = F.pmod(F.xxhash64(F.lit(41), *keys, "_on"), F.lit(1 << 40))
    drawn = placed.select(*keys, "_on").filter(draw < int(min(chance, 1.0) * (1 << 40)))
    ranked = drawn.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_on")) - 1)
    picked = ranked.filter((F.col("_r") > 0) & (F.col("_r") % step == 0)).withColumns({"_slice": F.expr(f"_r div {step * SLICES}"), "_edge": F.col("_r") % (step * SLICES) == 0})
    coarse = _cuts(picked.filter("_edge"), keys)
    # one cut per SLICES blocks, so this side stays small at any size; without keys it is one value
    near = placed.join(F.broadcast(coarse), keys, "left") if keys else placed.withColumn("_cuts", coarse.select("_cuts").scalar())
    sliced = near.withColumn("_slice", _passed(F.col("_cuts"), F.col("_on"))).drop("_cuts")
    # one value per block; a shuffle by key and slice would gather SLICES blocks in one task
    inside = sliced.join(F.broadcast(_cuts(picked.filter("NOT _edge"), [*keys, "_slice"])), [*keys, "_slice"], "left")
    block = F.col("_slice") * (1 << 20) + _passed(F.col("_cuts"), F.col("_on"))
    return inside.withColumn(BLOCK, block).select(*df.columns, BLOCK)


def seq_blocks(df: DataFrame, seq: str = "seq", rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block`` from a dense position column."""
    return df.withColumn(BLOCK, F.floor(F.col(seq) / F.lit(rows)).cast("long"))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    index: str | None = None,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Prefix results up to and including each row, for a frame that carries ``_block``.

    ``index`` names a 0-based position, ``sums`` maps output names to summed expressions and ``lasts``
    maps output names to expressions whose last non-null value is carried forward.  Keys must not be null;
    without keys the whole table is one sequence.
    """
    sums, lasts = sums or {}, lasts or {}
    keys = list(keys)
    source = df.withColumns({**{f"_s_{n}": c for n, c in sums.items()}, **{f"_l_{n}": c for n, c in lasts.items()}})
    inner = W.partitionBy(*keys, BLOCK).orderBy(*order)
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    local, totals, carry, final = {}, [], {}, {}
    outer = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    if index:
        local["_i"] = F.row_number().over(inner) - 1
        totals.append(F.count(F.lit(1)).alias("_n"))
        carry["_ci"] = F.coalesce(F.sum("_n").over(outer), F.lit(0))
        final[index] = (F.col("_i") + F.col("_ci")).cast("long")
    for name in sums:
        local[f"_r_{name}"] = F.sum(f"_s_{name}").over(upto)
        totals.append(F.sum(f"_s_{name}").alias(f"_t_{name}"))
        carry[f"_c_{name}"] = F.sum(f"_t_{name}").over(outer)
        final[name] = F.coalesce(F.col(f"_r_{name}"), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
    for name in lasts:
        value = F.col(f"_l_{name}")
        local[f"_r_{name}"] = F.last(value, ignorenulls=True).over(upto)
        newest = F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("_v"))))
        totals.append(newest["_v"].alias(f"_t_{name}"))
        carry[f"_c_{name}"] = F.last(f"_t_{name}", ignorenulls=True).over(outer)
        final[name] = F.coalesce(F.col(f"_r_{name}"), F.col(f"_c_{name}"))
    per_block = source.groupBy(*keys, BLOCK).agg(*totals)
    joined = source.withColumns(local).join(
        per_block.select(*keys, BLOCK, *[c.alias(n) for n, c in carry.items()]), keys + [BLOCK]
    )
    kept = [c for c in df.columns if c != BLOCK]
    return joined.select(*kept, *[c.alias(n) for n, c in final.items()])


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "seq", rows: int = BLOCK_ROWS) -> DataFrame:
    """0-based position of each row inside its key."""
    return running(order_blocks(df, keys, order, rows), keys, order, index=name)


def with_neighbours(df: DataFrame, before: int, after: int, seq: str = "seq", rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block`` and ``_core``; rows near a border also appear, not core, in the next block.

    ``before`` / ``after`` bound the frame that will be evaluated and must not exceed ``rows``.
    """
    if max(before, after) > rows:
        raise ValueError("frame must not be longer than a block")
    home = F.floor(F.col(seq) / F.lit(rows)).cast("long")
    offset = F.col(seq) % F.lit(rows)
    copies = F.array_compact(
        F.array(
            home,
            F.when(offset >= rows - before, home + 1) if before else F.lit(None).cast("long"),
            F.when((offset < after) & (home > 0), home - 1) if after else F.lit(None).cast("long"),
        )
    )
    return df.withColumn("_home", home).withColumn(BLOCK, F.explode(copies)).withColumn(
        "_core", F.col("_home") == F.col(BLOCK)
    ).drop("_home")


def core_rows(df: DataFrame) -> DataFrame:
    """Drop the border copies again."""
    return df.filter("_core").drop("_core", BLOCK)
