"""Train / validation / test splits and deterministic few-shot samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swarf.functions.hashing import hash_fraction
from swarf.operators.scan import order_blocks, running
from swarf.rules.catalog import GROUP_COLUMNS


def condition_split(df: DataFrame, test: Sequence[str] = ("c6",), val: Sequence[str] = ("c5",), column: str = "condition_id") -> DataFrame:
    """Whole conditions go to test, then validation, else train."""
    c = F.col(column)
    return df.withColumn("split", F.when(c.isin(list(test)), "test").when(c.isin(list(val)), "val").otherwise("train"))


def leave_one_out(records: DataFrame, field: str, order: str, value=None) -> DataFrame:
    """Hold out one field value, by default the last non-null one in order; nulls stay in training."""
    if value is None:
        chosen = records.filter(F.col(field).isNotNull()).agg(F.max_by(field, order)).scalar()
    else:
        chosen = F.lit(value)
    return records.withColumn("split", F.when(F.col(field) == chosen, "holdout").otherwise("train"))


def _cut_by_rank(records: DataFrame, order: Sequence[str], ratio: float) -> DataFrame:
    """First max(1, int(n (1 - ratio))) rows in order are train; ranks come from blocks, not one global sort."""
    ranked = running(order_blocks(records, [], order), [], order, index="_rank")
    n = records.agg(F.count(F.lit(1))).scalar()
    cut = F.greatest(F.lit(1), F.floor(n * F.lit(1.0 - ratio)))
    return ranked.withColumn("split", F.when(F.col("_rank") < cut, "train").otherwise("holdout")).drop("_rank")


def chronological_split(records: DataFrame, time: str, ratio: float = 0.2, tie: Sequence[str] = ()) -> DataFrame:
    """Earliest share for training."""
    return _cut_by_rank(records, [time, *tie], ratio)


def random_split(records: DataFrame, key: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Hash order in place of a shuffle; stable for a key and seed."""
    placed = records.withColumn("_h", F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    return _cut_by_rank(placed, ["_h", key], ratio).drop("_h")


def group_hash_split(records: DataFrame, column: str | None = None, val: float = 0.1, test: float = 0.1, path: str = "file_path") -> DataFrame:
    """Complete groups by the hash of a group column; null groups fall back to the path."""
    if column is None or column not in records.columns:
        column = next((c for c in GROUP_COLUMNS if c in records.columns), path)
    group = F.coalesce(F.col(column).cast("string"), F.col(path).cast("string"), F.lit("")) if path in records.columns else F.coalesce(F.col(column).cast("string"), F.lit(""))
    at = hash_fraction(group)
    split = F.when(at < test, "test").when(at < test + val, "val").otherwise("train")
    return records.withColumns({"split": split, "split_group_column": F.lit(column)})


def parent_dir_split(files: DataFrame, ratio: float, path: str = "file_path") -> DataFrame:
    """Files of one parent directory stay together; if one side is empty, files are split by path hash."""
    ratio = min(0.5, max(0.0, ratio))
    parent = F.lower(F.regexp_replace(path, "/[^/]*$", ""))
    at = hash_fraction(parent)
    placed = files.withColumns({"_val": at < ratio, "_h": F.sha1(path)})
    shape = placed.agg(F.struct((F.bool_or("_val") & ~F.bool_and("_val")).alias("both"), F.count(F.lit(1)).alias("n"))).scalar()
    ranked = running(order_blocks(placed, [], ["_h", path]), [], ["_h", path], index="_rank").withColumn("_shape", shape)
    n = F.col("_shape.n")
    wanted = F.least(n - 1, F.greatest(F.lit(1), F.bround(n * F.lit(ratio)).cast("long")))
    val = F.when(F.col("_shape.both"), F.col("_val")).otherwise(F.col("_rank") < wanted)
    return ranked.withColumn("split", F.when(val, "val").otherwise("train")).drop("_val", "_h", "_rank", "_shape")


def leaking_groups(split: DataFrame, group: str, column: str = "split") -> DataFrame:
    """Groups that sit in more than one split."""
    return split.groupBy(group).agg(F.countDistinct(column).alias("splits")).filter(F.col("splits") > 1)


def assert_no_leakage(split: DataFrame, group: str, column: str = "split") -> DataFrame:
    found = leaking_groups(split, group, column).limit(5).collect()
    if found:
        raise ValueError(f"groups in several splits: {[row[0] for row in found]}")
    return split


def few_shot_sample(train: DataFrame, key: str, n: int | None, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order, all rows when ``n`` is null or not smaller than the table."""
    if n is None:
        return train
    rank = F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return train.withColumn("_h", rank).orderBy("_h", key).limit(n).drop("_h")


def few_shot_grid(train: DataFrame, key: str, sizes: Sequence[int | None] = (None, 50, 25, 10, 5), seed: int = 42) -> DataFrame:
    """Nested hash-ordered samples, one copy per size; ``shots`` is -1 for the full table.

    Only the largest finite size is ranked, which Spark does as a top-n per task.
    """
    rank = F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    finite = sorted(s for s in sizes if s is not None)
    parts = []
    if finite:
        top = train.withColumn("_h", rank).orderBy("_h", key).limit(finite[-1])
        # at most the largest size rows remain here
        ranked = top.withColumn("_k", F.row_number().over(W.orderBy("_h", key)))
        grid = ranked.withColumn("shots", F.explode(F.filter(F.array(*[F.lit(s) for s in finite]), lambda s: F.col("_k") <= s)))
        parts.append(grid.drop("_h", "_k"))
    if any(s is None for s in sizes):
        parts.append(train.withColumn("shots", F.lit(-1)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cap_support(support: DataFrame, order: str, limit: int = 20) -> DataFrame:
    """First ``limit`` support rows; the few-shot interface accepts no more."""
    return support.orderBy(order).limit(limit)
