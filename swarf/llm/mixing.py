"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarf.llm.common import WORD, checkpointed, source_key, unpacked, with_row

#: Sizes whose documents are given back before the knapsack, so that it has choices.
RELEASED = 24
RELEASED_WORDS = 4096
FIT_SCHEMA = "_source string, _size long, _target double, _source_size long, _epochs int, _picked long"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """Targets by water-filling over one row per source (_source, _source_size): ``min(most * size, level * weight)``.

    The level solves "all targets together equal all sizes"; it is found from running sums over sources ordered by the
    level at which each reaches its stop.
    """
    order = F.row_number().over(Window.orderBy(F.col("_source") == "", "_source")) - 1
    weighed = sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int")))
    stop = F.col("_source_size") * F.lit(float(most))
    before = Window.orderBy("_stop_level", "_source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_stop_level", "_source").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("_source_size").over(everything) - F.coalesce(F.sum(stop).over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    leveled = weighed.withColumn("_stop_level", stop / F.col("_weight")).withColumn("_level", level)
    # the first source that the level does not lift to its stop fixes the level; without one all stop
    fixed = F.min(F.when(F.col("_level") <= F.col("_stop_level"), F.struct("_stop_level", "_source", "_level"))).over(everything)["_level"]
    return leveled.select("_source", "_source_size", F.when(fixed.isNull(), stop).otherwise(F.least(stop, fixed * F.col("_weight"))).alias("_target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size (> 0) to take so that their sizes sum to ``budget`` or just below.

    Every size first gives its share of documents, the fraction carried on to the next smaller size.  One taken document
    of the largest size, one of each of the smallest sizes and, up to RELEASED_WORDS, more of them are then given back, and
    a bounded-knapsack program over the documents left fills the rest: bit b
    of a big integer says that b words can be reached; copies of one size are added in doubling bundles.
    """
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    order = np.argsort(-sizes)
    owed, wanted = 0, 0
    for i in order.tolist():
        size, count = int(sizes[i]), int(counts[i])
        wanted += size * count * budget
        take[i] = min(count, (wanted // total - owed) // size)
        owed += int(take[i]) * size
    taken = order[take[order] > 0]
    for i in [*taken[:1].tolist(), *taken[1:][-RELEASED:].tolist()]:
        take[i] -= 1
        owed -= int(sizes[i])
    for i in taken[::-1].tolist():
        n = min(int(take[i]), max(0, RELEASED_WORDS - (budget - owed)) // int(sizes[i]))
        take[i] -= n
        owed -= n * int(sizes[i])
    rest = budget - owed
    full = (1 << (rest + 1)) - 1
    reached, bundles = 1, []
    for i in order[::-1].tolist():
        size, spare = int(sizes[i]), int(counts[i] - take[i])
        if size > rest or reached >> rest & 1:
            break
        spare, bundle = min(spare, rest // size), 1
        while spare > 0 and not reached >> rest & 1:
            n = min(bundle, spare)
            bundles.append((i, n, n * size, reached))
            reached |= (reached << n * size) & full
            spare, bundle = spare - n, bundle * 2
    at = reached.bit_length() - 1
    for i, n, words, before in reversed(bundles):
        if not before >> at & 1:
            take[i] += n
            at -= words
    return take


def _fit_source(pdf):
    target, whole = float(pdf["_target"].iloc[0]), int(pdf["_source_size"].iloc[0])
    epochs = int(target // whole) if whole else 0
    sizes, counts = pdf["_size"].to_numpy(np.int64), pdf["_count"].to_numpy(np.int64)
    some = sizes > 0
    picked = np.zeros(len(sizes), np.int64)
    picked[some] = fit_budget(sizes[some], counts[some], int(round(target)) - epochs * whole)
    return pdf[["_source", "_size", "_target", "_source_size"]].assign(_epochs=epochs, _picked=picked)


def planned(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 11, salts: int = 256, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """_row (the document) with ``_size`` (words), ``_source_size``, ``_target`` (words) and ``_copies`` in the mix.

    Sources in code-point order, null last, take the weights in turn and share as many words as there are; no target
    exceeds ``most`` times its source.  A source gives whole rounds of all its documents and, for the rest of its target,
    a seeded choice whose number per exact word count comes from :func:`fit_budget`.

    Only counts per (source, size) reach one task: at most one row per distinct size.  The rank of a document among those
    of its size is its rank in one of ``salts`` hash slices plus the documents of earlier slices, so that neither a source
    nor a size is sorted in one task.

    Rows of one id and size are ordered by a hash of their text, so reruns choose the same texts.
    Null or empty texts have size 0 and stay with whole rounds of their source (null sources are a source); repeated rows
    count one by one; an empty table gives an empty result.
    """
    mark = F.xxhash64(F.lit(seed), F.col(id_col))
    keyed = with_row(docs, _source=source_key(source_col), _size=word_count(F.col(text_col)), _mark=mark, _slice=F.pmod(mark, F.lit(salts)), _tie=F.xxhash64(F.col(text_col)))
    cells = checkpointed(keyed.groupBy("_source", "_size", "_slice").agg(F.count(F.lit(1)).alias("_cell")))
    counts = cells.groupBy("_source", "_size").agg(F.sum("_cell").alias("_count"))
    sizes = counts.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_count")).alias("_source_size"))
    fitted = counts.join(source_targets(sizes, weights, most), "_source").groupBy("_source").applyInPandas(_fit_source, FIT_SCHEMA)
    earlier = Window.partitionBy("_source", "_size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = cells.withColumn("_earlier", F.coalesce(F.sum("_cell").over(earlier), F.lit(0))).join(fitted, ["_source", "_size"])
    rank = F.row_number().over(Window.partitionBy("_source", "_size", "_slice").orderBy("_mark", f"_row.{id_col}", "_tie"))
    joined = keyed.withColumn("_rank", rank).join(plan, ["_source", "_size", "_slice"])
    copies = F.col("_epochs") + (F.col("_rank") + F.col("_earlier") <= F.col("_picked")).cast("int")
    return joined.select("_row", "_size", "_source_size", "_target", copies.alias("_copies"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The columns of the documents, then _size, _source_size, _target and _copies as :func:`planned` gives them."""
    return unpacked(planned(docs, **options), docs, "_size", "_source_size", "_target", "_copies")


def op1_mix(docs: DataFrame) -> DataFrame:
    mixed = mix_sources(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, with the columns of the input."""
    return unpacked(planned(docs).select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))), docs)
