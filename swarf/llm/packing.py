"""Best-fit packing by exact complements: lengths that fill a gap to the last token are found by their sums.

Texts become pieces of at most ``capacity`` tokens.  Only the number of pieces of each length decides how lengths meet, so the
plan is made from at most ``capacity`` rows: single, pair and triple sums of the lengths still available are indexed, the
largest length opens a sequence, and a combination that exactly fills the gap is consumed as often as availability
allows; lengths without such a combination are packed best-fit at the end.  Pieces then take places by their rank
among the pieces of their length; ranks come from counts per task, so that a common length is never sorted in one task.
"""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swarf.llm.common import checkpointed
from swarf.llm.token_files import encode

#: Pieces of one length and task that meet the runs of places in one join key.
RANKS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, _task long, _nth long"
RUNS = "length long, first long, copies long, sequence long, place long"


class SumIndex:
    """Which sums one, two or three of the available lengths reach, kept while lengths run out."""

    def __init__(self, have: np.ndarray):
        self.have, size = have, len(have)
        self.single = (have > 0).astype(np.int64)
        squares = np.zeros(size, np.int64)
        half = np.arange(0, size, 2)
        squares[half] = self.single[half // 2]
        both = np.rint(np.convolve(self.single.astype(float), self.single.astype(float))[:size]).astype(np.int64)
        self.pairs = (both - squares) // 2
        self.pairs[half] += have[half // 2] >= 2
        self.triples = np.rint(np.convolve(self.single.astype(float), (self.pairs > 0).astype(float))[:size]).astype(np.int64)

    def _lose_pairs(self, sums: np.ndarray) -> None:
        self.pairs[sums] -= 1
        for s in sums[self.pairs[sums] == 0].tolist():
            self.triples[s:] -= self.single[: len(self.have) - s]

    def use(self, length: int, number: int) -> None:
        before, size = int(self.have[length]), len(self.have)
        self.have[length] = after = before - number
        if before >= 2 > after and 2 * length < size:
            self._lose_pairs(np.array([2 * length]))
        if before and not after:
            self.triples[length:] -= self.pairs[: size - length] > 0
            self.single[length] = 0
            others = np.flatnonzero(self.single) + length
            self._lose_pairs(others[others < size])

    def _two(self, total: int):
        low = np.arange(1, total // 2 + 1)
        for x in low[(self.single[low] & self.single[total - low]) > 0].tolist():
            yield x, total - x

    def complement(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """One, two or three available lengths that sum to ``gap`` beside those used, if any; large ones first."""

        def spare(parts) -> bool:
            return all(self.have[p] - used.get(p, 0) >= parts.count(p) for p in parts)

        if self.single[gap] and spare([gap]):
            return [gap]
        if self.pairs[gap]:
            for x, y in self._two(gap):
                if spare([y, x]):
                    return [y, x]
        if self.triples[gap]:
            third = np.arange(1, gap)
            for z in third[(self.single[third] > 0) & (self.pairs[gap - third] > 0)][::-1].tolist():
                for x, y in self._two(gap - z):
                    if spare([z, y, x]):
                        return [z, y, x]
        return None


def _exact(have: np.ndarray) -> tuple[list, np.ndarray]:
    """(patterns that fill sequences exactly, lengths left without one); a pattern is (how often, {length: copies})."""
    capacity = len(have) - 1
    index, patterns, rest = SumIndex(have), [], np.zeros(len(have), np.int64)
    top = capacity
    while True:
        while top and not have[top]:
            top -= 1
        if not top:
            return patterns, rest
        parts, gap, largest, found = {}, capacity, top, None
        while gap and found is None:
            largest = min(largest, gap)
            while largest and have[largest] <= parts.get(largest, 0):
                largest -= 1
            if not largest:
                break
            # as many of the largest as leave a gap of two to three of them, but at least one
            number = min(int(have[largest]) - parts.get(largest, 0), max(1, (gap - 1) // largest - 2))
            parts[largest] = parts.get(largest, 0) + number
            gap -= number * largest
            found = index.complement(gap, parts) if gap else []
        if found is None:
            number = int(have[top])
            rest[top] += number
            index.use(top, number)
            continue
        for length in found:
            parts[length] = parts.get(length, 0) + 1
        often = min(int(have[length]) // copies for length, copies in parts.items())
        patterns.append((often, parts))
        for length, copies in parts.items():
            index.use(length, often * copies)


def _best_fit(rest: np.ndarray) -> list:
    """Patterns of best-fit decreasing: each length goes to the fullest open sequence that still takes it."""
    capacity = len(rest) - 1
    gaps, opened, closed = [], {}, []  # open gaps in order; gap -> [(how often, parts)]

    def put(gap: int, often: int, parts: dict) -> None:
        if gap == 0:
            closed.append((often, parts))
            return
        if gap not in opened:
            opened[gap] = []
            bisect.insort(gaps, gap)
        opened[gap].append((often, parts))

    for length in np.flatnonzero(rest)[::-1].tolist():
        left = int(rest[length])
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                gap, often, parts = capacity, left, {}
            else:
                gap = gaps[at]
                often, parts = opened[gap].pop()
                if not opened[gap]:
                    del opened[gap], gaps[at]
            copies = min(gap // length, left)
            times = min(often, left // copies)
            if often > times and gap < capacity:
                put(gap, often - times, parts)
            put(gap - copies * length, times, {**parts, length: parts.get(length, 0) + copies})
            left -= times * copies
    return closed + [x for g in gaps for x in opened[g]]


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> pd.DataFrame:
    """Runs of places: pieces number ``first`` and on of a length lie ``copies`` side by side from ``place`` in the sequences
    from ``sequence`` on."""
    have = np.zeros(capacity + 1, np.int64)
    have[lengths] = counts
    exact, rest = _exact(have)
    next_rank, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    for often, parts in exact + _best_fit(rest):
        place = 0
        for length, copies in parts.items():
            rows.append((length, int(next_rank[length]), copies, sequence, place))
            next_rank[length] += often * copies
            place += length * copies
        sequence += often
    return pd.DataFrame(rows, columns=["length", "first", "copies", "sequence", "place"]).astype(np.int64)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text encoded, ended by ``end_id`` and cut at ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 and, if
    wanted, ids (little-endian 32-bit); _task and _nth number the pieces of a length within a task.

    A null text is empty and gives the end id alone; repeated rows are separate; an empty table gives no rows.  Rows are
    written to the shared folder once, so that their numbers stay.
    """

    def cut(batches):
        from pyspark import TaskContext

        task, seen, end = TaskContext.get().partitionId(), {}, struct.pack("<I", end_id)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(ids), 256):
                rows = []
                for doc_id, code in zip(ids[k : k + 256], encode([(t or "").encode() for t in texts[k : k + 256].to_pylist()], tokenizer)):
                    code += end
                    for number, begin in enumerate(range(0, len(code), 4 * capacity)):
                        part = code[begin : begin + 4 * capacity]
                        length = len(part) // 4
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        rows.append((doc_id, number, begin // 4, length, zlib.crc32(part), part if with_ids else None, task, nth))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "_task", "_nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

    return checkpointed(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, PIECES))


def place(numbered: DataFrame, capacity: int = 4096) -> DataFrame:
    """The rows with ``sequence_id`` and ``offset``; wants ``length`` (1 to capacity), ``_task`` and ``_nth`` as :func:`pieces` gives.

    Sequences are gapless from 0 and hold at most ``capacity`` tokens.
    """

    def planned(tables):
        counts = pd.concat(list(tables)).sort_values("length")
        yield plan(counts["length"].to_numpy(np.int64), counts["n"].to_numpy(np.int64), capacity)

    cells = numbered.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("n"))
    # one row per length: at most ``capacity`` rows meet in the task that plans
    runs = cells.groupBy("length").agg(F.sum("n").alias("n")).repartition(1).mapInPandas(planned, RUNS)
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    based = cells.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    cell, run = F.struct("first", "_task", "n"), F.struct("first", "copies", "sequence", "place")
    marks = based.select("length", "first", cell.alias("cell")).unionByName(runs.select("length", "first", run.alias("run")), allowMissingColumns=True)
    # a task's pieces of a length and the runs of places both divide the ranks of that length: their common stretches
    ordered = Window.partitionBy("length").orderBy("first")
    stretches = (
        marks.groupBy("length", "first").agg(F.max("cell").alias("cell"), F.max("run").alias("run"))
        .select("length", "first", F.last("cell", True).over(ordered).alias("cell"), F.last("run", True).over(ordered).alias("run"), F.lead("first").over(ordered).alias("until"))
        .select("length", "run", F.col("cell._task").alias("_task"), F.col("cell.first").alias("base"), (F.col("first") - F.col("cell.first")).alias("from"),
                (F.least(F.col("until"), F.col("cell.first") + F.col("cell.n")) - F.col("cell.first")).alias("to"))
        .withColumn("_block", F.explode(F.sequence(F.expr(f"`from` div {RANKS}"), F.expr(f"(`to` - 1) div {RANKS}"))))
    )
    keyed = numbered.withColumn("_block", F.expr(f"_nth div {RANKS}"))
    met = keyed.join(stretches, ["_task", "length", "_block"]).where((F.col("_nth") >= F.col("from")) & (F.col("_nth") < F.col("to")))
    nth = F.col("base") + F.col("_nth") - F.col("run.first")
    kept = [c for c in numbered.columns if c not in ("_task", "_nth")]
    return met.withColumn("_j", nth).select(
        *kept,
        F.expr("run.sequence + _j div run.copies").alias("sequence_id"),
        F.expr("run.place + (_j % run.copies) * length").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, **options) -> DataFrame:
    """Pieces of all texts with the sequence and offset that hold them; ``with_ids=True`` keeps their token ids."""
    return place(pieces(docs, tokenizer, capacity, **options), capacity)


def op12_pack(docs: DataFrame) -> DataFrame:
    """Every document's pieces and places, for the 49k word vocabulary and sequences of 4,096 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")
