"""Helpers shared by the corpus operators: tables, cutting lineage, and words of byte buffers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swarf.operators.lineage import checkpointed

__all__ = ["SPACES", "WORD", "Words", "buffer_of", "checkpointed", "mix", "pieces", "powers", "shared_folder", "source_key", "table", "unpacked", "with_row"]

#: A word is a run of anything but these (space, and tab to carriage return); bytes.split() uses the same set.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row(docs: DataFrame, **columns: Column) -> DataFrame:
    """The named columns, and all columns of the input in one struct _row, where their names meet no others."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(name) for name, c in columns.items()])


def unpacked(frame: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    """The columns of the input again, then the added ones; an input column of such a name gives way."""
    taken = {name.lower() for name in added}
    return frame.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in taken], *added)


def source_key(column: str) -> Column:
    """A never-null text that keeps nulls apart from every other value."""
    return F.when(F.col(column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def pieces(values: list, most: int = PIECE_BYTES):
    """Index ranges of consecutive byte strings holding about ``most`` bytes; one longer string makes a range alone."""
    begin = size = 0
    for i, value in enumerate(values):
        if i > begin and size + len(value) > most:
            yield begin, i
            begin, size = i, 0
        size += len(value)
    if begin < len(values):
        yield begin, len(values)


def buffer_of(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All strings in one array, a space around each, and the place of each string's leading space (one more at the end)."""
    starts = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) + 1 for v in values], out=starts[1:])
    return np.frombuffer(b" " + b" ".join(values) + b" ", np.uint8), starts


@lru_cache(maxsize=1)
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE), np.full(size, BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64."""
    return _power_table(max(PIECE_BYTES + 4096, 1 << (size - 1).bit_length() if size > PIECE_BYTES + 4096 else 0))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def prefix_hash(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): the bytes [s, e) hash to ``(sums[e] - sums[s]) * inverse[s]``."""
    up, down = powers(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buffer] * up[: len(buffer)], out=sums[1:])
    return sums, down


class Words:
    """Words of some texts, A-Z lower-cased: their places in one buffer, the text of each, and 64-bit hashes."""

    def __init__(self, values: list[bytes]):
        raw, self.doc_starts = buffer_of(values)
        self.buffer = LOWER[raw]
        space = IS_SPACE[self.buffer]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.doc_starts)  # of each text; one more at the end
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        sums, down = prefix_hash(self.buffer)
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; unset (in tests), the one that cutting lineage uses."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.getCheckpointDir() is None:
            checkpointed(spark.range(1))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")
