"""Token ids in seekable compressed files: independent zstandard frames, a directory, and a trailing seek table.

A file is a row of frames, a skippable directory frame, and a skippable seek table as the public seekable format lays it
out: per frame the compressed size, the plain size and the low half of its XXH64, then the footer.  A frame holds whole
documents: their number, then per document a null mark, the id and the number of token ids, then all token ids.  The
directory gives per frame the documents and ids before it and its smallest and largest document id, so a reader fetches
the tail of the file and decompresses only frames that can hold a requested document.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swarf.llm.common import checkpointed, shared_folder

# Fixed values of the public seekable zstandard format.
SEEK_MAGIC, DIRECTORY_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80

FRAME_BYTES = 1 << 20
FILE_BYTES = 128 << 20
CACHED_WORDS = 700_000
HEAD = np.dtype([("known", "u1"), ("id", "<i8"), ("n", "<u4")])
PLACE = np.dtype([("docs_before", "<u8"), ("ids_before", "<u8"), ("lowest", "<i8"), ("highest", "<i8"), ("nulls", "u1")])
SEEK = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
MANIFEST = "part int, file string, n_docs long, n_ids long"


# Steps of the tokenizer whose words may be encoded one by one.
WORD_NORMALIZER = ["NFC", "Replace", "Lowercase"]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """(tokenizer, whether a text's ids are those of its words in turn, cache of words)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    setup = json.loads(tokenizer.to_str())
    steps = (setup["normalizer"] or {}).get("normalizers", [])
    split = ((setup["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    lower = [s["type"] for s in steps] == WORD_NORMALIZER and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
    apart = split.get("pattern") == {"Regex": WORD_SPLIT} and split["behavior"] == "Removed" and split["invert"]
    # special strings are found before words are, so none may hold white space
    solid = not any(set(t["content"]) & set(" \t\n\r\v\f") or t["normalized"] or t["single_word"] for t in setup["added_tokens"])
    return tokenizer, lower and apart and solid and setup["post_processor"] is None, {}


def _learn(tokenizer, cache: dict, words: list[bytes]) -> None:
    """Add the ids of new words to the cache.

    A word of ASCII letters is one unit of the vocabulary's splitter and goes to its merge model directly, in small letters; a
    full stop or comma after an ASCII letter or digit is a unit of its own; all other words take the whole way as written.
    """
    rest = []
    for word in words:
        if word.isalpha():
            cache[word] = array("I", [t.id for t in tokenizer.model.tokenize(word.lower().decode())]).tobytes()
        elif word[-1] in b".," and word[-2:-1].isalnum():
            if word[:-1] not in cache:
                _learn(tokenizer, cache, [word[:-1]])
            if word[-1:] not in cache:
                _learn(tokenizer, cache, [word[-1:]])
            cache[word] = cache[word[:-1]] + cache[word[-1:]]
        else:
            rest.append(word)
    if rest:
        coded = tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        cache.update((w, array("I", e.ids).tobytes()) for w, e in zip(rest, coded))


def encode(texts: list[bytes], path: str) -> list[bytes]:
    """Token ids of whole texts as little-endian bytes, as the tokenizers library gives them.

    A vocabulary that drops white space and never joins across it gives a text the ids of its words in turn: such words are
    encoded once, as written, and kept in a bounded cache of the worker.  Any other tokenizer encodes whole texts.
    """
    tokenizer, by_words, cache = _tokenizer(path)
    if not by_words:
        coded = tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in coded]
    found = []
    for text in texts:
        words = text.split()
        missing = {w for w in words if w not in cache}
        if missing:
            if len(cache) + 2 * len(missing) > CACHED_WORDS:
                cache.clear()
                missing = set(words)
            _learn(tokenizer, cache, list(missing))
        found.append(b"".join([cache[w] for w in words]))
    return found


def _open(folder: str):
    return pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class FrameWriter:
    """Adds documents in order and writes frames as they fill."""

    def __init__(self, sink):
        self.sink, self.heads, self.ids, self.size = sink, [], [], 0
        self.seeks, self.places, self.docs, self.tokens = [], [], 0, 0
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=False)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.heads.append((doc_id is not None, doc_id or 0, len(ids) // 4))
        self.ids.append(ids)
        self.size += len(ids)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.heads:
            return
        heads = np.array(self.heads, HEAD)
        plain = struct.pack("<I", len(heads)) + heads.tobytes() + b"".join(self.ids)
        packed = self.packer.compress(plain)
        self.sink.write(packed)
        known = heads["id"][heads["known"] == 1]
        bounds = (int(known.min()), int(known.max())) if len(known) else (0, -1)
        self.places.append((self.docs, self.tokens, *bounds, len(known) < len(heads)))
        self.seeks.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.docs += len(heads)
        self.tokens += int(heads["n"].sum())
        self.heads, self.ids, self.size = [], [], 0

    def close(self) -> None:
        self.flush()
        places, seeks = np.array(self.places, PLACE).tobytes(), np.array(self.seeks, SEEK).tobytes()
        self.sink.write(struct.pack("<II", DIRECTORY_MAGIC, len(places)) + places)
        footer = struct.pack("<IBI", len(self.seeks), CHECKSUMS, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(seeks) + len(footer)) + seeks + footer)


class FrameReader:
    """Reads the seek table and the directory, then any frame by number."""

    def __init__(self, source):
        self.source, size = source, source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table")
        self.seeks = np.frombuffer(self._at(size - 9 - count * SEEK.itemsize, count * SEEK.itemsize), SEEK)
        self.begins = np.concatenate([[0], np.cumsum(self.seeks["packed"], dtype=np.int64)])
        self.places = np.frombuffer(self._at(int(self.begins[-1]) + 8, count * PLACE.itemsize), PLACE)

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def frame(self, k: int):
        """(heads, all ids) of frame ``k``; raises when its checksum differs."""
        packed = self._at(int(self.begins[k]), int(self.seeks["packed"][k]))
        plain = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.seeks["plain"][k]))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != int(self.seeks["check"][k]):
            raise ValueError(f"frame {k} is damaged")
        (count,) = struct.unpack_from("<I", plain)
        heads = np.frombuffer(plain, HEAD, count, 4)
        return heads, plain[4 + count * HEAD.itemsize :]

    def fetch(self, wanted: set[int]):
        """(id, ids) of the requested documents; other frames stay packed."""
        for k, place in enumerate(self.places):
            if any(place["lowest"] <= w <= place["highest"] for w in wanted):
                heads, ids = self.frame(k)
                ends = np.cumsum(heads["n"], dtype=np.int64) * 4
                for head, end in zip(heads, ends.tolist()):
                    if head["known"] and int(head["id"]) in wanted:
                        yield int(head["id"]), np.frombuffer(ids[end - 4 * int(head["n"]) : end], "<u4")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write files in ascending id order; one row per file, in the order of the files.

    Documents are range-partitioned by id, about FILE_BYTES of text to a file and one file to a shuffle partition at least, and
    sorted within a task; each task streams into one file, which takes its
    final name when complete, so a repeated task replaces it.  Null texts are empty and hold the end id alone; null ids
    come first; repeated ids stay side by side; an empty table writes files without documents or none.  The row set is
    written to the shared folder once, so files are not written again by later actions.
    """

    def to_file(batches):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        draft, final = f"{root}/_{part:06d}-{attempt}", f"{root}/part-{part:06d}.ids"
        end = struct.pack("<I", end_id)
        with fs.open_output_stream(draft) as sink:
            out = FrameWriter(sink)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for k in range(0, len(ids), 256):
                    coded = encode([(t or "").encode() for t in texts[k : k + 256].to_pylist()], tokenizer)
                    for doc_id, code in zip(ids[k : k + 256], coded):
                        out.add(doc_id, code + end)
            out.close()
        fs.move(draft, final)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [final], "n_docs": [out.docs], "n_ids": [out.tokens]})

    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ordered = docs.select(F.col(id_col).cast("long"), F.col(text_col)).repartitionByRange(files, F.col(id_col)).sortWithinPartitions(id_col)
    return checkpointed(ordered.mapInArrow(to_file, MANIFEST))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def from_files(tables):
        fs, _ = _open(folder)
        for pdf in tables:
            for file, before in zip(pdf["file"], pdf["before"].tolist()):
                with fs.open_input_file(file) as source:
                    reader = FrameReader(source)
                    for k in range(len(reader.seeks)):
                        heads, ids = reader.frame(k)
                        counts = heads["n"].astype(np.int64)
                        ends = np.cumsum(counts)
                        view = memoryview(ids)
                        crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for n, e in zip(counts.tolist(), ends.tolist())]
                        doc_id = pa.array(heads["id"].astype(np.int64), mask=heads["known"] == 0)
                        start = before + int(reader.places["ids_before"][k]) + ends - counts
                        yield pa.table({"doc_id": doc_id, "start": start, "n_tokens": counts, "ids_crc32": np.array(crc, np.int64)})

    def rows(batches):
        for batch in batches:
            for found in from_files([batch.to_pandas()]):
                yield from found.to_batches()

    # one row per file, so a single ordered window is small
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    # one row per file is little data, but each stands for a whole file: as many tasks as files
    return files.select("file", "before").repartition(max(1, manifest.count()), "file").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Files of all documents in the shared folder, read back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    return read(write(docs, folder, tokenizer), folder)
