"""Cross-tokenizer alignment by interval coalescing.

A text is cut by two tokenizers.  All tokens of both are sorted by their first byte; the running maximum of their ends
says where a group closes: a token that starts at or after it opens the next group, so groups end exactly where tokens of
both sides end.  Within a group every A token is linked with the B tokens whose bytes overlap it.

Tokenizers that never join across a single space or line feed between other characters give a text the tokens of its units
in turn: words with the space or line feed before them, a closing full stop or comma apart.  Whether they do is read from
the vocabularies; if not, a whole text is one unit.  Distinct units are aligned once per worker and documents are put
together from them; a pair's count is the number of documents that hold it, over the whole corpus.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarf.llm.common import checkpointed

#: Text bytes of the documents that share one dictionary of linked pairs, units a worker keeps at most, units aligned at once.
BLOCK_BYTES = 4 << 20
CACHED_UNITS = 250_000
LEARNED_UNITS = 8192
# Where units begin; texts with other white space or with a closing stop after anything but a letter are cut by UNIT alone.
UNIT = re.compile(r"(?<=[^ ]) (?=\S)|(?<=\S)(?=\n\S)")
STOP = re.compile(r"[.,](?!\S)(?<![A-Za-zÀ-ÖØ-öø-ÿ].)", re.S)
ACROSS = re.compile(r"[^▁]▁|\n|[A-Za-zÀ-ÖØ-öø-ÿ][.,]")
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
PACKED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs binary, times binary, codes array<long>, documents array<long>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def coalesced(texts: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_b: np.ndarray):
    """(order of the tokens, group number of each in that order) for tokens of several texts.

    Places of later texts are moved behind those of earlier ones, so one sort and one running maximum serve all.
    """
    size = np.zeros(int(texts.max(initial=-1)) + 2, np.int64)
    np.maximum.at(size, texts + 1, ends)
    shift = np.cumsum(size)[texts]
    starts, ends = starts + shift, ends + shift
    order = np.lexsort((is_b, starts))
    reach = np.maximum.accumulate(ends[order])
    opens = np.ones(len(order), bool)
    opens[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(opens) - 1


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray):
    """Index pairs (a, b) of overlapping tokens; both sides in order of place, tokens of a side apart."""
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    number = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(a_start)), number)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(low, number)


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


class Aligner:
    """Units aligned so far: per unit its counts, its groups as text and its distinct links with their numbers."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        # the byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes follow from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        piece = lambda k: bytes([int(self.b.id_to_piece(k)[3:-1], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode()
        self.b_bytes = [piece(k) for k in range(self.b.get_piece_size())]
        self.a_width, self.b_width = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # ids as text with the mark that follows: the next id of a side, the other side, the next group, nothing
        text = lambda size, *marks: np.array([[f"{k}{mark}" for k in range(size)] for mark in marks], object)
        self.a_text, self.b_text = text(len(self.a_bytes), ",", "|"), text(len(self.b_bytes), ",", ";", "")
        split = json.loads(self.a.to_str())
        byte_level = (split["normalizer"], split["pre_tokenizer"] and split["pre_tokenizer"]["type"]) == (None, "ByteLevel") and split["pre_tokenizer"]["use_regex"] and not split["pre_tokenizer"]["add_prefix_space"]
        normal = [k for k in range(self.b.get_piece_size()) if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k))]
        lead = [self.b.id_to_piece(k) for k in self.b.encode("\n")]
        self.by_units = bool(byte_level and lead == ["▁", "<0x0A>"] and not any(ACROSS.search(self.b.id_to_piece(k)) for k in normal))
        self.clear()

    def clear(self) -> None:
        self.at: dict = {}
        self.groups: list[str] = []
        self.parts: list = [(np.zeros((0, 4), np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def units(self, text: str) -> list:
        """Units of a text as keys: a word stands for a space and the word, one that starts with a line feed for itself, a stop
        after a zero character for the stop alone, and a tuple for a space and whatever it holds."""
        if not self.by_units:
            return [(text,)]
        if " ".join(text.split()) == text.replace("\n", " ") and "\0" not in text and STOP.search(text) is None:
            end = [f"\0{text[-1]}"] if text[-1] in ".," else []
            text = text[:-1] if end else text
            return text.replace("\n", " \n").replace(". ", " \0. ").replace(", ", " \0, ").split(" ") + end
        found = UNIT.split(text)
        return [(u,) if k == 0 or u[:1] == "\0" else u for k, u in enumerate(found)]

    def _encoded(self, units: list) -> tuple[list, list, list]:
        """(bytes, A ids, B ids) of units.

        The piece library puts a space of its own before a text.  Before a line feed it is a token of its own, and so is the
        line feed itself, so units without a space are read after it.
        """
        words = [u[0] if isinstance(u, tuple) else u for u in units]
        bare = [0 if isinstance(u, tuple) else 1 if u[:1] == "\n" else 2 if u[:1] == "\0" else 0 for u in units]
        full = [w[1:] if b == 2 else w if b else " " + w for w, b in zip(words, bare)]
        a_ids = [e.ids for e in self.a.encode_batch_fast(full, add_special_tokens=False)]
        b_ids = [ids[b:] for ids, b in zip(self.b.encode(["\n" + w[1:] if b == 2 else w for w, b in zip(words, bare)], num_threads=1), bare)]
        full = [w.encode() for w in full]
        joined = lambda ids, table: b"".join([table[t] for t in ids])
        whole = [joined(x, self.a_bytes) == f == joined(y, self.b_bytes) for f, x, y in zip(full, a_ids, b_ids)]
        if not all(whole):
            a_ids, b_ids = ([x if w else [] for x, w in zip(ids, whole)] for ids in (a_ids, b_ids))
        return whole, a_ids, b_ids

    def learn(self, units: list) -> None:
        """Encode and align new units."""
        whole, a_ids, b_ids = self._encoded(units)
        numbers, sides = np.arange(len(units)), []
        for ids, width in ((a_ids, self.a_width), (b_ids, self.b_width)):
            per = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(per.sum()))
            ends = np.cumsum(width[flat])
            before = np.concatenate([[0], ends])[np.cumsum(per) - per]
            text = np.repeat(numbers, per)
            sides.append((text, flat, ends - width[flat] - before[text], ends - before[text]))
        (at, a, a_start, a_end), (bt, b, b_start, b_end) = sides
        texts, ids = np.concatenate([at, bt]), np.concatenate([a, b])
        is_b = np.repeat([0, 1], [len(a), len(b)])
        order, group = coalesced(texts, np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]), is_b)
        # groups as text: A ids of a group, then its B ids, each with the mark that follows it
        sided = np.lexsort((is_b[order], group))
        group, tokens = group[sided], order[sided]
        side, owner = is_b[tokens], texts[tokens]
        ends_side, ends_group, ends_text = (np.append(x[1:] != x[:-1], True)[: len(x)] for x in (group * 2 + side, group, owner))
        written = np.where(side == 0, self.a_text[ends_side.astype(np.int64), np.where(side == 0, ids[tokens], 0)],
                           self.b_text[ends_group.astype(np.int64) + ends_text, np.where(side == 1, ids[tokens], 0)]).tolist()
        counts = np.stack([np.bincount(x, minlength=len(units)) for x in (at, bt, owner[ends_group])], 1)
        cuts = np.concatenate([[0], np.cumsum(counts[:, 0] + counts[:, 1])]).tolist()
        # the bytes of a unit are as many on both sides, so shifted places stay apart
        size = np.zeros(len(units) + 1, np.int64)
        np.maximum.at(size, at + 1, a_end)
        shift = np.cumsum(size)
        i, j = overlaps(a_start + shift[at], a_end + shift[at], b_start + shift[bt], b_end + shift[bt])
        kinds, times = np.unique((at[i] << 48) | (a[i] << 24) | b[j], return_counts=True)
        links = np.bincount(at[i], minlength=len(units))
        self.at.update(zip(units, range(len(self.groups), len(self.groups) + len(units))))
        self.groups += ["".join(written[x:y]) for x, y in zip(cuts, cuts[1:])]
        codes = ((kinds >> 24 & 0xFFFFFF) << 32) | (kinds & 0xFFFFFF)
        self.parts.append((np.column_stack([counts, links]), np.array(whole, bool), np.bincount(kinds >> 48, minlength=len(units)), codes, times))

    def known(self, units: list[list]) -> list[list[int]]:
        """Numbers of the units of some texts; new ones are learnt."""
        new = {u for part in units for u in part if u not in self.at}
        if len(self.at) + len(new) > CACHED_UNITS:
            self.clear()
            new = {u for part in units for u in part}
        new = list(new)
        for k in range(0, len(new), LEARNED_UNITS):
            self.learn(new[k : k + LEARNED_UNITS])
        if new:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts))]
        return [[self.at[u] for u in part] for part in units]

    def documents(self, texts: list[str]):
        """(counts, groups, document of each link kind, code of the pair, occurrences); codes are ``A id << 32 | B id``."""
        places = self.known([self.units(t) if t else [] for t in texts])
        table, usable, links, codes, often_in = self.parts[0]
        ends = np.concatenate([[0], np.cumsum(links)])
        number = np.array([len(p) for p in places], np.int64)
        unit = np.fromiter(itertools.chain.from_iterable(places), np.int64, int(number.sum()))
        owner = np.repeat(np.arange(len(texts)), number)
        whole = np.bincount(owner[~usable[unit]], minlength=len(texts)) == 0
        counts = np.zeros((len(texts), 4), np.int64)
        for c in range(4):
            counts[:, c] = np.bincount(owner, table[unit, c], len(texts))
        counts[~whole] = 0
        groups = [";".join([self.groups[u] for u in p]) if w else "" for p, w in zip(places, whole.tolist())]
        kept = whole[owner]
        kinds, often = np.unique((owner[kept] << 32) | unit[kept], return_counts=True)
        doc, unit = kinds >> 32, kinds & 0xFFFFFFFF
        begin, n = ends[unit], links[unit]
        entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        return counts, groups, np.repeat(doc, n), codes[entry], often_in[entry] * np.repeat(often, n)


def _blocks(batches, most: int):
    """Lists of (id, text) holding about ``most`` characters."""
    rows, size = [], 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for k in range(0, len(ids), 64):
            for doc_id, text in zip(ids[k : k + 64], texts[k : k + 64].to_pylist()):
                rows.append((doc_id, text or ""))
                size += len(rows[-1][1])
            if size >= most:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def link_documents(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents: one row per document with its counts and linked pairs, as indices into the block's dictionary,
    and one row per block with that dictionary: codes of pairs and how many of the block's documents hold each."""

    def link(batches):
        from pyspark import TaskContext

        task, packer = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
        for number, rows in enumerate(_blocks(batches, BLOCK_BYTES)):
            counts, groups, doc, code, times = _aligner(a_path, b_path).documents([t for _, t in rows])
            codes, local = np.unique(code, return_inverse=True)
            kinds, inverse = np.unique((doc << 32) | local, return_inverse=True)
            total = np.bincount(inverse, times, len(kinds)).astype("<u4")
            local = (kinds & 0xFFFFFFFF).astype("<u4")
            ends = np.searchsorted(kinds >> 32, np.arange(len(rows) + 1))
            holds = np.bincount(local, minlength=len(codes))
            cut = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
            block = np.full(len(rows), (task << 32) | number)
            columns = {
                "block": block, "doc_id": pa.array([i for i, _ in rows], pa.int64()), **{c: counts[:, k] for k, c in enumerate(COUNTS)},
                "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups],
                "groups": pa.array(groups if with_groups else [None] * len(rows), pa.string()),
                "pairs": [packer.compress(np.diff(local[x:y], prepend=np.uint32(0)).tobytes()) for x, y in cut],
                "times": [packer.compress(total[x:y].tobytes()) for x, y in cut],
                "codes": pa.nulls(len(rows), pa.list_(pa.int64())), "documents": pa.nulls(len(rows), pa.list_(pa.int64())),
            }
            table = pa.table(columns)
            yield from table.to_batches(1024)
            if len(codes):
                dictionary = {f.name: pa.nulls(1, f.type) for f in table.schema}
                dictionary |= {"block": block[:1], "codes": pa.array([codes], pa.list_(pa.int64())), "documents": pa.array([holds], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(dictionary, schema=table.schema)

    return checkpointed(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(link, PACKED))


def pair_counts(linked: DataFrame) -> DataFrame:
    """code, a_id, b_id, n (documents holding the pair linked) and best (whether n is the highest of its A id)."""
    counts = linked.where("codes is not null").select(F.explode(F.arrays_zip("codes", "documents")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.documents").alias("n"))
    counts = counts.withColumn("a_id", F.shiftright("code", 32)).withColumn("b_id", F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)))
    highest = counts.groupBy("a_id").agg(F.max("n").alias("most"))
    return counts.join(highest, "a_id").select("code", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False, **columns) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if wanted, groups as text.

    Texts that are null, empty, or whose joined pieces differ from a space and the text have no tokens: zeros and empty
    texts.  Repeated rows are documents of their own.  An empty table gives no rows.  Counts of pairs come back to
    the documents through the dictionary of their block, so no task sees more than one block and its dictionary.
    """
    linked = link_documents(docs, a_path, b_path, with_groups, **columns)
    entries = linked.where("codes is not null").select("block", F.posexplode("codes").alias("entry", "code"))
    counted = entries.join(pair_counts(linked), "code").select(F.col("block").alias("of_block"), "entry", "n", "best")

    def sums(documents: pa.Table, dictionary: pa.Table) -> pa.Table:
        unpacker = zstandard.ZstdDecompressor()
        entry = dictionary.column("entry").to_numpy()
        n, best = np.zeros(len(entry), np.int64), np.zeros(len(entry), np.int64)
        n[entry], best[entry] = dictionary.column("n").to_numpy(), dictionary.column("best").to_numpy()
        n_best, count_sum = [], []
        for packed, often in zip(documents.column("pairs").to_pylist(), documents.column("times").to_pylist()):
            local = np.cumsum(np.frombuffer(unpacker.decompress(packed), "<u4"), dtype=np.int64)
            times = np.frombuffer(unpacker.decompress(often), "<u4").astype(np.int64)
            n_best.append(int((times * best[local]).sum()))
            count_sum.append(int((times * n[local]).sum()))
        kept = documents.select(["doc_id", *COUNTS, "groups_sha256", "groups"])
        both = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        names = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256", "groups"]
        return pa.table([both[c] if c in both else kept.column(c) for c in names], names=names)

    rows = linked.where("codes is null").drop("codes", "documents")
    return rows.groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(sums, ALIGNED)


def op13_align(docs: DataFrame) -> DataFrame:
    """Every document aligned between the byte-level 50k vocabulary (A) and the 32k piece vocabulary (B)."""
    import public_tokenizers

    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).drop("groups")
