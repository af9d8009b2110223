"""Removal of long repeated strings: bounded interval expansion on Burrows-Wheeler transforms of candidate contexts.

Equal strings of MIN_BYTES bytes have the same smallest 32-gram at the same place.  That anchor, and a core that all
strings at nearby distances from it contain, is the key by which contexts meet; strings without a partner never travel.
Contexts that agree entirely are decided at once; those that agree in the core and differ outside go, a few megabytes at
a time, into a transform whose common prefixes are derived by increasing length up to MIN_BYTES.  A core with more
contexts than a transform should hold is first made longer by the bytes around it, until its contexts are few enough.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarf.llm.common import buffer_of, checkpointed, mix, pieces, prefix_hash

MIN_BYTES = 400
GRAM = 32
SPREAD = 128  # string starts that share a core
BUCKET_RECORDS = 150_000
TRANSFORM_BYTES = 3 << 19
KEY_BYTES = TRANSFORM_BYTES // 8  # most context bytes of one key in a transform
NARROWER = 4  # parts into which the starts of a larger key are cut per round
SEGMENT = 8 << 20
PLACE_BITS = np.uint64(24)
RECORD = np.dtype([("key", "<u8"), ("text", "<u8"), ("owner", "<i8"), ("start", "<i8"), ("n", "<u2"), ("core", "u1"), ("sure", "u1")])
FOUND = "_owner long, _start long, _n int, _core int, _key long, _sure boolean, _open boolean, _hot boolean"
#: _core is the distance from the start to the core; _sure contexts are known to be repeated.
TEXTS = "_owner long, _start long, _n int, _core int, _key long, _sure boolean, _text binary"
CHILDREN = "_owner long, _from long, _start long, _n int, _core int, _key long, _kind long, _sure boolean"


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def spread_of(least: int) -> int:
    return max(1, min(SPREAD, least - GRAM))


def contexts(texts: list[bytes], owners: np.ndarray, least: int = MIN_BYTES) -> np.ndarray:
    """Records of all strings of ``least`` bytes: runs of starts with one anchor and one core."""
    found = []
    cut, who, shift = [], [], []
    for text, owner in zip(texts, owners.tolist()):
        for begin in range(0, max(len(text) - least + 1, 0), SEGMENT):
            cut.append(text[begin : begin + SEGMENT + least - 1])
            who.append(owner)
            shift.append(begin)
    for a, b in pieces(cut):
        buffer, starts = buffer_of(cut[a:b])
        begin, end = starts[:-1] + 1, starts[1:]
        sums, down = prefix_hash(buffer)
        of = lambda s, e: (sums[e] - sums[s]) * down[s]
        gram = mix(of(np.arange(len(buffer) - GRAM + 1), np.arange(GRAM, len(buffer) + 1)))
        low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
        place = sliding_minimum((gram & ~low) | np.arange(len(gram), dtype=np.uint64), least - GRAM + 1) & low
        inside = np.zeros(len(buffer) + 1, np.int8)
        inside[begin] += 1
        inside[end - least + 1] -= 1
        first = np.flatnonzero(np.cumsum(inside)[: len(place)] > 0)
        anchor = place[first].astype(np.int64)
        spread = spread_of(least)
        block = (anchor - first) // spread
        edge = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1]) | (first[1:] != first[:-1] + 1)])
        run, n = first[edge], np.diff(np.r_[edge, len(first)])
        core = anchor[edge] - block[edge] * spread
        records = np.zeros(len(edge), RECORD)
        records["key"] = mix(of(core, core + least - spread + 1) ^ mix(block[edge].astype(np.uint64) + gram[anchor[edge]]))
        records["text"] = mix(of(run, run + n + least - 1) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (core - run).astype(np.uint64))
        doc = np.searchsorted(begin, run, "right") - 1
        records["owner"], records["n"], records["core"] = np.array(who[a:b], np.int64)[doc], n, core - run
        records["start"] = run - begin[doc] + np.array(shift[a:b], np.int64)[doc]
        found.append(records)
    return np.concatenate(found) if found else np.zeros(0, RECORD)


def settle(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(decided, left): contexts that occur twice are repeated; one of each goes on, marked as sure."""
    if not len(records):
        return records, records
    order = np.lexsort((records["start"], records["owner"], records["text"], records["key"]))
    records = records[order]
    same = lambda names: np.r_[True, np.any([records[n][1:] != records[n][:-1] for n in names], axis=0)]
    place = same(("key", "text", "owner", "start"))
    sure = np.maximum.reduceat(records["sure"], np.flatnonzero(place))
    records = records[place]
    records["sure"] = sure
    begin = np.flatnonzero(same(("key", "text")))
    count = np.diff(np.r_[begin, len(records)])
    known = np.maximum.reduceat(records["sure"], begin) | (count > 1)
    decided = records[np.repeat(known, count) == 1]
    left = records[begin]
    left["sure"] = known
    return decided, left


def _rows(records: np.ndarray, opened: bool, hot: np.ndarray | bool = False) -> pd.DataFrame:
    key = records["key"].view(np.int64) if len(records) else np.zeros(0, np.int64)
    core = records["core"].astype(np.int32) if opened else np.int32(0)
    return pd.DataFrame({"_owner": records["owner"], "_start": records["start"], "_n": records["n"].astype(np.int32), "_core": core, "_key": key, "_sure": records["sure"] == 1, "_open": opened, "_hot": hot})


def _meet(least: int, key_bytes: int):
    """Decided contexts of a bucket, and one of each kind of those whose core is shared but not all else."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        records = np.frombuffer(b"".join(pdf["_records"][~pdf["_done"]]), RECORD)
        passed = np.frombuffer(b"".join(pdf["_records"][pdf["_done"]]), RECORD)
        decided, left = settle(records)
        parts = [_rows(np.ascontiguousarray(passed), False), _rows(decided, False)]
        if len(left):
            begin = np.flatnonzero(np.r_[True, left["key"][1:] != left["key"][:-1]])
            kinds = np.diff(np.r_[begin, len(left)])
            unsure = np.add.reduceat((left["sure"] == 0).astype(np.int64), begin)
            size = np.add.reduceat(left["n"].astype(np.int64) + least - 1, begin)
            asked = np.repeat((kinds > 1) & (unsure > 0), kinds)
            parts.append(_rows(left[asked], True, np.repeat(size > key_bytes, kinds)[asked]))
        return pd.concat([p for p in parts if len(p)] or parts[:1])

    return run


def _narrowed(least: int, sub: int):
    """Each context cut into runs of starts whose distance from the core is in the same ``sub`` distances.

    All strings of such a run also contain the bytes just left and right of the core, which make its own, longer core.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                far, near, text = r["_core"], r["_core"] - r["_n"] + 1, r["_text"]
                for block in range(near // sub, far // sub + 1):
                    high, low = min(far, block * sub + sub - 1), max(near, block * sub)
                    begin, n, core = far - high, high - low + 1, high - block * sub
                    key = xxhash.xxh64_intdigest(text[begin + core : begin + core + least - sub + 1], (r["_key"] + (block + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
                    kind = xxhash.xxh64_intdigest(text[begin : begin + n + least - 1], n * 256 + core)
                    rows.append((r["_owner"], r["_start"], r["_start"] + begin, n, core, key, kind, r["_sure"]))
            columns = list(zip(*rows)) if rows else [()] * 8
            columns[5], columns[6] = (np.array(c, np.uint64).view(np.int64) for c in columns[5:7])
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in CHILDREN.split(", ")])

    return run


def subdivided(texts: DataFrame, least: int, key_bytes: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Over contexts (TEXTS) of keys that are too large: decided ranges, and contexts of keys of at most ``key_bytes``.

    Two contexts of a key that share a string share it at the same distance from the core, so they meet again under one
    of the longer cores.  A core of all ``least`` bytes leaves nothing outside, so the rounds end.
    """
    decided, small = [], []
    sub = spread_of(least)
    while sub > 1:
        sub = -(-sub // NARROWER)
        children = checkpointed(texts.mapInArrow(_narrowed(least, sub), CHILDREN).dropDuplicates(["_owner", "_start"]))
        one = F.struct("_owner", "_from", "_start", "_n", "_core")
        kinds = children.groupBy("_key", "_kind").agg((F.max("_sure") | (F.count(F.lit(1)) > 1)).alias("_known"), F.min(one).alias("_one"))
        decided.append(children.filter("NOT _sure").join(kinds.filter("_known").select("_key", "_kind"), ["_key", "_kind"]).select("_owner", "_start", "_n"))
        keys = kinds.groupBy("_key").agg(F.count(F.lit(1)).alias("_kinds"), F.min("_known").alias("_settled"), F.sum(F.col("_one._n") + F.lit(least - 1)).alias("_size"))
        keys = keys.filter("_kinds > 1 AND NOT _settled").select("_key", (F.col("_size") > key_bytes).alias("_hot"))
        left = kinds.join(keys, "_key").select("_one.*", "_key", F.col("_known").alias("_sure"), "_hot")
        whole = texts.select("_owner", F.col("_start").alias("_from"), F.col("_text").alias("_whole"))
        piece = F.expr(f"substring(_whole, CAST(_start - _from AS INT) + 1, _n + {least - 1})")
        left = checkpointed(left.join(whole, ["_owner", "_from"]).select("_owner", "_start", "_n", "_core", "_key", "_sure", piece.alias("_text"), "_hot"))
        small.append(left.filter("NOT _hot").drop("_hot"))
        texts = left.filter("_hot").drop("_hot")
        if not texts.limit(1).count():
            break
    return decided, small


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least, by doubling; only ties are sorted again."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(3, np.int64)])
    bits = int(symbols.max()).bit_length()
    per = 62 // bits if bits < 31 else 2
    key = np.zeros(n, np.int64)
    padded = np.concatenate([symbols, np.zeros(per, np.int64)])
    for k in range(per):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = per
    while size < depth:
        tied = ~(new & np.r_[new[1:], True])
        if not tied.any():
            break
        where = np.flatnonzero(tied)
        suffix = order[where]
        second = rank[np.minimum(suffix + size, n)]
        resorted = np.lexsort((second, rank[suffix]))
        suffix, second = suffix[resorted], second[resorted]
        order[where] = suffix
        split = np.r_[True, (rank[suffix[1:]] != rank[suffix[:-1]]) | (second[1:] != second[:-1])]
        new = new.copy()
        new[where] |= split
        rank[suffix] = np.maximum.accumulate(np.where(split, where, 0))
        size *= 2
    return order


def long_prefixes(texts: list[bytes], least: int) -> list[np.ndarray]:
    """Per text, the starts of strings of ``least`` bytes that also start elsewhere in these texts.

    Breadth-first search over intervals of the transform: an interval holds all suffixes with one prefix; extended
    backward by each symbol before its suffixes it gives intervals of a prefix longer by one.  Where an interval ends and
    no value is set yet, the common prefix with the next suffix is exactly that long.  Values thus come in increasing
    order, and the search stops at ``least``: places still unset have common prefixes of at least so many bytes.  An
    interval whose end was set before adds nothing and is not followed.
    """
    size = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    closing = np.cumsum(size + 1) - 1
    symbols = raw.astype(np.int64) + 1
    symbols[closing] = 0
    n = len(raw)
    order = sorted_suffixes(_distinct_ends(symbols, closing), least)
    before = np.where(order > 0, order - 1, n - 1)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    letter = symbols[before]  # the transform; 0 before the first byte of a text
    back = inverse[before]  # where the suffix that begins one earlier stands
    first = symbols[order]
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    unset[:-1][(first == 0)] = False
    begin = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (first[1:] == 0)])  # every end is a symbol of its own
    unset[begin] = False
    end = np.r_[begin[1:], n]
    for length in range(2, least + 1):
        if not len(begin):
            break
        count = end - begin
        where = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        owner = np.repeat(np.arange(len(begin)), count)
        known = letter[where] > 0
        where, owner = where[known], owner[known]
        # suffixes of one interval with one symbol before them stand together one step back
        target = back[where]
        code = owner * 257 + letter[where]
        arranged = np.argsort(code, kind="stable")
        code, target = code[arranged], target[arranged]
        head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        begin = np.minimum.reduceat(target, head) if len(head) else head  # suffixes that tie to the depth stand in any order
        end = begin + np.diff(np.r_[head, len(code)])
        fresh = unset[begin] | unset[end]
        begin, end = begin[fresh], end[fresh]
        unset[begin] = False
        unset[end] = False
    repeated = unset[:-1] | unset[1:]
    starts = np.sort(order[repeated])
    text = np.searchsorted(closing, starts)
    offset = starts - (closing - size)[text]
    return [offset[a:b] for a, b in zip(np.searchsorted(text, np.arange(len(texts))).tolist(), np.searchsorted(text, np.arange(len(texts)), "right").tolist())]


def _distinct_ends(symbols: np.ndarray, closing: np.ndarray) -> np.ndarray:
    """Symbols with a different end for every text, all below any byte."""
    apart = symbols + len(closing)
    apart[closing] = np.arange(len(closing)) + 1
    return apart


def _transform(least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["_owner", "_start", "_n"])
        out = []
        for owner, start, n, starts in zip(pdf["_owner"], pdf["_start"], pdf["_n"], long_prefixes(list(pdf["_text"]), least)):
            starts = starts[starts < n]
            if len(starts):
                edge = np.flatnonzero(np.r_[True, starts[1:] != starts[:-1] + 1])
                out.append(pd.DataFrame({"_owner": owner, "_start": start + starts[edge], "_n": np.diff(np.r_[edge, len(starts)]).astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"_owner": np.zeros(0, np.int64), "_start": np.zeros(0, np.int64), "_n": np.zeros(0, np.int32)})

    return run


def candidates(docs: DataFrame, least: int, key_bytes: int = KEY_BYTES) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Over documents (_id, _text, _class): ranges of starts per class that are decided (_owner, _start, _n), contexts to
    compare (TEXTS, no key with more than ``key_bytes``), the documents per class (_class, _copies, _chosen), and the
    bytes of the contexts."""
    classes = checkpointed(docs.groupBy("_class").agg(F.count(F.lit(1)).alias("_copies"), F.min("_id").alias("_chosen")))
    total = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(8, -(-total // (80 * BUCKET_RECORDS)))

    def pack(records: np.ndarray, done: bool):
        number = ((records["owner"].view(np.uint64) if done else records["key"]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(number, kind="stable")
        records, number = records[order], number[order]
        edge = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(number) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            yield int(number[a]), done, records[a:b].tobytes()

    def send(batches):
        seen: set[int] = set()
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            fresh = []
            for i, name in enumerate(names):
                if name not in seen:
                    seen.add(name)
                    fresh.append(i)
            for a in range(0, len(fresh), 4096):
                some = fresh[a : a + 4096]
                records = contexts([(texts[i].as_py() or "").encode() for i in some], np.array([names[i] for i in some], np.int64), least)
                decided, left = settle(records)
                # what is decided here only passes through, dealt by document
                rows = [*pack(np.ascontiguousarray(decided), True), *pack(left, False)] if len(records) else []
                if rows:
                    number, done, blob = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(done), pa.array(blob, pa.binary())], ["_bucket", "_done", "_records"])

    packed = docs.select("_class", "_text").mapInArrow(send, "_bucket long, _done boolean, _records binary")
    met = checkpointed(packed.groupBy("_bucket").applyInPandas(_meet(least, key_bytes), FOUND))

    def cut(batches):
        seen: set[int] = set()  # rows that repeat an id and a text ask once
        for batch in batches:
            rows = {c.split()[0]: [] for c in f"{TEXTS}, _hot boolean".split(", ")}
            for name, text, requests in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if name in seen:
                    continue
                seen.add(name)
                raw = (text.as_py() or "").encode()
                for r in requests.as_py():
                    rows["_owner"].append(name)
                    for c in ("_start", "_n", "_core", "_key", "_sure", "_hot"):
                        rows[c].append(r[c])
                    rows["_text"].append(raw[r["_start"] : r["_start"] + r["_n"] + least - 1])
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_pydict(rows, pa.schema(list(zip(rows, types))))

    def fetched(asked: DataFrame) -> DataFrame:
        grouped = asked.groupBy(F.col("_owner").alias("_class")).agg(F.collect_set(F.struct("_start", "_n", "_core", "_key", "_sure", "_hot")).alias("_asked"))
        wanted = grouped.join(classes, "_class").select("_class", F.col("_chosen").alias("_id"), "_asked")
        return docs.join(wanted, ["_class", "_id"]).select("_class", "_text", "_asked").mapInArrow(cut, f"{TEXTS}, _hot boolean")

    asked = met.filter("_open")
    size = asked.filter("NOT _hot").agg(F.sum(F.col("_n") + least - 1)).first()[0] or 0
    decided, texts = met.filter("NOT _open").select("_owner", "_start", "_n"), fetched(asked)
    if asked.filter("_hot").limit(1).count():
        texts = checkpointed(texts)  # read by every round, while the documents are read once
        hot = texts.filter("_hot").drop("_hot")
        texts = texts.filter("NOT _hot").drop("_hot")
        more, small = subdivided(hot, least, key_bytes)
        for found in more:
            decided = decided.unionByName(found)
        for some in small:
            size += some.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
            texts = texts.unionByName(some)
    else:
        texts = texts.drop("_hot")
    return decided, texts, classes, size


def repeated_starts(docs: DataFrame, least: int, key_bytes: int = KEY_BYTES) -> tuple[DataFrame, DataFrame]:
    """Over documents (_id, _text, _class): ranges of starts per class that are repeated (_owner, _start, _n), and the
    documents per class (_class, _copies, _chosen)."""
    decided, texts, classes, size = candidates(docs, least, key_bytes)
    parts = max(1, -(-size // TRANSFORM_BYTES))
    dealt = texts.select("_owner", "_start", "_n", F.pmod("_key", F.lit(parts)).alias("_part"), "_text")
    compared = dealt.groupBy("_part").applyInPandas(_transform(least), "_owner long, _start long, _n int")
    return decided.unionByName(compared), classes


def remove_repeats(docs: DataFrame, least: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = KEY_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, _spans (begin and end of removed runs), _kept (bytes).

    Every byte covered by a string of ``least`` bytes that also starts elsewhere, in another document or the same one, is
    removed; strings are judged on the input.  Texts that occur as a whole more than once are removed whole, and only one
    of them per task is searched further.  Contexts decided within a task pass on one of their kind, so copies do not
    gather; others meet by a key of nearly 300 bytes of content, or of more where contexts of a key exceed ``key_bytes``.

    Null and empty texts have 0 bytes and one empty rest; repeated rows repeat each other; an empty table gives an empty
    result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("_doc"), text.alias("_text"), F.xxhash64(text).alias("_class"), F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("string")).alias("_id"))
    starts, classes = repeated_starts(named, least, key_bytes)
    ranges = starts.groupBy(F.col("_owner").alias("_class")).agg(F.collect_set(F.struct("_start", "_n")).alias("_ranges"))
    known = classes.filter("_copies > 1").select("_class", "_copies").join(ranges, "_class", "full")

    def finish(batches):
        for batch in batches:
            out = []
            for text, copies, found in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                raw = text.as_py().encode()
                spans = np.zeros((0, 2), np.int64)
                if (copies or 1) > 1 and len(raw) >= least:
                    spans = np.array([[0, len(raw)]])
                elif found.is_valid:
                    pairs = np.array([(r["_start"], r["_start"] + r["_n"] - 1 + least) for r in found.as_py()], np.int64)
                    pairs = pairs[np.argsort(pairs[:, 0])]
                    reach = np.maximum.accumulate(pairs[:, 1])
                    edge = np.flatnonzero(np.r_[True, pairs[1:, 0] > reach[:-1]])
                    spans = np.column_stack([pairs[edge, 0], reach[np.r_[edge[1:] - 1, len(pairs) - 1]]])
                begins, ends = [0, *spans[:, 1].tolist()], [*spans[:, 0].tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(begins, ends))
                out.append((len(raw), len(raw) - len(kept), len(spans), spans.tolist(), kept))
            n, gone, count, spans, kept = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "_spans", "_kept"],
            )

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, _spans array<array<long>>, _kept binary"
    return named.join(known, "_class", "left").select("_doc", "_text", "_copies", "_ranges").mapInArrow(finish, schema)


def op3_repeats(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("_kept", 256).alias("kept_sha256"))
