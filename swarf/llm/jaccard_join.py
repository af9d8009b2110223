"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts with equal shingle sets are one class from the start.  A set needs 80 % of its shingles in common with a partner, so
a shingle found in one class only cannot help, and a class whose rare shingles fill its prefix has no partner at all.  The
shingles of all classes are therefore counted once, packed, and only those of several classes travel further.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarf.llm.common import Words, checkpointed, mix, pieces, unpacked, with_row

SHINGLE = 5
BUCKET_TOKENS = 1_500_000
DEEPEST = 8  # most shared prefix tokens that a class may ask for
VERIFY_COST = 8.0  # of one candidate, in entries of the prefix index
ROUNDS = 3
RARE = 24  # a shingle of more classes is hot
BITS = 512  # of the mark that bounds how much two classes can share
WEIGHTS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
SETS = "doc_id long, n_shingles long, _class long"
TOKENS = "_bucket long, _owners binary, _codes binary"
OWNER = np.dtype([("owner", "<i8"), ("n", "<u4"), ("count", "<u4")])
CANDIDATES = "_class long, _n int, _common int, _hot int, _fame double, _matches int, _bits array<long>, _prefix array<struct<token:long,level:int,hot:boolean>>, _bag binary"


def shingle_sets(texts: list[bytes]):
    """The sorted distinct shingle hashes of each text; a text of fewer than five words is one shingle."""
    for a, b in pieces(texts):
        words = Words(texts[a:b])
        code = words.hashes()
        rolled = np.zeros(max(len(code) - SHINGLE + 1, 0), np.uint64)
        for k in range(SHINGLE):
            rolled += code[k : len(code) - SHINGLE + 1 + k] * WEIGHTS[k] if len(rolled) else rolled
        rolled = mix(rolled)
        for begin, count in zip(words.first.tolist(), words.counts.tolist()):
            if count >= SHINGLE:
                yield np.unique(rolled[begin : begin + count - SHINGLE + 1])
            elif count:
                yield mix((code[begin : begin + count] * WEIGHTS[:count]).sum(keepdims=True, dtype=np.uint64) + np.uint64(count))
            else:
                yield np.zeros(0, np.uint64)


def class_of(codes: np.ndarray) -> int:
    """64-bit name of a set, made from all its hashes and their number."""
    return int(np.uint64(xxhash.xxh64_intdigest(codes.tobytes(), len(codes))).astype(np.int64))


def _texts(column) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit name of all rows with one id and text."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("string"), F.col(text_col))


def document_sets(docs: DataFrame, id_col: str, text_col: str, keyed: bool) -> DataFrame:
    """(doc_id, n_shingles, _class) per document, and its row key as _row if ``keyed``."""
    also = [row_key(id_col, text_col).alias("_row")] if keyed else []

    def name(batches):
        for batch in batches:
            sets = [(len(s), class_of(s)) for s in shingle_sets(_texts(batch.column(1)))]
            n, names = zip(*sets) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.int64()), *batch.columns[2:]], ["doc_id", "n_shingles", "_class", "_row"][: 3 + keyed])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col), *also).mapInArrow(name, SETS + ", _row long" * keyed)


def class_tokens(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """Shingles of every class, packed by bucket of the hash; a task sends each class once, however many copies it reads."""

    def pack(sets: list[np.ndarray], names: list[int]):
        size = np.array([len(s) for s in sets])
        codes = np.concatenate(sets)
        bucket = (codes % np.uint64(buckets)).astype(np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(bucket, kind="stable")
        bucket, owner = bucket[order], owner[order]
        codes = codes[order]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        names_of = np.array(names, np.int64)
        rows = {"_bucket": [], "_owners": [], "_codes": []}
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            who, count = np.unique(owner[begin:end], return_counts=True)
            head = np.zeros(len(who), OWNER)
            head["owner"], head["n"], head["count"] = names_of[who], size[who], count
            rows["_bucket"].append(int(bucket[begin]))
            rows["_owners"].append(head.tobytes())
            rows["_codes"].append(codes[begin:end].tobytes())
        return pa.RecordBatch.from_pydict(rows, pa.schema([("_bucket", pa.int64()), ("_owners", pa.binary()), ("_codes", pa.binary())]))

    def send(batches):
        sent: set[int] = set()
        sets, names, held = [], [], 0
        for batch in batches:
            for codes in shingle_sets(_texts(batch.column(0))):
                name = class_of(codes)
                if len(codes) and name not in sent:
                    sent.add(name)
                    sets.append(codes)
                    names.append(name)
                    held += len(codes)
                    if held > 2_000_000:
                        yield pack(sets, names)
                        sets, names, held = [], [], 0
        if sets:
            yield pack(sets, names)

    return docs.select(text_col).mapInArrow(send, TOKENS)


def _common_tokens(slices: int):
    """From all shingles of a bucket keep those of several classes, with the number of classes, packed by slice of classes."""

    def common(pdf: pd.DataFrame) -> pd.DataFrame:
        heads = np.frombuffer(b"".join(pdf["_owners"]), OWNER)
        codes = np.frombuffer(b"".join(pdf["_codes"]), np.uint64)
        order = np.argsort(codes)
        sorted_codes = codes[order]
        same = sorted_codes[1:] == sorted_codes[:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        at = np.repeat(np.arange(len(heads), dtype=np.int32), heads["count"])[order]
        owner, code, n = heads["owner"][at], codes[order], heads["n"][at]
        # a class that several tasks sent counts once
        order = np.lexsort((owner, code))
        owner, code, n = owner[order], code[order], n[order]
        first = np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])] if len(code) else np.zeros(0, bool)
        owner, code, n = owner[first], code[first], n[first]
        _, place, classes = np.unique(code, return_inverse=True, return_counts=True)
        classes = classes[place]
        keep = classes > 1
        owner, n, classes = owner[keep], n[keep], classes[keep].astype(np.uint32)
        token = code[keep]
        piece = (owner % slices).astype(np.int64)
        order = np.lexsort((owner, piece))
        owner, n, classes, token, piece = owner[order], n[order], classes[order], token[order], piece[order]
        edges = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True]) if len(piece) else np.zeros(1, np.int64)
        rows = []
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            who, where, count = np.unique(owner[begin:end], return_index=True, return_counts=True)
            head = np.zeros(len(who), OWNER)
            head["owner"], head["n"], head["count"] = who, n[begin:end][where], count
            rows.append((int(piece[begin]), head.tobytes(), token[begin:end].tobytes(), classes[begin:end].tobytes()))
        return pd.DataFrame(rows, columns=["_slice", "_owners", "_tokens", "_classes"])

    return common


def prefix_length(n: int, matches: int) -> int:
    """Tokens of which a partner must share ``matches``: all but those of a least overlap, and one less than the matches."""
    return n - (4 * n + 4) // 5 + matches


def choose_matches(n: int, alone: int, classes: np.ndarray) -> int:
    """How many shared prefix tokens to ask for: the number with the least estimated cost.

    A longer prefix reads more index entries (the classes of its tokens) but a partner must match more of them, so the
    candidates to verify are about the entries divided by the matches.
    """
    deepest = min(DEEPEST, (4 * n + 4) // 5)
    entries = np.concatenate([[0.0], np.cumsum(classes.astype(float))])
    ends = np.clip(np.array([prefix_length(n, k) for k in range(1, deepest + 1)]) - alone, 0, len(classes))
    cost = entries[ends] * (1 + VERIFY_COST / np.arange(1, deepest + 1))
    return int(cost.argmin()) + 1


def _prefixes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Classes of a slice that can have partners, with prefix tokens and all common tokens."""
    heads = np.frombuffer(b"".join(pdf["_owners"]), OWNER)
    owner, n = np.repeat(heads["owner"], heads["count"]), np.repeat(heads["n"], heads["count"]).astype(np.int64)
    token, classes = np.frombuffer(b"".join(pdf["_tokens"]), np.uint64), np.frombuffer(b"".join(pdf["_classes"]), np.uint32)
    order = np.argsort(owner, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0, True]) if len(owner) else np.zeros(1, np.int64)
    rows = []
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        mine = order[begin:end]
        size, common = int(n[mine[0]]), end - begin
        alone = size - common  # shingles of no other class come first in the order of rarity
        if alone >= prefix_length(size, 1):
            continue
        mine = mine[np.lexsort((token[mine], classes[mine]))]
        matches = choose_matches(size, alone, classes[mine])
        used = mine[: prefix_length(size, matches) - alone]
        levels = np.maximum(alone + np.arange(len(used)) + 2 - prefix_length(size, 1), 1)
        hot = classes[mine] > RARE
        prefix = [{"token": t, "level": v, "hot": h} for t, v, h in zip(token[used].view(np.int64).tolist(), levels.tolist(), hot.tolist())]
        mark = np.zeros(BITS, np.uint8)
        mark[(token[mine] % np.uint64(BITS)).astype(np.int64)] = 1
        bits = np.packbits(mark).view(np.int64).tolist()
        rows.append((int(owner[mine[0]]), size, common, int(hot.sum()), float(classes[mine].sum()) / size, matches, bits, prefix, np.sort(token[mine]).tobytes()))
    return pd.DataFrame(rows, columns=["_class", "_n", "_common", "_hot", "_fame", "_matches", "_bits", "_prefix", "_bag"])


def similar(common: Column, a: Column, b: Column) -> Column:
    return 100 * common >= 80 * (a + b - common)


def _can_match(other: str) -> Column:
    """Whether the row's token lets two classes be similar enough: over hot tokens only when those alone suffice.

    Classes that need more than their hot shingles share a rare one.  Rare tokens come before hot ones in every prefix, so
    such a pair meets over a rare token, and no pair needs the long list of a hot token without reason.
    """
    both = lambda c: F.least(c, other.format(c))
    enough = lambda c: similar(both(c), F.col("_n"), F.col(other.format("_n")))
    return enough("_common") & (~F.col("hot") | enough("_hot"))


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) that share enough, by their common tokens."""

    def check(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            left, right = batch.column("bag_a"), batch.column("bag_b")
            shared = [len(np.intersect1d(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64), True)) for i in range(len(a))]
            shared = np.array(shared, np.int64)
            good = 100 * shared >= 80 * (n - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    side = lambda x: bags.select(F.col("_class").alias(x), F.col("_n").alias(f"n{x}"), F.col("_bag").alias(f"bag_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long")


def _star_round(entries: DataFrame, labels: DataFrame, bags: DataFrame, number: int) -> DataFrame:
    """Verified links (a, b) of classes to the leading class of one of their prefix tokens.

    Each class tries the leader with which it shares most prefix tokens.  In the first round the class whose shingles are
    in most classes leads, which is the middle of a group of near copies, later one chosen by hash.  Only classes with another label are tried, so a group of
    near copies costs one try per member, not one per pair.
    """
    now = entries.join(labels, "_class")
    rank = F.struct((F.col("_fame") if number == 0 else F.xxhash64(F.lit(number), "_class")).alias("r"), F.col("_class").alias("c"))
    lead = now.groupBy("token").agg(F.max_by(F.struct("_class", "_n", "_common", "_hot", "_label"), rank).alias("lead"), (F.min("_label") != F.max("_label")).alias("mixed")).filter("mixed")
    tries = now.join(lead, "token").filter((F.col("_label") != F.col("lead._label")) & _can_match("lead.{}"))
    counted = tries.groupBy(F.col("_class").alias("a"), F.col("lead._class").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    best = counted.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    return _verified(best, bags)


def _at_most_shared() -> Column:
    """A bound on the shared shingles of two classes: each bit that only one has stands for one that the other lacks."""
    lacking = lambda a, b: sum((F.bit_count(F.col(a)[k].bitwiseAND(F.bitwise_not(F.col(b)[k]))) for k in range(BITS // 64)), F.lit(0))
    return F.least(F.col("_common") - lacking("_bits", "r_bits"), F.col("r_common") - lacking("r_bits", "_bits"))


def _other_pairs(entries: DataFrame, labels: DataFrame, bags: DataFrame) -> DataFrame:
    """All remaining candidates: classes of different labels that share as many prefix tokens as both ask for.

    A pair whose hot tokens do not suffice was not met over them, so one shared rare token makes it a candidate.
    """
    now = entries.join(labels, "_class")
    mixed = now.groupBy("token").agg((F.min("_label") != F.max("_label")).alias("mixed")).filter("mixed").select("token")
    left = checkpointed(now.join(mixed, "token").join(bags.select("_class", "_bits"), "_class"))
    right = left.select(*[F.col(c).alias(f"r{c}") for c in left.columns])
    close = (F.col("token") == F.col("rtoken")) & (F.col("_class") < F.col("r_class")) & (F.col("_label") != F.col("r_label"))
    close &= _can_match("r{}") & similar(_at_most_shared(), F.col("_n"), F.col("r_n"))
    over_hot = similar(F.least("_hot", "r_hot"), F.col("_n"), F.col("r_n"))
    asked = F.when(over_hot, F.least("_matches", "r_matches")).otherwise(1)
    close &= F.greatest("level", "rlevel") <= F.least("_matches", "r_matches")
    pairs = left.join(right, close).groupBy(F.col("_class").alias("a"), F.col("r_class").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min(asked).alias("asked"))
    return pairs.filter("shared >= asked").select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(_class, _component) of all linked classes, the component named by its smallest class.

    Every round each class takes the smallest name among its neighbours, then that name's own name, so long chains halve.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct())
    names = both.groupBy(F.col("a").alias("_class")).agg(F.least(F.col("_class"), F.min("b")).alias("_component"))
    names = checkpointed(names)
    while True:
        near = both.join(names.withColumnRenamed("_class", "b"), "b").groupBy(F.col("a").alias("_class")).agg(F.min("_component").alias("_near"))
        least = names.join(near, "_class").select("_class", "_component", F.least("_component", "_near").alias("_new"))
        jump = names.select(F.col("_class").alias("_new"), F.col("_component").alias("_jump"))
        step = checkpointed(least.join(jump, "_new").select("_class", F.least("_new", "_jump").alias("_component"), (F.least("_new", "_jump") != F.col("_component")).alias("_moved")))
        names = step.select("_class", "_component")
        if not step.filter("_moved").limit(1).count():
            return names


def classified(docs: DataFrame, id_col: str, text_col: str, keyed: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, _component (a class of its component), and _row if ``keyed``; see joined."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = max(8, -(-size // (6 * BUCKET_TOKENS)))
    sets = checkpointed(document_sets(docs, id_col, text_col, keyed))
    tokens = class_tokens(docs, text_col, buckets)
    common = tokens.groupBy("_bucket").applyInPandas(_common_tokens(buckets), "_slice long, _owners binary, _tokens binary, _classes binary")
    bags = checkpointed(common.groupBy("_slice").applyInPandas(_prefixes, CANDIDATES))
    entries = bags.select("_class", "_n", "_common", "_hot", "_fame", "_matches", F.inline("_prefix"))
    labels = bags.select("_class", F.col("_class").alias("_label"))
    found = []
    for number in range(ROUNDS):
        links = checkpointed(_star_round(entries, labels, bags, number))
        found.append(links)
        lead = links.select(F.col("a").alias("_class"), F.col("b").alias("_to")).join(labels.select(F.col("_class").alias("_to"), F.col("_label").alias("_lead")), "_to").drop("_to")
        labels = checkpointed(labels.join(lead, "_class", "left").select("_class", F.coalesce("_lead", "_label").alias("_label")))
    found.append(_verified(_other_pairs(entries, labels, bags), bags))
    # a label is a class that its bearer is linked with, over however many links
    names = components(reduce(DataFrame.unionByName, found))
    also = ["_row"] if keyed else []
    return sets.join(names, sets["_class"] == names["_class"], "left").select("doc_id", "n_shingles", *also, F.coalesce("_component", sets["_class"]).alias("_component"))


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, the smallest id reachable over links of similarity 0.8 or more.

    * Shingles are 64-bit hashes of five lower-case words, compared on all 64 bits; classes of equal sets are named by a 64-bit hash of the set.
    * Packed shingles meet by hash bucket; the number of buckets follows the bytes, and copies are sent once per task.
    * A class asks for 1 to 8 shared prefix tokens, whichever costs least by the numbers of classes per token, and its
      prefix is longer by as many.  Two classes are candidates when they share as many as the less demanding one asks.
    * Leaders of tokens are tried first, one per class and round; what then has other labels is tried pair by pair, so no
      link between different components is lost.  Links are decided on all shingles of both sets.

    Null or empty texts have no shingles and are their own component; null ids never name a component unless all are
    null; repeated rows and ids stay separate rows; an empty table gives an empty result; other columns are ignored.
    """
    named = classified(docs, id_col, text_col)
    named = named.withColumn("_empty", F.col("n_shingles") == 0)
    firsts = named.filter("NOT _empty").groupBy("_component").agg(F.min("doc_id").alias("_first"))
    full = named.filter("NOT _empty").join(firsts, "_component").select("doc_id", "n_shingles", F.col("_first").alias("component_id"))
    return full.unionByName(named.filter("_empty").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op5_jaccard_join(docs: DataFrame) -> DataFrame:
    return joined(docs.select("doc_id", "text"))


def first_documents(docs: DataFrame) -> DataFrame:
    """One row of each component (of the smallest id, nulls last), with the columns of the input.

    Rows are told apart by id and text together, so of rows that repeat an id each is judged by its own text; of rows with
    one id and one text a single one stays.  Rows without words have no partner and all stay.
    """
    named = classified(docs, "doc_id", "text", keyed=True).filter("n_shingles > 0")
    named = checkpointed(named)
    firsts = named.groupBy("_component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_first")).select(F.col("_first._row").alias("_row"), F.lit(True).alias("_stays"))
    keys = named.groupBy("_row").agg(F.count(F.lit(1)).alias("_rows")).join(firsts, "_row", "left")
    judged = checkpointed(keys.filter("_stays IS NULL OR _rows > 1").select(F.col("_row").alias("_judged"), F.col("_stays").isNotNull().alias("_again")))
    rows = with_row(docs, _judged=row_key("doc_id", "text"))
    kept = rows.join(judged, "_judged", "left_anti").select("_row")
    again = judged.filter("_again").select("_judged")
    if again.limit(1).count():
        one = rows.join(again, "_judged").groupBy("_judged").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
        kept = kept.unionByName(one.select("_row"))
    return unpacked(kept, docs)
