"""Ranked lexical search with a tree of documents, searched depth first with bounds.

Documents keep only terms that some item asks for.  In blocks of documents, such vectors are ordered by how frequent their
terms are in the corpus and share the paths of a prefix tree.  A node knows, over its whole subtree, the highest tf of each
term and the lowest m; as a term's score grows with tf and falls with m, they bound every document below.  Each item walks
the tree depth first, best bound first, and leaves out subtrees whose bound does not reach its worst kept score; the scores
kept so far go on to the next block of the task.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarf.llm.common import checkpointed

#: Bytes of item texts handled per pass over the documents; documents per tree; documents per leaf.
ITEM_BYTES = 4 << 20
TREE_DOCS = 4096
LEAF_DOCS = 16
#: Groups in which the answers of tasks meet before the last ranking.
MEETS = 64
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
LAST = np.iinfo(np.int64).max
VECTORS = "doc_id long, n long, terms array<int>, tfs array<long>, documents long"
FOUND = "item long, doc_id long, score long, task long"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all other characters, A-Z lower-cased."""
    return (text or "").encode().translate(TERM_BYTES).split()


def term_scores(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Tree:
    """A prefix tree of documents given as term lists (most frequent term first).

    Documents are sorted by their paths, so a node is a range of them: ``low`` and ``high``.  Nodes are numbered so that
    children follow each other; chains without a branch and ranges of at most ``leaf`` documents are one leaf.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, rank: np.ndarray, leaf: int = LEAF_DOCS):
        number = np.diff(ends, prepend=0)
        owner = np.repeat(np.arange(len(ids)), number)
        path = rank[terms]
        inside = np.lexsort((path, owner))
        path, terms, tfs = path[inside], terms[inside], tfs[inside]
        raw, cuts = path.astype(">u4").tobytes(), (4 * np.concatenate([[0], ends])).tolist()
        keys = [raw[x:y] for x, y in zip(cuts, cuts[1:])]
        order = sorted(range(len(keys)), key=lambda k: (keys[k], ids[k]))
        shared = [0]  # path length shared with the document before
        for x, y in zip(order, order[1:]):
            p, q = keys[x], keys[y]
            if p == q:
                shared.append(len(p) // 4)
            else:
                a, b = np.frombuffer(p, ">u4"), np.frombuffer(q, ">u4")
                n = min(len(a), len(b))
                differ = np.flatnonzero(a[:n] != b[:n])
                shared.append(int(differ[0]) if len(differ) else n)
        order = np.array(order, np.int64)
        number, begin = number[order], (ends - number)[order]
        self.ends = np.cumsum(number)
        take = np.arange(int(number.sum())) - np.repeat(self.ends - number, number) + np.repeat(begin, number)
        self.local, self.terms = np.unique(terms[take], return_inverse=True)
        tfs = tfs[take]
        self.ids, self.m = ids[order], m[order]
        self.scores = term_scores(tfs, np.repeat(self.m, number))
        self._divide(np.array(shared), leaf)
        self._bound(tfs, number)

    def _divide(self, shared: np.ndarray, leaf: int) -> None:
        low, high, child = [0], [len(self.ids)], []
        for node in iter(range(1 << 62)):
            if node == len(low):
                break
            x, y = low[node], high[node]
            if y - x <= leaf:
                child.append((0, 0))
                continue
            inner = shared[x + 1 : y]
            at = np.flatnonzero(inner == inner.min()) + x + 1
            edges, start = [x], x
            for a, b in zip(at.tolist(), [*at[1:].tolist(), y]):
                # small neighbours share a leaf
                if b - start > leaf and a > start:
                    edges.append(a)
                    start = a
            child.append((len(low), len(low) + len(edges)))
            low += edges
            high += [*edges[1:], y]
        self.low, self.high, self.child = np.array(low), np.array(high), child

    def _bound(self, tfs: np.ndarray, number: np.ndarray) -> None:
        """The highest tf of each term and the lowest m below each node, and from both the highest score of each term."""
        leaves = np.array([k for k, (a, b) in enumerate(self.child) if a == b])
        leaves = leaves[np.argsort(self.low[leaves])]
        leaf = np.zeros(len(self.ids), np.int64)
        leaf[self.low[leaves]] = 1
        leaf = leaves[np.cumsum(leaf) - 1]
        most = np.zeros((len(self.low), len(self.local)), np.int64)
        np.maximum.at(most, (np.repeat(leaf, number), self.terms), tfs)
        least, first = np.full(len(self.low), LAST), np.full(len(self.low), LAST)
        np.minimum.at(least, leaf, self.m)
        np.minimum.at(first, leaf, self.ids)
        for node in range(len(self.low) - 1, -1, -1):
            a, b = self.child[node]
            if a < b:
                most[node], least[node], first[node] = most[a:b].max(0), least[a:b].min(), first[a:b].min()
        self.most, self.first = term_scores(most, least[:, None]), first

    def search(self, terms: np.ndarray, weights: np.ndarray, kept: list, k: int) -> None:
        """Put better documents into ``kept``: at most ``k`` sorted pairs of (-score, id)."""
        at = np.searchsorted(self.local, terms)
        held = at < len(self.local)
        held[held] = self.local[at[held]] == terms[held]
        at, weights = at[held], weights[held]
        if not len(at):
            return
        bounds = (self.most[:, at] @ weights).tolist()
        full = np.zeros(len(self.local), np.int64)
        full[at] = weights
        stack = [0]
        while stack:
            node = stack.pop()
            if bounds[node] <= 0 or len(kept) == k and (-bounds[node], self.first[node]) >= kept[-1]:
                continue
            a, b = self.child[node]
            if a < b:
                stack += sorted(range(a, b), key=bounds.__getitem__)
                continue
            x, y = int(self.low[node]), int(self.high[node])
            begin = int(self.ends[x - 1]) if x else 0
            gained = full[self.terms[begin : self.ends[y - 1]]] * self.scores[begin : self.ends[y - 1]]
            total = np.add.reduceat(gained, np.concatenate([[0], self.ends[x : y - 1] - begin]))
            for d in np.flatnonzero(total > 0).tolist():
                one = (-int(total[d]), int(self.ids[x + d]))
                if len(kept) < k:
                    bisect.insort(kept, one)
                elif one < kept[-1]:
                    bisect.insort(kept, one)
                    kept.pop()


def restricted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with their number of terms and, of the vocabulary, their terms and how often they occur; documents without
    such a term are left out.  Each task adds one row with null n: documents with terms, all their terms, and df."""

    def vectors(batches):
        total, seen, df = 0, 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(ids), 256):
                found = [terms_of(t) for t in texts[k : k + 256].to_pylist()]
                n = np.array([len(f) for f in found], np.int64)
                total, seen = total + int(n.sum()), seen + int((n > 0).sum())
                known = [[vocabulary[w] for w in f if w in vocabulary] for f in found]
                codes = np.repeat(np.arange(len(found)) << 32, [len(x) for x in known]) | np.array([t for x in known for t in x], np.int64)
                kinds, tfs = np.unique(codes, return_counts=True)
                doc, term = kinds >> 32, kinds & 0xFFFFFFFF
                df += np.bincount(term, minlength=len(df))
                some, number = np.unique(doc, return_counts=True)
                offsets = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)
                lists = lambda values, kind: pa.ListArray.from_arrays(offsets, pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k + d] for d in some.tolist()], pa.int64()), pa.array(n[some]), lists(term, pa.int32()), lists(tfs, pa.int64()), pa.nulls(len(some), pa.int64())],
                    names=["doc_id", "n", "terms", "tfs", "documents"],
                )
        held = np.flatnonzero(df)
        row = {"doc_id": [total], "n": pa.nulls(1, pa.int64()), "terms": pa.array([held], pa.list_(pa.int32())), "tfs": pa.array([df[held]], pa.list_(pa.int64())), "documents": pa.array([seen], pa.int64())}
        yield pa.RecordBatch.from_pydict(row)

    return checkpointed(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(vectors, VECTORS))


def _search_block(docs: DataFrame, items: list[tuple[int, str]], k: int, columns: dict) -> DataFrame | None:
    """(item, doc_id, score, task): the best of each task."""
    asked = [(item, terms_of(text)) for item, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in asked for t in ts}))}
    if not vocabulary:
        return None
    vectors = restricted(docs, vocabulary, **columns)
    notes = vectors.where("n is null")
    # one row per term of this block of items
    df = np.zeros(len(vocabulary), np.int64)
    for row in notes.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.tfs").alias("df")).collect():
        df[row["terms"]] = row["df"]
    whole = notes.agg(F.sum("documents").alias("N"), F.sum("doc_id").alias("L")).first()
    many, length = whole["N"], whole["L"]
    if not many:
        return None
    weight = np.array([math.floor(1000 * math.log((2 * many + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    rank = np.zeros(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    queries = []
    for item, ts in asked:
        terms, repeats = np.unique(np.array([vocabulary[t] for t in ts], np.int64), return_counts=True)
        queries.append((item, terms, repeats * weight[terms]))

    def search(batches):
        from pyspark import TaskContext

        best = [[] for _ in queries]

        def run(parts):
            ids, n, ends, terms, tfs = (np.concatenate(c) for c in zip(*parts))
            m = np.array([75 + 25 * x * many // length for x in n.tolist()], np.int64)
            tree = Tree(ids, m, np.cumsum(ends), terms, tfs, rank, LEAF_DOCS)
            for (_, ts, ws), kept in zip(queries, best):
                tree.search(ts, ws, kept, k)

        waiting, held, step = [], 0, max(1, TREE_DOCS // 4)
        for batch in batches:
            for part in (batch.slice(s, step) for s in range(0, batch.num_rows, step)):
                ids = part.column(0).fill_null(LAST).to_numpy()
                lists = part.column(2), part.column(3)
                waiting.append((ids, part.column(1).to_numpy(), lists[0].value_lengths().to_numpy(), *(x.flatten().to_numpy() for x in lists)))
                held += len(ids)
                if held >= TREE_DOCS:
                    run(waiting)
                    waiting, held = [], 0
        if held:
            run(waiting)
        rows = [(item, None if d == LAST else d, -s) for (item, _, _), kept in zip(queries, best) for s, d in kept]
        task = TaskContext.get().partitionId()
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([task] * len(rows), pa.int64())], names=["item", "doc_id", "score", "task"])

    return vectors.where("n is not null").select("doc_id", "n", "terms", "tfs").mapInArrow(search, FOUND)


def _ranked(found: DataFrame, k: int, *keys: Column | str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", item_text: str = "text", **columns) -> DataFrame:
    """item, rank, doc_id and score of each item's ``k`` best documents with a score above 0.

    Items are met in blocks of about ITEM_BYTES of text, each with one pass over the documents.  Equal scores go by
    ascending id, null ids last; repeated rows of documents rank one by one; repeated items are answered one by one.
    Null, empty and termless texts have no terms: such documents count nowhere and such items get no rows, as does an
    empty table.  Scores are exact whatever the blocks, trees and leaves.
    """
    spark = docs.sparkSession
    numbered = checkpointed(items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).withColumn("item", F.monotonically_increasing_id()))
    blocks = (numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES + 1
    found = spark.createDataFrame([], FOUND)
    for block in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "text").collect()
        part = _search_block(docs, [tuple(r) for r in rows], k, columns)
        found = found if part is None else found.unionByName(part)
    # a task gives at most k rows per item; groups of tasks meet first
    best = _ranked(_ranked(found, k, "item", F.pmod("task", F.lit(MEETS))), k, "item")
    return best.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each benchmark item's 20 best documents."""
    return ranked_search(docs, benchmark)


OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS MATERIALIZED (
  SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
whole AS (SELECT count(*)::BIGINT AS nn, sum(len(ts))::BIGINT AS ll FROM d WHERE len(ts) > 0),
asked AS (SELECT q, item_id, t, count(*)::BIGINT AS c FROM (SELECT q, item_id, unnest(ts) AS t FROM i) GROUP BY ALL),
tf AS MATERIALIZED (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY t, nn),
s AS (SELECT q, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN w USING (t) JOIN tf USING (t), whole GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r))::INT AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 20
"""
