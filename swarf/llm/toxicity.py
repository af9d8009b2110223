"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its byte n-grams (edges of the word are marked by a space), so an unseen spelling
shares vectors with known ones.  The words of a window are averaged and go through a linear softmax over two classes; a
text is as toxic as its most toxic window, so a long text is not diluted.  Windows follow one another without gaps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from swarf.llm.common import IS_SPACE, LOWER, Words, pieces, prefix_hash, unpacked, with_row

GRAMS = (3, 4, 5)
BUCKET_BITS = 17
WIDTH = 12
WINDOW = 16
#: Part of the training weight that toxic texts bear together.
TOXIC_PART = 0.3
#: Strength of the log odds that vectors start from, and words of usual odds that are added to each bucket for them.
START, PRIOR = 20.0, 20.0


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of each window, for texts that follow one another with so many words each."""
    per_doc = -(-counts // WINDOW)
    docs = np.repeat(np.arange(len(counts)), per_doc)
    first = np.concatenate([[0], np.cumsum(counts)])
    begin = first[docs] + (np.arange(len(docs)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)) * WINDOW
    return docs, begin, np.minimum(WINDOW, first[docs + 1] - begin)


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, bucket) of all n-grams of distinct words, and the number of n-grams of each word."""
    owner, bucket, grams = [], [], []
    for a, b in pieces(words, 1 << 20):
        bags = Bags(words[a:b])
        inside = bags.word_at()
        for n in GRAMS:
            at, code = bags.buckets(n)
            owner.append(inside[at] + np.int32(a))
            bucket.append(code)
        grams.append(bags.grams)
    return np.concatenate(owner), np.concatenate(bucket), np.concatenate(grams)


class Bags:
    """Windows, words and n-gram buckets of some texts."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts)
        self.words, self.counts = words, words.counts
        buffer = np.where(IS_SPACE[words.buffer], np.uint8(32), words.buffer)
        self.sums, self.down = prefix_hash(buffer)
        size = words.ends - words.starts + 2
        self.grams = sum(np.maximum(size - n + 1, 0) for n in GRAMS)
        # bytes from each place to the closing edge of the word that the next byte belongs to
        self.room = np.zeros(len(buffer) + 1, np.int32)
        inside = np.repeat(words.ends + 1, size - 2) - np.arange(int((size - 2).sum())) - np.repeat(words.starts - 1, size - 2) + np.repeat(np.cumsum(size - 2) - (size - 2), size - 2)
        self.room[np.repeat(words.starts - 1 - (np.cumsum(size - 2) - (size - 2)), size - 2) + np.arange(int((size - 2).sum()))] = inside
        self.window_docs, self.window_first, self.window_size = windows(self.counts)

    def word_at(self) -> np.ndarray:
        """The word that the byte after each place belongs to."""
        number = np.zeros(len(self.sums), np.int32)
        number[self.words.starts[1:] - 1] = 1
        return np.cumsum(number, dtype=np.int32)

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where an n-gram begins, and its bucket."""
        at = np.flatnonzero(self.room[: len(self.sums) - n] >= n)
        code = (self.sums[at + n] - self.sums[at]) * self.down[at] * np.uint64(0xD6E8FEB86659FD93)
        return at, (code >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)

    def word_scores(self, value: np.ndarray) -> np.ndarray:
        """The mean bucket value of every word."""
        total = np.zeros(len(self.sums))
        for n in GRAMS:
            at, bucket = self.buckets(n)
            total[at] += value[bucket]
        running = np.concatenate([[0.0], np.cumsum(total)])
        return (running[self.words.ends] - running[self.words.starts - 1]) / self.grams

    def window_means(self, scores: np.ndarray) -> np.ndarray:
        return np.add.reduceat(scores, self.window_first) / self.window_size if len(self.window_first) else np.zeros(0)

    def text_scores(self, value: np.ndarray, bias: float) -> np.ndarray:
        """Probability of the most toxic window of each text; 0 without words."""
        best = np.full(len(self.counts), -np.inf)
        np.maximum.at(best, self.window_docs, self.window_means(self.word_scores(value)))
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best + bias, -50, 50))), 0.0)


class Adam:
    def __init__(self, shape, rate: float):
        self.first, self.second, self.rate, self.step = np.zeros(shape, np.float32), np.zeros(shape, np.float32), rate, 0

    def move(self, slope: np.ndarray) -> np.ndarray:
        self.step += 1
        self.first += 0.1 * (slope - self.first)
        self.second += 0.01 * (slope * slope - self.second)
        return self.rate * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.99**self.step)) + 1e-8)


def _log_odds(same: np.ndarray, counts: np.ndarray, labels: np.ndarray, owner: np.ndarray, bucket: np.ndarray, words: int) -> np.ndarray:
    """Per bucket, how much likelier than usual a word with it is in a toxic text; each text counts its distinct words."""
    seen = np.unique(np.repeat(np.arange(len(counts)), counts) * words + same)
    doc, word = seen // words, seen % words
    toxic, other = (np.bincount(bucket, np.bincount(word, labels[doc] == y, words)[owner], 1 << BUCKET_BITS) for y in (1, 0))
    part = toxic.sum() / (toxic.sum() + other.sum())
    return np.log((toxic + PRIOR * part) / (other + PRIOR * (1 - part))) - np.log(part / (1 - part))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 110, seed: int = 3, rate: float = 0.05, shrink: float = 2e-5) -> tuple[np.ndarray, float]:
    """Value of each bucket (its vector times the difference of the two softmax rows) and bias.

    Vectors and softmax learn together from all texts at once, each text through its most toxic window.  Vectors start
    from chance and from the log odds of their bucket among words of toxic and other texts, along the direction that the
    softmax tells apart.  Since both classes see the same mean vector, the slopes of vectors and softmax follow from one
    number per bucket: how much the error wants it changed.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    if labels.min() == labels.max() or not any(t.split() for t in texts):
        return np.zeros(1 << BUCKET_BITS), (3.0 if labels.min() == 1 else -3.0)
    known: dict[bytes, int] = {}
    spelled = [np.array([known.setdefault(w, len(known)) for w in text.translate(LOWER.tobytes()).split()], np.int32) for text in texts]
    same = np.concatenate(spelled)
    counts = np.array([len(x) for x in spelled])
    docs, window_first, window_size = windows(counts)
    owner, bucket, grams = grams_of(list(known))
    del known, spelled
    across = softmax[:, 1] - softmax[:, 0]
    odds = START * _log_odds(same, counts, labels, owner, bucket, len(grams))
    vectors += np.outer(odds, across / (across @ across)).astype(np.float32)
    bias += np.array([1.5, -1.5], np.float32)
    weight = np.where(labels == 1, TOXIC_PART / labels.sum(), (1 - TOXIC_PART) / (labels == 0).sum()).astype(np.float64)
    steps = [Adam(vectors.shape, rate), Adam(softmax.shape, rate), Adam(bias.shape, rate)]
    for _ in range(epochs):
        value = vectors @ (softmax[:, 1] - softmax[:, 0])
        scores = (np.bincount(owner, value[bucket], len(grams)) / grams)[same]
        means = np.add.reduceat(scores, window_first) / window_size
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, docs, means)
        hit = np.flatnonzero(means >= best[docs])
        used = hit[np.unique(docs[hit], return_index=True)[1]]
        logit = np.clip(means[used] + bias[1] - bias[0], -50, 50)
        error = (1 / (1 + np.exp(-logit)) - labels[docs[used]]) * weight[docs[used]]
        per_word = np.repeat(error / window_size[used], window_size[used])
        place = np.repeat(window_first[used] - np.cumsum(window_size[used]) + window_size[used], window_size[used]) + np.arange(len(per_word))
        wanted = np.bincount(same[place], per_word, len(grams)) / grams
        keep = np.flatnonzero(wanted[owner])
        pull = np.bincount(bucket[keep], wanted[owner[keep]], 1 << BUCKET_BITS).astype(np.float32)
        both = np.array([-1, 1], np.float32)
        slopes = (np.outer(pull, softmax @ both) + shrink * vectors, np.outer(vectors.T @ pull, both) + shrink * softmax, error.sum() * both)
        vectors -= steps[0].move(slopes[0])
        softmax -= steps[1].move(slopes[1])
        bias -= steps[2].move(slopes[2])
    return (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame, per_class: int, seed: int = 17) -> DataFrame:
    """At most ``per_class`` labelled training texts of either class, by a hash of the id; the bound is this parameter.

    Of documents that repeat a drawn id one is learnt from: the one whose text has the smallest hash.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    drawn = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # at most 2 * per_class ids, and one text for each
    found = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))


def fit(drawn: DataFrame) -> tuple[np.ndarray, float]:
    """Train in one task on the bounded sample; what comes to the driver is one number per bucket, and the bias."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.fillna({"text": ""}).sort_values(["doc_id", "text"])
        value, bias = train([t.encode() for t in pdf["text"]], pdf["toxic"].to_numpy(np.int64))
        return pd.DataFrame({"value": [value.astype("<f4").tobytes()], "bias": [bias]})

    row = drawn.groupBy(F.lit(0).alias("_all")).applyInPandas(learn, "value binary, bias double").first()
    if row is None:
        return np.zeros(1 << BUCKET_BITS, np.float32), -3.0
    return np.frombuffer(row["value"], "<f4"), row["bias"]


def score(docs: DataFrame, value: np.ndarray, bias: float, text_col: str = "text") -> DataFrame:
    """_row (the document) and ``_score``; texts without words (null, empty) get 0."""
    small = value.astype(np.float32)
    packed = with_row(docs, _text=F.col(text_col))
    schema = StructType([packed.schema["_row"], StructField("_score", DoubleType())])

    def scored(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            found = [Bags(texts[a:b]).text_scores(small, bias) for a, b in pieces(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], ["_row", "_score"])

    return packed.mapInArrow(scored, schema)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> DataFrame:
    """_row (the document) and ``_score`` in [0, 1].

    Learns only from labelled rows whose crc32(doc_id as text) mod 4 is not 2, at most ``per_class`` of either class, whole
    texts; nothing but the text enters a score.  Null labels and ids are not learned from; repeated rows score alike; an
    empty table gives an empty result; without labels of both classes all texts get one score.
    """
    value, bias = fit(sample(docs, labels, per_class))
    return score(docs, value, bias)


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and decision of every document."""
    scored = toxicity(docs.select("doc_id", "text"), labels)
    held = F.coalesce(F.crc32(F.col("_row.doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("_row.doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """The documents that are not predicted toxic, with the columns of the input."""
    return unpacked(toxicity(docs, labels).filter(F.col("_score") < limit), docs)
