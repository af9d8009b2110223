"""Language-model scores: the probability of a text over all its segmentations into subword pieces."""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarf.llm.common import checkpointed, mix

CHUNK_BYTES = 6 << 20
LEAST = 0.1  # added to every count, of words in the base score and of pieces in the model
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FINAL = np.uint64(0xD1B54A32D192ED03)
SLOTS = 1 << 19
BATCH_WORDS = 40_000


def _byte_of_letter() -> dict[str, int]:
    """The printable alphabet of byte-level vocabularies: bytes that print stand for themselves, others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Pieces:
    """An existing vocabulary of pieces; those that end a word carry a mark.  Look-up by hash of bytes, vectorised."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = _byte_of_letter()
        self.codes, self.longest = np.zeros(len(vocabulary), np.uint64), 1
        for k, (piece, _) in enumerate(sorted(vocabulary.items(), key=lambda x: x[1])):
            final = piece.endswith("</w>")
            raw = bytes(letters[c] for c in (piece[:-4] if final else piece))
            self.longest = max(self.longest, len(raw))
            self.codes[k] = self.code(np.frombuffer(raw, np.uint8)[None, :], final)[0]
        self.size = len(vocabulary)
        self.keys, self.ids = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        left = np.arange(self.size)
        slot = self.codes % np.uint64(SLOTS)
        while len(left):
            free = self.ids[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            taken = np.flatnonzero(free)[first]
            self.ids[slot[taken]], self.keys[slot[taken]] = left[taken], self.codes[left[taken]]
            rest = np.ones(len(left), bool)
            rest[taken] = False
            left, slot = left[rest], (slot[rest] + np.uint64(1)) % np.uint64(SLOTS)

    @staticmethod
    def code(raw: np.ndarray, final: bool) -> np.ndarray:
        value = np.zeros(len(raw), np.uint64)
        for k in range(raw.shape[1]):
            value = (value + raw[:, k].astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        return Pieces.finish(value, final)

    @staticmethod
    def finish(value: np.ndarray, final: bool) -> np.ndarray:
        return mix(value ^ FINAL if final else value)

    def find(self, code: np.ndarray) -> np.ndarray:
        """Piece of each code, -1 where there is none."""
        slot = (code % np.uint64(SLOTS)).astype(np.int64)
        found = self.ids[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[slot] != code))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % SLOTS
            found[wrong] = self.ids[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[slot[wrong]] != code[wrong])]
        return found

    def arcs(self, letters: np.ndarray):
        """All pieces within words of one length, as (from, to, rows, piece), by increasing end."""
        n = letters.shape[1]
        wide = letters.astype(np.uint64) + np.uint64(1)
        running = {}
        for end in range(1, n + 1):
            for begin in range(max(0, end - self.longest), end):
                value = (running.get(begin, np.uint64(0)) + wide[:, end - 1]) * MULTIPLIER
                running[begin] = value
                piece = self.find(self.finish(value, end == n))
                rows = np.flatnonzero(piece >= 0)
                if len(rows):
                    yield begin, end, rows, piece[rows]
            running.pop(end - self.longest, None)


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


def by_length(words: list[bytes]):
    """(places, letters) of words of equal length, in batches."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    begin = 0
    while begin < len(order):
        n = size[order[begin]]
        end = begin + min(BATCH_WORDS, int(np.searchsorted(size[order[begin:]], n, "right")))
        places = order[begin:end]
        yield places, np.frombuffer(b"".join([words[i] for i in places.tolist()]), np.uint8).reshape(len(places), n)
        begin = end


def forward(pieces: Pieces, letters: np.ndarray, log_p: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Log probabilities of all segmentations of each prefix (one column per place), summed in log space."""
    ahead = np.full((len(letters), letters.shape[1] + 1), -np.inf)
    ahead[:, 0] = 0.0
    for begin, end, rows, piece in pieces.arcs(letters):
        ahead[rows, end] = np.logaddexp(ahead[rows, end], ahead[rows, begin] + log_p[piece])
        if keep is not None:
            keep.append((begin, end, rows, piece))
    return ahead


def word_scores(pieces: Pieces, words: list[bytes], log_p: np.ndarray) -> np.ndarray:
    """Natural-log probability of each word over all segmentations."""
    score = np.zeros(len(words))
    for places, letters in by_length(words):
        score[places] = forward(pieces, letters, log_p)[:, -1]
    return score


def expected_counts(pieces: Pieces, words: list[bytes], counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """How often each piece is used in expectation when every word takes its segmentations by their probability."""
    total = np.zeros(pieces.size)
    for places, letters in by_length(words):
        arcs: list = []
        ahead = forward(pieces, letters, log_p, arcs)
        behind = np.full_like(ahead, -np.inf)
        behind[:, -1] = 0.0
        for begin, end, rows, piece in reversed(arcs):
            rest = behind[rows, end] + log_p[piece]
            behind[rows, begin] = np.logaddexp(behind[rows, begin], rest)
            use = np.exp(ahead[rows, begin] + rest - ahead[rows, -1]) * counts[places[rows]]
            total += np.bincount(piece, use, pieces.size)
    return total


def _chunk_words(chunk_col: str, buckets: int):
    def words_of(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: dict[bytes, int] = {}
        for text, learn in zip(pdf["_text"], pdf["_learn"]):
            for word in text.encode().lower().split():
                seen[word] = seen.get(word, 0) + learn
        parts: dict[int, list] = {}
        for word in seen:
            parts.setdefault(zlib.crc32(word) % buckets, []).append(word)
        return pd.DataFrame({
            "_chunk": pdf["_chunk"].iloc[0], "_bucket": list(parts), "_words": [b" ".join(p) for p in parts.values()],
            "_counts": [np.array([seen[w] for w in p], "<i8").tobytes() for p in parts.values()],
        })

    return words_of


def _merged(pdf: pd.DataFrame) -> tuple[dict[bytes, int], list[list[bytes]]]:
    """All words of a bucket with their counts over all chunks, and the words of each row."""
    total: dict[bytes, int] = {}
    rows = []
    for words, counts in zip(pdf["_words"], pdf["_counts"]):
        rows.append(words.split(b" "))
        for word, count in zip(rows[-1], np.frombuffer(counts, "<i8").tolist()):
            total[word] = total.get(word, 0) + count
    return total, rows


def _bucket_totals(pdf: pd.DataFrame) -> pd.DataFrame:
    total, _ = _merged(pdf)
    known = [(w, c) for w, c in total.items() if c]
    return pd.DataFrame({"_bucket": [pdf["_bucket"].iloc[0]], "_known": [b" ".join(w for w, _ in known)], "_counts": [np.array([c for _, c in known], "<i8").tobytes()], "_tokens": [sum(c for _, c in known)], "_distinct": [len(known)], "_once": [sum(c == 1 for _, c in known)]})


def learn_pieces(totals: DataFrame, path: str, rounds: int) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces by expectation maximisation over the distinct training words.

    Scores start from the vocabulary's own order (a piece of rank r weighs 1 / (r + 3)).  Each round sums expected piece
    counts in Spark; every distinct word counts once, because the pieces are there for words not seen.  What comes to the
    driver is one number per piece of the vocabulary.
    """
    size = load_pieces(path).size
    log_p = -np.log(np.arange(size) + 3.0)
    log_p -= np.logaddexp.reduce(log_p)
    for _ in range(rounds):

        def expect(batches, current=log_p):
            pieces, sums = load_pieces(path), np.zeros(size)
            for pdf in batches:
                for known in pdf["_known"]:
                    if known:
                        words = known.split(b" ")
                        sums += expected_counts(pieces, words, np.ones(len(words)), current)
            used = np.flatnonzero(sums)
            yield pd.DataFrame({"piece": used, "uses": sums[used]})

        rows = totals.select("_known").mapInPandas(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full(size, LEAST)
        for row in rows:
            uses[row["piece"]] += row["uses"]
        log_p = np.log(uses / uses.sum())
    return log_p


def score_texts(docs: DataFrame, vocabulary: str, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score.

    Documents are dealt by hash into chunks of about CHUNK_BYTES.  A chunk gives its distinct words once to word buckets;
    a bucket sums the counts of its words over all chunks, so a frequent word is one entry per chunk, and returns count
    and lattice probability of each word to the chunks that asked.  Numbers of chunks and buckets grow with the bytes.

    A text is its words and an end.  Its score is log10 of the product of their probabilities.  A word's probability sums
    all its segmentations into pieces of which exactly the last is word-final; a word of the training texts also has an
    arc over the whole word, weighing its frequency.  Pieces and whole words share by the part of training tokens that
    occur once, which estimates how much of new text is unseen words; so all texts together have probability 1.  Null texts are empty and score the
    end alone; null ids are not held out; repeated rows count one by one; an empty table gives an empty result; extra
    columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    dealt = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), held.alias("_held"), (~held).cast("int").alias("_learn"), F.pmod(F.xxhash64(F.col(id_col), text), F.lit(chunks)).alias("_chunk"))
    asked = checkpointed(dealt.groupBy("_chunk").applyInPandas(_chunk_words("_chunk", chunks), "_chunk long, _bucket long, _words binary, _counts binary"))
    totals = checkpointed(asked.groupBy("_bucket").applyInPandas(_bucket_totals, "_bucket long, _known binary, _counts binary, _tokens long, _distinct long, _once long"))
    texts = docs.filter(~held).count()
    words_seen, distinct, once = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("_tokens", "_distinct", "_once")]).first()
    tokens, distinct = words_seen + texts, distinct + (texts > 0)
    log_p = learn_pieces(totals, vocabulary, rounds)
    floor = tokens + LEAST * (distinct + 1)
    unseen = (once + 1) / (words_seen + 2)
    log_end = np.log((texts + 1) / (tokens + 2))
    log_word = np.log1p(-np.exp(log_end))

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        total, rows = _merged(pdf)
        words = list(total)
        with np.errstate(divide="ignore"):
            whole = np.log(np.array([total[w] for w in words]) / max(words_seen, 1))
        both = np.logaddexp(np.log(unseen) + word_scores(load_pieces(vocabulary), words, log_p), np.log1p(-unseen) + whole)
        score = dict(zip(words, (log_word + both).tolist()))
        return pd.DataFrame({
            "_chunk": pdf["_chunk"], "_words": pdf["_words"],
            "_counts": [np.array([total[w] for w in row], "<i8").tobytes() for row in rows],
            "_scores": [np.array([score[w] for w in row], "<f8").tobytes() for row in rows],
        })

    def finish(texts_of: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        place: dict[bytes, int] = {}
        for row in answers["_words"]:
            for word in row.split(b" "):
                place[word] = len(place)
        count = np.frombuffer(b"".join(answers["_counts"]), "<i8")
        score = np.frombuffer(b"".join(answers["_scores"]), "<f8")
        base = np.log10((count + LEAST) / floor)
        out = []
        for text in texts_of["_text"]:
            words = text.encode().lower().split()
            at = np.fromiter((place[w] for w in words), np.int64, len(words))
            out.append((len(words) + 1, int((count[at] > 0).sum()) + (texts > 0), float(base[at].sum()), float(score[at].sum())))
        n, known, plain, model = zip(*out) if out else ((), (), (), ())
        end = np.log10((texts + LEAST) / floor)
        return pd.DataFrame({
            "doc_id": texts_of["_id"].astype("Int64"), "held_out": texts_of["_held"].astype(bool), "n_tokens": np.array(n, np.int64), "n_known": np.array(known, np.int64), "train_tokens": np.int64(tokens),
            "base_score": np.array(plain, float) + end, "score": (np.array(model, float) + log_end) / np.log(10.0),
        })

    answers = asked.groupBy("_bucket").applyInPandas(answer, "_chunk long, _words binary, _counts binary, _scores binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInPandas(finish, schema)


def op10_lm_score(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return score_texts(docs.select("doc_id", "text"), vocabulary)
