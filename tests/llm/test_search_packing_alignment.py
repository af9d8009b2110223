import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_rows import CLASHES, make

from swarf.llm import alignment, lexical, packing, token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


# ---- words as written


@pytest.mark.parametrize("path", [WORDS, A])
def test_encoding_equals_the_library_on_marks_spaces_and_contractions(path):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    letters = list("abTWYJHxyz.,'!?09 ") * 3 + list("̸̱̈̊̌́ \u0085    　​\u001c\u001f\t\n\x0b\x0c\réRíßİΣσ가가")
    letters += ["'s", "'LL", "'d", "<|endoftext|>", "<|", "|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_files.encode([t.encode() for t in texts], path) == want


# ---- packing


def unpacked(patterns):
    return [length for often, parts in patterns for length, copies in parts.items() for _ in range(often * copies)]


@pytest.mark.parametrize("capacity", [7, 30, 64])
def test_plans_use_every_piece_and_fill_sequences(capacity):
    rng = np.random.default_rng(capacity)
    for trial in range(60):
        lengths = rng.integers(1, rng.integers(2, capacity + 2), rng.integers(0, 80))
        distinct, counts = np.unique(lengths, return_counts=True)
        have = np.zeros(capacity + 1, np.int64)
        have[distinct] = counts
        exact, rest = packing._exact(have.copy())
        assert all(sum(k * c for k, c in parts.items()) == capacity for _, parts in exact)
        patterns = exact + packing._best_fit(rest)
        assert sorted(unpacked(patterns)) == sorted(lengths.tolist())
        assert all(sum(k * c for k, c in parts.items()) <= capacity and often > 0 for often, parts in patterns)
        plain = sum(often for often, _ in packing._best_fit(have))
        assert sum(often for often, _ in patterns) <= 1.1 * plain + 1


def test_sum_index_follows_availability():
    rng = np.random.default_rng(1)
    for _ in range(30):
        have = np.zeros(25, np.int64)
        np.add.at(have, rng.integers(1, 25, 9), 1)
        index = packing.SumIndex(have)
        while have.any():
            for s in range(1, 25):
                two = sum(1 for x in range(1, s // 2 + 1) if have[x] and have[s - x] and (2 * x != s or have[x] > 1))
                assert index.pairs[s] == two
                assert index.triples[s] == sum(1 for z in range(1, s) if have[z] and index.pairs[s - z])
                items = [k for k in range(1, 25) for _ in range(have[k])]
                possible = any(sum(c) == s for n in (1, 2, 3) for c in itertools.combinations(items, n))
                found = index.complement(s, {})
                assert (found is not None) == possible and (found is None or sum(found) == s)
            length = int(rng.choice(np.flatnonzero(have)))
            index.use(length, int(rng.integers(1, have[length] + 1)))


def check_places(pdf, capacity):
    for _, group in pdf.sort_values("offset").groupby("sequence_id"):
        ends = np.cumsum(group["length"])
        assert group["offset"].to_list() == [0, *ends[:-1]] and ends.iloc[-1] <= capacity


def test_packing_places_every_piece(spark, edge_docs, edge_rows, no_docs):
    ids = [np.frombuffer(x, "<u4") for x in token_files.encode([(t or "").encode() for _, t, _ in edge_rows], WORDS)]
    ids = [np.append(x, np.uint32(1)).astype("<u4") for x in ids]
    want = collections.Counter((-1 if r[0] is None else r[0], k, s, len(x[s : s + 64]), zlib.crc32(x[s : s + 64].tobytes())) for r, x in zip(edge_rows, ids) for k, s in enumerate(range(0, len(x), 64)))
    got = packing.pack(edge_docs, WORDS, 64, with_ids=True).toPandas()
    assert collections.Counter(zip(got["doc_id"].fillna(-1).astype(int), got["piece"], got["start"], got["length"], got["ids_crc32"])) == want
    assert all(len(x) == 4 * n and zlib.crc32(x) == c for x, n, c in zip(got["ids"], got["length"], got["ids_crc32"]))
    check_places(got, 64)
    total = int(got["length"].sum())
    assert got["sequence_id"].nunique() <= -(-total // 64) + 1
    whole = packing.op12_pack(edge_docs).toPandas()
    check_places(whole, 4096)
    assert whole["length"].sum() == total and packing.op12_pack(no_docs).count() == 0


def test_packing_of_one_common_length_over_many_tasks(spark):
    rows = [(k, "one two" if k % 3 else "three", "a") for k in range(700)]
    got = packing.pack(make(spark, rows).repartition(7), WORDS, 10).toPandas()
    check_places(got, 10)
    # 466 pieces of 3 and 234 of 2: 117 sequences 3 3 2 2 use up the short ones, 78 hold what is left
    assert len(got) == 700 and got["sequence_id"].nunique() == 117 + 78


# ---- ranked search


def brute_search(rows, items, k=20):
    terms = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in rows]
    docs = [d for d in docs if d[2]]
    many, length = len(docs), sum(d[2] for d in docs)
    df = collections.Counter(t for d in docs for t in d[1])
    found = []
    for item, text in items:
        scored = []
        for i, tf, n in docs:
            m = 75 + 25 * n * many // length
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if t in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        found += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return found


@pytest.mark.parametrize("docs_per_tree, leaf", [(4096, 16), (8, 2), (3, 1)])
def test_search_equals_brute_force(spark, edge_docs, edge_rows, no_docs, monkeypatch, docs_per_tree, leaf):
    monkeypatch.setattr(lexical, "TREE_DOCS", docs_per_tree)
    monkeypatch.setattr(lexical, "LEAF_DOCS", leaf)
    rows = [(i, t) for i, t, _ in edge_rows] + [(500 + k // 2, "tie word3 Word4") for k in range(60)]
    docs = make(spark, [(i, t, "a") for i, t in rows]).repartition(3)
    items = [(1, "Word3 word4, word4; nothing"), (2, None), (3, " .,"), (4, rows[9][1]), (5, "tie"), (5, "tie"), (6, "w7é w14é W7É"), (None, "word5"), (7, "unknown")]
    asked = spark.createDataFrame([(*x, "x", "x") for x in items], "item_id long, text string, score string, item string")
    got = sorted((tuple(r) for r in lexical.ranked_search(docs, asked).collect()), key=str)
    assert got == sorted(brute_search(rows, items), key=str)
    assert lexical.op11_search(no_docs, asked).count() == 0 and lexical.op11_search(docs, asked.limit(0)).count() == 0


def test_search_in_several_blocks_of_items(spark, edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 30)
    items = [(k, f"word{k} word{k + 1} tie") for k in range(12)]
    got = sorted(tuple(r) for r in lexical.ranked_search(edge_docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert [(i, r, s) for i, r, _, s in got] == [(i, r, s) for i, r, _, s in sorted(brute_search([(i, t) for i, t, _ in edge_rows], items), key=lambda x: x[:2])]


# ---- alignment


def brute_alignment(text, a, b, a_bytes, b_bytes):
    """(n_a, n_b, groups, links) of a whole text, or none without tokens."""

    def spans(ids, table):
        place, out = 0, []
        for k in ids:
            out.append((place, place + len(table[k]), k))
            place += len(table[k])
        return out

    if not text:
        return None
    full = (" " + text).encode()
    xs, ys = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if b"".join(a_bytes[k] for k in xs) != full or b"".join(b_bytes[k] for k in ys) != full:
        return None
    xs, ys = spans(xs, a_bytes), spans(ys, b_bytes)
    groups, begin = [], 0
    for cut in sorted({e for _, e, _ in xs} & {e for _, e, _ in ys}):
        groups.append(",".join(str(k) for s, _, k in xs if begin <= s < cut) + "|" + ",".join(str(k) for s, _, k in ys if begin <= s < cut))
        begin = cut
    links, first = collections.Counter(), 0
    for s, e, k in xs:
        while ys[first][1] <= s:
            first += 1
        for x, y, j in itertools.takewhile(lambda z: z[0] < e, ys[first:]):
            links[k, j] += 1
    return len(xs), len(ys), ";".join(groups), links


def odd_texts(number, most=25):
    rng = random.Random(3)
    letters = list("abTheing.,'!?09") * 2 + [" "] * 8 + ["  ", "\n", "\n\n", "\t", "\r\n", " \n", "\n "] + list("é一가 　\x00\x1c\u0085▁ß\U0001f600́")
    letters += ["<s>", "</s>", "<0x0A>", "<|endoftext|>", "<unk>", " the", " and"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(number)]


def test_alignment_of_units_equals_whole_texts(monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_UNITS", 3000)
    al = alignment.Aligner(A, B)
    texts = odd_texts(6000)
    for at in range(0, len(texts), 500):
        counts, groups, doc, code, times = al.documents(texts[at : at + 500])
        for k, text in enumerate(texts[at : at + 500]):
            got = collections.Counter()
            for c, n in zip(code[doc == k].tolist(), times[doc == k].tolist()):
                got[c >> 32, c & 0xFFFFFFFF] += n
            want = brute_alignment(text, al.a, al.b, al.a_bytes, al.b_bytes) or (0, 0, "", {})
            assert (*counts[k, :2], groups[k], got) == want and counts[k, 3] == got.total()
            assert counts[k, 2] == (groups[k].count(";") + 1 if groups[k] else 0)


def test_aligned_documents_equal_brute_force(spark, edge_rows, no_docs, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    rows = [(i, t, s) for i, t, s in edge_rows if len(t or "") < 5000] + [(1000 + k, t, "odd") for k, t in enumerate(odd_texts(300, 60))]
    al = alignment.Aligner(A, B)
    whole = [(i, brute_alignment(t, al.a, al.b, al.a_bytes, al.b_bytes)) for i, t, _ in rows]
    count = collections.Counter(p for _, w in whole if w for p in w[3])
    most = collections.defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = []
    for i, w in whole:
        if w is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = w[3]
        best = sum(n for p, n in links.items() if count[p] == most[p[0]])
        want.append((i, w[0], w[1], w[2].count(";") + 1, links.total(), best, sum(n * count[p] for p, n in links.items()), hashlib.sha256(w[2].encode()).hexdigest()))
    got = [tuple(r) for r in alignment.op13_align(make(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert alignment.op13_align(no_docs).count() == 0


def test_alignment_keeps_groups_as_text(spark):
    docs = make(spark, [(1, "The thing is", "a"), (2, None, "a")])
    rows = {r["doc_id"]: r["groups"] for r in alignment.align(docs, A, B, with_groups=True).collect()}
    assert rows[2] == "" and rows[1].count("|") == rows[1].count(";") + 1


def test_very_long_word_and_clashing_columns(spark):
    docs = make(spark, [(1, "x" * 60_000, "a"), (1, "x" * 60_000, "a")])
    assert set(CLASHES) < set(docs.columns)
    aligned = alignment.op13_align(docs).collect()
    assert len(aligned) == 2 and aligned[0] == aligned[1] and aligned[0]["n_links"] >= aligned[0]["n_a"] > 0
    assert packing.op12_pack(docs).count() >= 2
    items = docs.selectExpr("doc_id item_id", "text")
    assert lexical.op11_search(docs, items).count() == 4
