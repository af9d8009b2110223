import collections
import math
import zlib

import numpy as np
import public_tokenizers
from llm_rows import make

from swarf.llm import lattice, neighbours, toxicity, url_filter

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.1"


def held(doc_id, part):
    return zlib.crc32(str(doc_id).encode()) % part


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.op7_toxicity(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: held(i, 4) == 2)).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    both = both[both["held_out"]]
    assert both[both["toxic"] == 1]["predicted"].mean() >= 0.8 and both[both["toxic"] == 0]["predicted"].mean() <= 0.1


def test_toxicity_of_odd_rows(spark, edge_docs, edge_rows, no_docs):
    from pyspark.sql import functions as F

    ids = [r[0] for r in edge_rows if r[0] is not None]
    labels = spark.createDataFrame([(i, 0, int(k % 3 == 0), "t") for k, i in enumerate(ids)] + [(None, 0, 1, "t"), (1, None, None, "t")], "doc_id long, quality int, toxic int, text string")
    got = toxicity.op7_toxicity(edge_docs, labels).toPandas()
    assert len(got) == len(edge_rows) and got["score"].notna().all()
    assert (got[got["doc_id"].isin([1, 2, 3])]["score"] == 0).all()
    # labels of held-out rows, and anything but text, have no influence
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.op7_toxicity(edge_docs.withColumn("lang", F.lit("zz")).repartition(3), flipped).toPandas()
    assert sorted(got["score"]) == sorted(again["score"])
    kept = toxicity.clean_documents(edge_docs, labels)
    assert kept.columns == edge_docs.columns and kept.count() == int((got["score"] < 0.3).sum())
    assert toxicity.op7_toxicity(no_docs, labels).count() == 0
    assert set(toxicity.op7_toxicity(edge_docs, labels.limit(0)).toPandas()["predicted"]) == {0}


def test_unseen_spellings_share_grams():
    texts = [b"good words and more plain prose here " + (b"idiotic nonsense" if k % 2 else b"quiet weather") for k in range(40)]
    value, bias = toxicity.train(texts, np.arange(40) % 2)
    scores = toxicity.Bags([b"an idiotix thing", b"a quiet thing", b""]).text_scores(value, bias)
    assert scores[0] > 0.5 > scores[1] and scores[2] == 0


def test_url_rules_and_parts(spark):
    urls = {
        1: ("http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"), 2: ("https://example.org/en/1?x", "example.org", "/en/1", "example.org/en/1", "block"),
        3: ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), 4: ("ftp://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), 5: ("//x.com/fr/", "", "", None, "allow"),
        6: (None, "", "", None, "allow"), 7: ("http://notorg/", "notorg", "/", None, "allow"), 8: ("http://org", "org", "", None, None), 9: ("a://b://c/d", "b:", "//c/d", None, "allow"),
        10: ("http://É.com/de/ü", "É.com", "/de/ü", "com/de/", "block"), 11: ("", "", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u[0], None if i % 2 else "<a href=x>", "z", "z") for i, u in urls.items()], "page_id long, url string, html string, _host string, rule string")
    for row in url_filter.op4_url_filter(pages).collect():
        _, host, path, rule, verdict = urls[row.page_id]
        assert (row.host, row.path, row.rule) == (host, path, rule) and verdict in (row.verdict, None)
    assert url_filter.op4_url_filter(pages.limit(0)).count() == 0
    assert url_filter.judge(pages).count() == len(urls)


def test_trust_like_a_dense_iteration(spark):
    rng = np.random.default_rng(3)
    hosts = [f"h{k}.net" for k in range(12)]
    links = collections.Counter((int(a), int(b)) for a, b in rng.integers(0, 12, (60, 2)) if a != b)
    rows = [(k, f"http://{hosts[a]}/p", " ".join(f'<a href="http://{hosts[b].upper()}/x">' for (s, b), n in links.items() if s == a for _ in range(n)) + '<a href="/own">') for k, a in enumerate(range(12))]
    rows += [(100, "http://h0.net/good/", None), (101, "http://h1.net/bad/", ""), (102, "http://h1.net/bad/2", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = url_filter.judge(pages, [("net/good/", "allow"), ("net/bad/", "block")]).toPandas()
    matrix = np.zeros((12, 12))
    for (a, b), n in links.items():
        matrix[a, b] = n
    for column, seed, m in (("_trust", {0: 1 / 3}, matrix), ("_distrust", {1: 2 / 3}, matrix.T)):
        share = m / np.maximum(m.sum(1, keepdims=True), 1)
        start = np.zeros(12)
        for k, v in seed.items():
            start[k] = v
        mass = start
        for _ in range(400):  # the limit of the iteration
            mass = 0.15 * start + 0.85 * share.T @ mass
        for r in got.itertuples():
            assert abs(got[column][r.Index] - mass[hosts.index(got["_host"][r.Index])]) < 1e-5
    free = got[got["_rule"].isna()]
    assert ((free["_verdict"] == "block") == (free["_distrust"] > (free["_trust"] + free["_distrust"]) * 2 / 3)).all()


def test_distrust_reaches_far_hosts(spark):
    """Twenty hosts link in a row to a blocked one: distrust passes against the links to the first of them."""
    rows = [(k, f"http://h{k}.net/p", f'<a href="//h{k + 1}.net/">') for k in range(20)] + [(20, "http://h20.net/bad", ""), (21, "http://alone.net/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(pages, [("h20.net/bad", "block")]).collect()}
    assert {k for k, r in got.items() if r._verdict == "block"} == set(range(21)) and got[21]._distrust == 0
    assert all(abs(got[20 - k]._distrust - 0.15 * 0.85**k) < 1e-5 for k in range(21))


def brute_neighbours(rows, k=20):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for q, x in good:
        if q % 20 == 0:
            near = sorted((-float(np.float32(v).astype(float) @ np.float32(x).astype(float)), i) for i, v in good if i != q and len(v) == len(x))
            yield q, near[:k]


def recall(got, rows):
    found = collections.defaultdict(set)
    for r in got.itertuples():
        found[r.query_id].add(r.vec_id)
    want = {q: {i for _, i in near} for q, near in brute_neighbours(rows)}
    assert set(found) == {q for q in want if want[q]}
    return np.mean([len(found[q] & want[q]) / len(want[q]) for q in want if want[q]])


def test_neighbours_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect()]
    got = neighbours.op9_neighbours(vectors).toPandas()
    assert recall(got, rows) >= 0.9
    assert (got.groupby("query_id")["rank"].apply(lambda x: sorted(x) == list(range(1, len(x) + 1)))).all()
    by_id = dict(rows)
    exact = [float(np.array(by_id[q], float) @ np.array(by_id[v], float)) for q, v in zip(got["query_id"], got["vec_id"])]
    assert np.allclose(got["score"], exact, atol=1e-12)


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0] * 8) for i in range(80)] + [(200, [0.0] * 8), (201, None), (202, [1.0, None] * 4), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (None, [1.0] * 8), (205, []), (220, [3.0, 4.0]), (221, [1.0, 1.0]), (240, [9.0] * 8)]
    vectors = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, _shard int")
    got = neighbours.op9_neighbours(vectors).toPandas()
    assert recall(got, rows) >= 0.99  # small: every row is found, ties to the smaller id
    assert got[got["query_id"] == 220]["vec_id"].to_list() == [221]
    assert neighbours.op9_neighbours(vectors.limit(0)).count() == 0


def brute_word(word, log_p, table):
    raw = word
    best = [0.0] + [-math.inf] * len(raw)
    for end in range(1, len(raw) + 1):
        terms = [best[a] + log_p[table[raw[a:end], end == len(raw)]] for a in range(end) if (raw[a:end], end == len(raw)) in table]
        best[end] = np.logaddexp.reduce(terms) if terms else -math.inf
    return best[-1]


def test_lattice_like_a_plain_recursion():
    import json

    pieces = lattice.load_pieces(PATH)
    letters = lattice._byte_of_letter()
    vocabulary = json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]
    table = {}
    for k, (p, _) in enumerate(sorted(vocabulary.items(), key=lambda x: x[1])):
        final = p.endswith("</w>")
        table[bytes(letters[c] for c in (p[:-4] if final else p)), final] = k
    log_p = -np.log(np.arange(pieces.size) + 3.0)
    words = [b"a", b"the", b"unbelievable", "naïve".encode(), b"zzqx", bytes([255, 0, 7]), b"x" * 70, b"the"]
    assert np.allclose(lattice.word_scores(pieces, words, log_p), [brute_word(w, log_p, table) for w in words])
    # expected uses of pieces spell each word exactly once
    uses = lattice.expected_counts(pieces, [b"unbelievable"], np.array([2.0]), log_p)
    length = np.zeros(pieces.size)
    for (raw, _), k in table.items():
        length[k] = len(raw)
    assert abs((uses * length).sum() - 2 * len(b"unbelievable")) < 1e-9


def test_scores(spark, edge_docs, edge_rows, no_docs):
    got = lattice.op10_lm_score(edge_docs).toPandas()
    tokens = lambda t: (t or "").encode().lower().split()
    count, texts = collections.Counter(), 0
    for i, t, _ in edge_rows:
        if i is None or held(i, 10):
            count.update(tokens(t))
            texts += 1
    total, distinct = sum(count.values()) + texts, len(count) + 1
    base = lambda c: math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    want = collections.Counter((-1 if i is None else i, i is not None and held(i, 10) == 0, len(tokens(t)) + 1, sum(count[w] > 0 for w in tokens(t)) + 1, total, round(sum(base(count[w]) for w in tokens(t)) + base(texts), 5)) for i, t, _ in edge_rows)
    have = collections.Counter((-1 if r.doc_id != r.doc_id or r.doc_id is None else int(r.doc_id), bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got.astype({"doc_id": "float"}).itertuples())
    assert have == want
    assert (got["score"] < 0).all() and np.isfinite(got["score"]).all()
    assert lattice.op10_lm_score(no_docs).count() == 0
    assert len(lattice.op10_lm_score(make(spark, [(1, None, "a"), (2, "a b", "a")])).collect()) == 2


def test_probabilities_of_words_sum_to_at_most_one():
    pieces = lattice.load_pieces(PATH)
    log_p = np.full(pieces.size, -math.log(pieces.size))
    words = [bytes([a]) for a in range(97, 123)] + [bytes([a, b]) for a in range(97, 123) for b in range(97, 123)]
    assert np.exp(lattice.word_scores(pieces, words, log_p)).sum() < 1
