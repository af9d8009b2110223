import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from plain_texts import brute_components, brute_leaks, shingle_set, words


from swarf.llm import decontaminate, jaccard_join, repeats, token_files
from swarf.llm.common import shared_folder

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(texts):
    from tokenizers import Tokenizer

    return [np.array(e.ids, "<u4") for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_encode_like_whole_texts(edge_rows):
    texts = [t or "" for _, t, _ in edge_rows]
    texts += ["a<|endoftext|>b <|ENDOFTEXT|> C", "It's. don't, x.y,z 1.2, ... !?., É. ÉCOLE x y", "é ́x ß İ ΑΣ ΑΣ.", "tab\tnew\nline\x0b\x0c\r end. 3, 4."]
    for got, want in zip(token_files.encode([t.encode() for t in texts], PATH), whole_ids(texts)):
        assert got == want.tobytes()


def test_token_files_round_trip(spark, edge_docs, edge_rows, no_docs):
    got = token_files.op2_token_files(spark, edge_docs).toPandas()
    ids = [np.append(x, np.uint32(1)).astype("<u4") for x in whole_ids([t for _, t, _ in edge_rows])]
    want = collections.Counter((-1 if r[0] is None else r[0], len(x), zlib.crc32(x.tobytes())) for r, x in zip(edge_rows, ids))
    assert collections.Counter(zip(got["doc_id"].fillna(-1).astype(int), got["n_tokens"], got["ids_crc32"])) == want
    ordered = got.sort_values("start")
    assert (ordered["start"].to_numpy() == np.cumsum(ordered["n_tokens"]) - ordered["n_tokens"]).all()
    known = ordered["doc_id"].dropna().to_list()
    assert known == sorted(known) and ordered["doc_id"].isna().to_list()[:2] == [True, True]
    assert token_files.op2_token_files(spark, no_docs).count() == 0


def test_reader_opens_only_requested_frames(tmp_path):
    import pyarrow.fs

    fs = pyarrow.fs.LocalFileSystem()
    with fs.open_output_stream(str(tmp_path / "x.ids")) as sink:
        out = token_files.FrameWriter(sink)
        for k in range(8):
            out.add(k, np.full(200_000, k, "<u4").tobytes())
        out.close()
    raw = bytearray((tmp_path / "x.ids").read_bytes())
    with fs.open_input_file(str(tmp_path / "x.ids")) as source:
        reader = token_files.FrameReader(source)
        assert len(reader.seeks) > 2
        opened = []
        plain = reader.frame
        reader.frame = lambda k: opened.append(k) or plain(k)
        found = dict(reader.fetch({5}))
        assert list(found) == [5] and (found[5] == 5).all() and len(opened) == 1
        raw[int(reader.begins[1]) + 30] ^= 255
    (tmp_path / "y.ids").write_bytes(raw)
    with fs.open_input_file(str(tmp_path / "y.ids")) as source, pytest.raises(Exception):
        token_files.FrameReader(source).frame(1)


def test_bounded_prefixes_like_brute_force():
    rng = np.random.default_rng(0)
    for least in (3, 8):
        for _ in range(40):
            texts = [rng.integers(97, 97 + rng.integers(1, 5), rng.integers(0, 50)).astype(np.uint8).tobytes() for _ in range(rng.integers(1, 6))]
            texts.append(texts[0][:20] + b"\x00" + texts[0][20:])
            count = collections.Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
            want = [[i for i in range(len(t) - least + 1) if count[t[i : i + least]] > 1] for t in texts]
            assert [x.tolist() for x in repeats.long_prefixes(texts, least)] == want


def brute_repeats(texts, least):
    count = collections.Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                gone[i] += 1
                gone[i + least] -= 1
        mask = np.cumsum(gone)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
        yield len(t), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("least", [60, 400])
def test_repeats(spark, edge_docs, edge_rows, no_docs, least):
    rng = random.Random(least)
    shared = "".join(rng.choice("abcd é") for _ in range(700))
    more = []
    for k in range(12):
        own = "".join(rng.choice("abc ") for _ in range(300))
        at = rng.randint(0, 300)
        more.append((100 + k, own[:at] + shared[rng.randint(0, 80) : 700 - rng.randint(0, 80)] + own[at:], "a"))
    more.append((200, "ab" * 700, "a"))
    from llm_rows import make as make_llm

    docs = make_llm(spark, edge_rows + more)
    texts = [(t or "").encode() for _, t, _ in edge_rows + more]
    from pyspark.sql import functions as F

    got = repeats.remove_repeats(docs, least).select("n_bytes", "n_removed", "n_spans", F.sha2("_kept", 256)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_repeats(texts, least))
    assert repeats.op3_repeats(no_docs).count() == 0


def test_shared_passage_with_own_text_around(spark):
    """One passage in many documents, the text around it different from its first byte on, or only after some bytes."""
    from llm_rows import make as make_llm
    from pyspark.sql import functions as F

    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    around = ["".join(rng.choice("ijkl") for _ in range(k)) for k in (3, 20, 70)]
    rows = []
    for k in range(400):
        own = lambda: "".join(rng.choice("mnop") for _ in range(200))
        rows.append((k, own() + rng.choice(["", *around]) + passage + rng.choice(["", *around]) + own(), "a"))
    rows.append((400, "alone " + rows[0][1][150:700] + "z" * 300, "a"))
    docs, bound = make_llm(spark, rows), 20_000
    named = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_class"))
    largest = lambda most: max((r[0] for r in repeats.candidates(named, 400, most)[1].groupBy("_key").agg(F.sum(F.octet_length("_text")).alias("size")).select("size").collect()), default=0)
    assert largest(1 << 40) > 100_000 and largest(bound) <= bound
    got = repeats.remove_repeats(docs, 400, key_bytes=bound).select("n_bytes", "n_removed", "n_spans", F.sha2("_kept", 256)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_repeats([t.encode() for _, t, _ in rows], 400))


@pytest.mark.parametrize("least", [60, 400])
def test_repeats_in_small_keys(spark, edge_docs, edge_rows, least):
    from pyspark.sql import functions as F

    got = repeats.remove_repeats(edge_docs, least, key_bytes=1).select("n_bytes", "n_removed", "n_spans", F.sha2("_kept", 256)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_repeats([(t or "").encode() for _, t, _ in edge_rows], least))


def test_jaccard_components(spark, edge_docs, edge_rows, no_docs):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    near = []
    for k in range(60):  # near copies with one to five edits: a chain of links, some without any
        w = list(base)
        for _ in range(k % 6):
            w[rng.randrange(200)] = f"x{rng.randrange(9)}"
        near.append((300 + k, " ".join(w), "a"))
    from llm_rows import make as make_llm

    rows = [(i, t) for i, t, _ in edge_rows + near]
    docs = make_llm(spark, edge_rows + near)
    got = jaccard_join.op5_jaccard_join(docs).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_components(rows))
    kept = jaccard_join.first_documents(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == collections.Counter(i for i, _, c in brute_components(rows) if i is None or c == i)
    assert jaccard_join.op5_jaccard_join(no_docs).count() == 0 and jaccard_join.first_documents(no_docs).count() == 0


def test_one_row_of_each_component_stays(spark):
    from llm_rows import make as make_llm

    rng = random.Random(3)
    prose = lambda: " ".join(f"p{rng.randrange(5000)}" for _ in range(100))
    base, nameless, lone, clean, mixed = (prose() for _ in range(5))
    near = lambda t: t.replace(" ", " changed ", 1)
    rows = [(1, base, "a"), (1, base, "a"), (1, base, "b"), (2, near(base), "a"), (None, base, "a"), (2, clean, "a")]
    rows += [(None, nameless, "a"), (None, nameless, "a"), (None, near(nameless), "b"), (3, lone, "a"), (4, mixed, "a"), (4, near(mixed), "a"), (5, "", "a"), (5, None, "a"), (None, " ", "a")]
    got = [(r.doc_id, r.text) for r in jaccard_join.first_documents(make_llm(spark, rows)).collect()]
    assert {(1, base), (2, clean), (3, lone), (5, ""), (5, None), (None, " ")} <= set(got)
    assert sum(t in (nameless, near(nameless)) for _, t in got) == 1 and sum(t in (mixed, near(mixed)) for _, t in got) == 1
    assert len(got) == 8


def test_jaccard_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, jaccard_join.op5_jaccard_join(docs).collect())) == collections.Counter(brute_components(rows))


def test_leaks(spark, edge_rows, no_docs):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"q{rng.randrange(400)}" for _ in range(n))
    items = [(k, prose(12 + 5 * k)) for k in range(6)] + [(6, "just Four words here"), (7, "just Four words here"), (8, None), (9, ""), (10, "rep eat " * 12), (None, prose(30))]
    docs = []
    for k, (_, text) in enumerate(items[:6]):
        w = text.split()
        w[len(w) // 2] = "other"
        docs += [(500 + k, prose(30) + " " + text.upper() + " " + prose(10), "a"), (520 + k, prose(7) + "\n" + " ".join(w), "b"), (540 + k, " ".join(w[: len(w) * 9 // 10]), None), (560 + k, text[: len(text) // 3], "a")]
    docs += [(580, "x just four words here y", "a"), (581, "rep eat " * 40, "a")]
    from llm_rows import make as make_llm

    rows = edge_rows + docs
    frame = make_llm(spark, rows)
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, _key string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.op6_decontaminate(frame, bench).collect()}
    want = brute_leaks([(i, t) for i, t, _ in rows], items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = decontaminate.clean_documents(frame, bench)
    assert kept.columns == frame.columns
    bad = {i for i, _ in want}
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(i for i, _, _ in rows if i not in bad)
    assert decontaminate.op6_decontaminate(no_docs, bench).count() == 0
    assert decontaminate.op6_decontaminate(frame, bench.limit(0)).count() == 0 and decontaminate.clean_documents(frame, bench.limit(0)).count() == len(rows)


def test_leak_search_is_native(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.op6_decontaminate(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_leaks_take_up_few_texts_and_each_item_once(spark, monkeypatch):
    """Items that read alike are looked up once, and only texts with a window of an item are read as words again."""
    rng = random.Random(6)
    prose = lambda n: " ".join(f"q{rng.randrange(3000)}" for _ in range(n))
    texts = [prose(20 + k) for k in range(4)]
    docs = [(k, prose(40) + (" " + texts[k] if k < 4 else ""), "a") for k in range(60)]
    from llm_rows import make as make_llm

    bench = spark.createDataFrame([(k + 100 * r, t.upper() if r % 2 else t) for k, t in enumerate(texts) for r in range(30)], "item_id long, text string")
    worded, kept = [], []
    words, store = decontaminate.with_words, decontaminate.stored
    monkeypatch.setattr(decontaminate, "with_words", lambda frame, *a: worded.append(frame) or words(frame, *a))
    monkeypatch.setattr(decontaminate, "stored", lambda frame: kept.append(store(frame)) or kept[-1])
    got = {(r.doc_id, r.item_id) for r in decontaminate.op6_decontaminate(make_llm(spark, docs), bench).collect()}
    assert got == {(k, k + 100 * r) for k in range(4) for r in range(30)}
    assert [f.count() for f in worded if "_key" in f.columns] == [60, 4]
    assert [f.count() for f in kept if "_bag" in f.columns] == [4]


def test_removing_leaks_does_not_shuffle_texts(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.clean_documents(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark)
