"""Tokenizer operators against the libraries themselves."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import common, token_counts, trie_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "aAbBeE'sSdDtTrReElLvVmM0129 \t\n\x0b\x1c\x1f\x85  éÉçß́İΣσςǅ①½٣中文ñÑ÷×ªµ—…😀‍<|>.,!?_-\x00\x7f"


def texts():
    rnd = random.Random(1)
    out = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    out += ["".join(rnd.choice("aeiousthrnlmbcdp") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    out += ["".join(rnd.choice("!*$%&#.aA") for _ in range(rnd.randint(1, 200))) for _ in range(300)]
    out += ["a" * k for k in range(200)] + ["an" * k for k in range(100)] + ["é" * k for k in range(40)]
    return out + ["", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> I'LL don't'", "word " * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_trie_encodes_and_decodes_like_the_library(library):
    t = texts()
    for text, (ids, decoded), want in zip(t, trie_bpe.load(PATH).encode_batch([x.encode() for x in t]), library.encode_batch(t, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert decoded.decode() == library.decode(want.ids, skip_special_tokens=False)
        assert trie_bpe.load(PATH).decode(want.ids) == decoded.decode()


def test_counts_equal_the_library(library):
    t = texts()
    assert token_counts.count_texts(PATH, [x.encode() for x in t]) == [len(e.ids) for e in library.encode_batch(t, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_other_makes_count_whole_texts(name):
    path = public_tokenizers.path(name)
    t = ["Hello  world\n", "", "naïve café", "a" * 100]
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(t)]
    else:
        want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(t, add_special_tokens=False)]
    assert token_counts.count_texts(path, [x.encode() for x in t]) == want


def rows():
    t = [*texts()[:300], None, "", "same  text", "same\ntext", "same  text"]
    return [(i, x, -1) for i, x in enumerate(t)] + [(3, "repeated id", -1), (None, "no id", -1)]


def test_digests(spark, library):
    df = spark.createDataFrame(rows(), "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in trie_bpe.digests(df, PATH).collect()}
    want = set()
    for i, x, _ in rows():
        ids = library.encode(x or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), len(ids)))
    assert got == want
    full = trie_bpe.encode(df, PATH)
    assert {(r.doc_id, r.ids_sha256) for r in full.collect()} == {x[:2] for x in want}
    assert all(len(r.ids) == r.n_tokens for r in full.collect())


def test_the_cache_is_used_and_grows(spark, library, tmp_path):
    df = spark.createDataFrame(rows(), "doc_id long, text string, content_digest int")
    cache = f"file://{tmp_path}/cache"
    count = lambda d: sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(d, PATH, cache).collect())
    want = sorted((-1 if i is None else i, len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in rows())
    assert count(df) == want
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == stored.select("content_digest").distinct().count() and n < len(rows())
    assert count(df) == want and spark.read.parquet(cache).count() == n
    count(spark.createDataFrame([(900, "something new", 0)], df.schema))
    assert spark.read.parquet(cache).count() == n + 1
    # what is stored is believed: a hit isn't encoded again
    fake = token_counts.with_digests(spark.createDataFrame([(1, "planted")], "doc_id long, text string"))
    fake.select("content_digest", F.lit(token_counts.tokenizer_digest(PATH)).alias("tokenizer_digest"), F.lit(77).cast("long").alias("n_tokens")).write.mode("append").parquet(cache)
    assert count(spark.createDataFrame([(1, "planted", 0)], df.schema)) == [(1, 7, 77)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_white_space_counts_where_the_tokenizer_keeps_it(spark, tmp_path, name):
    path = public_tokenizers.path(name)
    texts = ["a  b\n\nc    d", "a b c d", " a b c d", "a b c d", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = token_counts.count_texts(path, [(t or "").encode() for t in texts])
    assert want[0] > want[1]
    for _ in range(2):  # counted, then from the cache
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, path, f"file://{tmp_path}/c").collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_one_digest_of_most_rows(spark, library, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same old text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = token_counts.token_counts(df, PATH, f"file://{tmp_path}/c").collect()
    assert len(got) == 3000 and {r.n_tokens for r in got if r.doc_id % 3} == {len(library.encode("same old text", add_special_tokens=False).ids)}


def test_the_query_counts_like_the_library(spark, library):
    from tidewell.llm import registry

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id] = (len((r.text or "").encode()), n, n > 2048)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in registry.op5_token_counts(spark, sf).collect()} == want


def test_words_longer_than_a_slice(monkeypatch):
    import pyarrow as pa

    t = ["ab " + "xyz" * 50 + " c", "q" * 100, "ab c"]
    b = pa.RecordBatch.from_pydict({"text": t})
    want = common.find_words(next(common.blocks(iter([b])))).hash.tolist()
    monkeypatch.setattr(common, "SLICE", 16)
    monkeypatch.setattr(common, "_pow", {})
    assert common.find_words(next(common.blocks(iter([b])))).hash.tolist() == want


def test_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert trie_bpe.digests(df, PATH).count() == 0
    assert token_counts.token_counts(df, PATH, f"file://{tmp_path}/c").count() == 0


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    t = ["Hello  wOrld\n a", None, "", "x", " y z\x0b", "a b \x1cq"]
    b = pa.RecordBatch.from_pydict({"doc_id": list(range(len(t))), "text": t})
    for size in (1, 5, 1000):
        got = []
        for k in common.blocks(iter([b]), size=size):
            w = common.find_words(k)
            got += [(k.batch.column("doc_id")[int(d)].as_py(), bytes(k.data[s:e]).lower(), int(h)) for d, s, e, h in zip(w.doc, w.start, w.end, w.hash, strict=True)]
        assert [(d, x) for d, x, _ in got] == [(i, x.lower()) for i, s in enumerate(t) for x in (s or "").encode().split()]
        assert all(common.hash_word(x) == h for _, x, h in got)


def test_workers_let_the_encoder_go_when_another_stage_begins(spark):
    import pyarrow as pa

    def probe(batches):
        import gc

        def held():
            return sum(isinstance(x, trie_bpe.TrieBpe) for x in gc.get_objects())

        before = held()
        rows = sum(len(b) for b in common.blocks(batches))
        yield pa.RecordBatch.from_pydict({"before": [before], "after": [held()], "n": [rows]})

    docs = spark.createDataFrame([(i, f"word {i}") for i in range(64)], "doc_id long, text string").repartition(32)
    assert trie_bpe.digests(docs, PATH).count() == 64
    got = docs.mapInArrow(probe, "before long, after long, n long").collect()
    assert sum(r.n for r in got) == 64
    assert any(r.before for r in got)  # workers are used again
    assert not any(r.after for r in got)


def test_what_a_stage_holds_is_made_once(monkeypatch):
    monkeypatch.setattr(common, "_held", {})
    made = []
    for stage, want in ((7, 1), (7, 1), (8, 1)):
        monkeypatch.setattr(common, "_stage", lambda s=stage: s)
        common.hold("x", lambda: made.append(1) or made)
        common.let_go()
        assert len(made) == want and "x" in common._held
    monkeypatch.setattr(common, "_stage", lambda: 9)
    common.let_go()
    assert not common._held
