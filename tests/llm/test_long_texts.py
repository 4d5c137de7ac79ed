"""Texts of several blocks, through the operators that look at bytes."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import common, decontaminate, lbl, near, pii, quality, token_counts, trie_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def long_text():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aeioustrnlé") for _ in range(rnd.randint(2, 9))) for _ in range(4000)]
    return " ".join(rnd.choice(words) for _ in range(420_000))


@pytest.fixture(scope="module")
def docs(spark, long_text):
    assert len(long_text.encode()) > 2 * common.BLOCK_BYTES
    changed = long_text.replace(" ", "  ", 50) + " at the end"
    rows = [(1, long_text), (2, changed), (3, "short text of a few words only"), (4, long_text[: 1 << 20] + " mail x@y.example.com " + "w" * 300_000), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def test_near_duplicates(docs, long_text):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.components(docs).collect()}
    w = long_text.lower().split()
    assert got[1] == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}), 1)
    assert [got[i][1] for i in (1, 2, 3, 4, 5)] == [1, 1, 3, 4, 5]


def test_tokens(spark, docs, tmp_path):
    library = Tokenizer.from_file(PATH)
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in trie_bpe.digests(docs, PATH).collect()} == want
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PATH, f"file://{tmp_path}/c").collect()} == want


def test_personal_data(docs, long_text):
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    at = (1 << 20) + len(" mail ")
    assert got[4].base == f"email:{at}:{at + 15}" and got[1].base == "" and got[5].spans == ""


def test_scores(docs):
    model = quality.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    assert docs.count() == len([r for r in quality.score(docs, model).collect() if 0 <= r.score <= 1])
    got = {r.doc_id: r for r in lbl.scores(docs, F.col("doc_id") != 4).collect()}
    assert got[1].n_tokens == 420_001 and got[5].n_tokens == 1
    # the same words in the same order cost the same, wherever windows end
    assert got[2].score < got[1].score < 0 and got[2].score / got[1].score == pytest.approx(1, rel=1e-3)


def test_items_deep_in_a_text(spark, docs, long_text):
    words = long_text.split()
    item = " ".join(words[300_000:300_030])
    items = spark.createDataFrame([(7, item), (8, item), (9, "What is none of all this? Nothing that stands anywhere in these."), (10, ""), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.hits(docs, items).collect()}
    assert got == {(d, i) for d in (1, 2) for i in (7, 8)}  # equal items are found alike
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [3, 4, 5]
