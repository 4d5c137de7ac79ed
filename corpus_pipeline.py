"""Training-data pipeline: good, distinct, uncontaminated, sanitised, encoded documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; :func:`run` writes each stage's rows to the shared folder and reads them
back, so a lost executor repeats a stage's tasks only.  All stages but the last
return the columns of ``documents``.

Null and empty texts are scored by the classifier like any other (and go, with
a model that has learnt what texts are), have no near duplicates, hold no test
item and no personal data, and have no tokens.  Empty tables pass through;
repeated rows stay or go together; extra columns are carried to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common, decontaminate, near, pii, quality, trie_bpe

TOKENIZER = "word_bpe_49k.json"
#: scores from here on are good
GOOD = 0.7


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts are scored like any other; without labels of both kinds all
    documents get one score, and stay or go together.
    """
    model = quality.train(docs, common.read(spark, sf_dir, "labels"), common.fold("doc_id", 4) != 2)
    return quality.keep_good(docs, model, GOOD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, under it the smallest set.

    Null and blank texts stay, each row.  Rows without an id are compared too; of a
    group without any id one row stays.
    """
    return near.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; null and empty items are in no document; without
    items all documents stay.
    """
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without personal data; ``n_chars`` follows the text, if it is there.

    All rows stay, null texts as they are; columns of any other name pass untouched.
    """
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to.

    Null and empty texts have no tokens; repeated rows are encoded each.
    """
    return trie_bpe.encode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", good),
    ("near_duplicates", distinct),
    ("decontamination", uncontaminated),
    ("personal_data", sanitised),
    ("encoding", encoded),
]

#: none: a learnt classifier, co-occurrence statistics and BPE are beyond SQL;
#: tests hold each stage against a plain version instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
