"""Token counts with a digest cache.

A text's count is stored under two digests: that of its normalised content and
that of the tokenizer file with the library's version.  A run joins all texts
to the stored counts, encodes one text for each digest that is missing,
appends those counts, and joins them back.  Normalising depends on the tokenizer:
where it drops white space, runs of it are folded to one blank, which changes no
count; for all other tokenizers contents are digested as they are.  The digest
of the tokenizer says which of the two it was.

Nulls count as empty texts (0 tokens), empty tables give empty results, and
repeated rows are encoded once.  Columns beyond ``key`` and ``text`` are not
read, so clashing names don't matter.

Scale: what is shuffled is a digest and an id per row (salted, so a third of all
rows may be copies) and the texts that the cache misses, once, by their unique
ids.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm.word_split import WordSplit, load

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: chunks and pieces that a worker remembers; beyond it the memory is emptied
MEMO = 300_000
#: longer chunks are counted each time they occur
MEMO_BYTES = 64

_counters: dict[str, ChunkCounter | None] = {}


#: runs of ASCII white space
FOLD = r"[ \t\n\x0B\f\r]+"


def normaliser(path: str) -> str | None:
    """What is folded to a blank before contents are digested: white space, if the
    tokenizer drops it, else nothing."""
    return FOLD if counter(path) is not None else None


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file, the version of the library that reads it, and how contents are normalised."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return f"{library}-{importlib.metadata.version(library)}-{'folded' if normaliser(path) else 'as-is'}-{hashlib.sha256(f.read()).hexdigest()}"


class ChunkCounter(dict):
    """Tokens of a chunk without white space, by the library's BPE model.

    A dictionary that fills itself: distinct chunks, and within them distinct
    pieces, are encoded once.
    """

    def __init__(self, path: str):
        self.split = WordSplit(path)
        self.model = self.split.tokenizer.model
        self.piece: dict[str, int] = {}

    def __missing__(self, chunk: bytes) -> int:
        n, memo = 0, self.piece
        for p in self.split.pieces(chunk.decode()):
            if p.__class__ is int:
                n += 1
            elif p in memo:
                n += memo[p]
            else:
                k = len(self.model.tokenize(p))
                n += k
                if len(p) <= MEMO_BYTES:
                    memo[p] = k
        if len(chunk) <= MEMO_BYTES:
            self[chunk] = n
        return n

    def trim(self) -> None:
        if len(self) > MEMO:
            self.clear()
        if len(self.piece) > MEMO:
            self.piece.clear()


def counter(path: str) -> ChunkCounter | None:
    """The process's counter for a word-level BPE file, None for other makes."""
    if path not in _counters:
        try:
            _counters[path] = None if path.endswith(".model") else ChunkCounter(path)
        except ValueError:
            _counters[path] = None
    return _counters[path]


def count_texts(path: str, batch: list[bytes]) -> list[int]:
    """Tokens of each text, as the library counts them.

    Word-level BPE files drop white space, so a text has the tokens of its
    chunks; other makes encode whole texts.
    """
    chunks = counter(path)
    if chunks is not None:
        out = []
        for b in batch:
            out.append(sum(map(chunks.__getitem__, b.split())))
            chunks.trim()
        return out
    t = load(path)
    if path.endswith(".model"):
        return [len(x) for x in t.encode([b.decode() for b in batch], num_threads=1)]
    return [len(x.ids) for x in t.encode_batch([b.decode() for b in batch], add_special_tokens=False)]


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steady(batches):
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array(count_texts(path, common.texts(batch)), pa.int64())], names=["content_digest", "n_tokens"])

    return run


def with_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", normalise: str | None = None) -> DataFrame:
    """key, text (null as empty) and the digest of the normalised content."""
    body = F.coalesce(F.col(text), F.lit(""))
    norm = F.regexp_replace(body, normalise, " ") if normalise else body
    return docs.select(F.col(key).alias("doc_id"), body.alias("text"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("content_digest"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; ``cache_path`` holds the counts.

    The cache is a Parquet table that grows by one append for each run that
    found misses.  Only its rows of this tokenizer's digest are read.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    have = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    full = with_digests(docs, key, text, normaliser(tokenizer_path))
    keys = common.staged(full.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest"), "digests")
    # one row for each digest that the cache lacks: the smallest id stands for it
    lacking = keys.groupBy("content_digest").agg(F.min("doc_id").alias("doc_id")).join(have, "content_digest", "left_anti")
    stand = lacking.select(F.col("doc_id").alias("_id"), F.col("content_digest").alias("_want")).hint("shuffle_hash")
    missed = full.join(stand, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content_digest") == F.col("_want"))).select("content_digest", "text")
    fresh = missed.mapInArrow(_count_batches(tokenizer_path), "content_digest binary, n_tokens long")
    fresh.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")).select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache_path)
    now = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return common.join_salted(keys, now, ["content_digest"], ["doc_id"]).select("doc_id", "n_bytes", "n_tokens")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where nothing was stored yet."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)
