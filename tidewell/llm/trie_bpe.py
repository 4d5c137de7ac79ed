"""Byte-pair encoding by prefix-sharing trie traversal, and decoding.

The distinct pieces of a batch are put in order, which is the depth-first order
of their trie.  A node's state is the last token of the encoding of its prefix;
it follows from the states on the path above, so the prefix that a piece shares
with the one before is never encoded again.

The state of a prefix is the one vocabulary token ``t`` that ends it, encodes
to itself, and *fits* behind the state of what stands before ``t``.  Two tokens
fit if encoding their concatenation gives back the two: no merge ever joins a
symbol on the right edge of the first to one on the left edge of the second
while both are still there.  A sequence whose neighbours all fit is the
encoding of its text, and there is exactly one.

Nulls are empty texts: no tokens, and an empty decoded text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm import common
from tidewell.llm.word_split import WordSplit

END = "</w>"
#: letters of the byte-level alphabet lie below; a word's last letter is moved above
_FINAL = 0x1000
#: chunks, and pieces, that each half of a worker's memory holds; an entry takes some
#: 330 bytes, 600 at most
MEMO = 120_000
#: pairs of tokens that a worker remembers, of some 100 bytes each
MEMO_PAIRS = 600_000
#: longer chunks and pieces are forgotten after use
MEMO_LENGTH = 32
_FOREVER = 1 << 60
_SAME = np.arange(256, dtype=np.uint8)
#: texts that are encoded together
BLOCK_BYTES = 1 << 20


class Memory:
    """A dictionary of bounded size: what was not asked for lately is forgotten.

    When the young half is full, it becomes the old one, and what that held is gone
    unless it was asked for since.
    """

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}
        self.long: list = []  # keys that are forgotten next time

    def lacks(self, keys: set) -> set:
        """The keys that aren't known; the others are in the young half now."""
        for k in self.long:
            self.young.pop(k, None)
        self.long = []
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        fresh = keys - self.young.keys()
        again = self.old.keys() & fresh
        self.young.update({k: self.old[k] for k in again})
        return fresh - again


def _gathered(pieces: list[bytes], of: np.ndarray, first: np.ndarray, kind: str | type) -> tuple[np.ndarray, np.ndarray]:
    """Pieces end to end in the order ``of`` their uses, and where each document begins."""
    flat = np.frombuffer(b"".join(pieces), kind)
    size = np.array([len(x) for x in pieces], np.int64) // flat.itemsize
    begin = np.cumsum(size) - size
    sizes = size[of]
    edge = np.r_[0, np.cumsum(sizes)]
    at = np.repeat(begin[of] - edge[:-1], sizes)
    at += np.arange(len(at))
    return flat[at], edge[first]


@dataclass
class Encoded:
    """Ids, and the text decoded from them, of the documents of a block."""

    ids: np.ndarray
    id_edges: np.ndarray
    text: np.ndarray
    text_edges: np.ndarray

    def ids_of(self, i: int) -> np.ndarray:
        return self.ids[self.id_edges[i] : self.id_edges[i + 1]]

    def text_of(self, i: int) -> np.ndarray:
        """In UTF-8; every token has a blank before it, the first one's is dropped."""
        a, z = self.text_edges[i], self.text_edges[i + 1]
        return self.text[min(a + 1, z) : z]

    def marks(self) -> list[pa.Array]:
        """SHA-256 of the ids and of the text of each document."""
        n = range(len(self.id_edges) - 1)
        return [pa.array([hashlib.sha256(part(i)).hexdigest() for i in n], pa.string()) for part in (self.ids_of, self.text_of)]


class TrieBpe:
    """Encoder and decoder of one word-level BPE file.

    Tokens are numbers.  ``made`` has the rank of the merge that makes a token,
    ``first`` and ``last`` its two parts (-1 for letters), ``rank`` the rank of a
    pair of tokens, the two numbers packed into one.
    """

    def __init__(self, path: str):
        self.split = WordSplit(path)
        spec, self.split.model = self.split.model, {}
        self.text_of = {i: t for t, i in spec["vocab"].items()} | {i: t for t, i in self.split.special.items()}
        self.utf8_of = {i: b" " + t.encode() for i, t in self.text_of.items()}
        self.id_of = {self._letters(t): i for t, i in spec["vocab"].items()}
        n = max(self.id_of.values()) + 1
        self.made, self.first, self.last, self.length = [_FOREVER] * n, [-1] * n, [-1] * n, [0] * n
        #: length of the longest token with these last four letters
        self.longest: dict[str, int] = {}
        for t, i in self.id_of.items():
            self.length[i] = len(t)
            if len(t) > 3:
                self.longest[t[-4:]] = max(len(t), self.longest.get(t[-4:], 0))
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        for r, m in enumerate(spec["merges"]):
            a, b = (self._letters(x) for x in (m if isinstance(m, list) else m.split(" ")))
            x, y, z = self.id_of[a], self.id_of[b], self.id_of[a + b]
            if self.first[z] >= 0 or any(self.first[k] < 0 and self.length[k] > 1 for k in (x, y)):
                raise ValueError("merges aren't in the order in which tokens come to be")
            self.rank[x << 24 | y] = r
            self.result.append(z)
            self.made[z], self.first[z], self.last[z] = r, x, y
        self._itself: dict[int, bool] = {}
        self._fits: dict[int, bool] = {}
        self.special = {i: (i.to_bytes(4, "little"), self.utf8_of[i]) for i in self.split.special.values()}
        self.pieces, self.chunks = Memory(), Memory()

    @staticmethod
    def _letters(token: str) -> str:
        """A token with its end-of-word mark moved into the last letter."""
        if token.endswith(END) and len(token) > len(END):
            token = token[: -len(END)]
            return token[:-1] + chr(ord(token[-1]) + _FINAL)
        return token

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge joins a symbol on the right edge of ``a`` to one on the
        left edge of ``b`` while both are there."""
        made, rank = self.made, self.rank
        x, x_ends = a, _FOREVER
        while x >= 0:
            y, y_ends = b, _FOREVER
            while y >= 0:
                r = rank.get(x << 24 | y)
                # at equal ranks the leftmost pair goes first
                if r is not None and r < x_ends and r <= y_ends:
                    return False
                y_ends, y = made[y], self.first[y]
            x_ends, x = made[x], self.last[x]
        return True

    def _encodes_to_itself(self, token: int, text: str) -> bool:
        known = self._itself.get(token)
        if known is None:
            parts = [self.id_of[c] for c in text]
            while len(parts) > 1:
                ranks = [self.rank.get(x << 24 | y, _FOREVER) for x, y in zip(parts, parts[1:], strict=False)]
                best = min(ranks)
                if best == _FOREVER:
                    break
                at = ranks.index(best)
                parts[at : at + 2] = [self.result[best]]
            known = self._itself[token] = parts == [token]
        return known

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each piece."""
        out: dict[str, list[int]] = {}
        state: list[int] = [-1]  # of the path from the root to the node at hand
        path = ""
        id_of, longest, length, fits_known = self.id_of.get, self.longest.get, self.length, self._fits
        for word, piece in sorted((p[:-1] + chr(ord(p[-1]) + _FINAL), p) for p in pieces):
            shared = 0
            for x, y in zip(path, word, strict=False):
                if x != y:
                    break
                shared += 1
            del state[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                reach = longest(word[end - 4 : end], 3) if end > 3 else end
                for begin in range(end - reach if end > reach else 0, end):
                    token = id_of(word[begin:end])
                    if token is not None:
                        if begin:
                            pair = state[begin] << 24 | token
                            ok = fits_known.get(pair)
                            if ok is None:
                                ok = fits_known[pair] = self.fits(state[begin], token)
                            if ok and self._encodes_to_itself(token, word[begin:end]):
                                break
                        elif self._encodes_to_itself(token, word[:end]):
                            break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                state.append(token)
            if len(fits_known) > MEMO_PAIRS:
                fits_known.clear()
            path = word
            ids, at = [], len(word)
            while at:
                ids.append(state[at])
                at -= length[state[at]]
            ids.reverse()
            out[piece] = ids
        return out

    def learn(self, chunks: set[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Ids and decoded text of these chunks, at least; those that aren't known yet
        are encoded over one trie of their pieces."""
        fresh = self.chunks.lacks(chunks)
        plain = [(c, c.lower().decode()) for c in fresh if c.isalpha()]  # one piece, of ASCII letters
        split = [(c, self.split.pieces(c.decode())) for c in fresh if not c.isalpha()]
        new = self.pieces.lacks({p for _, ps in split for p in ps}.union([p for _, p in plain]) - self.special.keys())
        of, out = self.pieces.young, self.chunks.young
        for p, ids in self.encode_pieces(new).items():
            of[p] = (struct.pack(f"<{len(ids)}I", *ids), self._decode_spaced(ids))
        of.update(self.special)
        for c, p in plain:
            out[c] = of[p]
        for c, ps in split:
            if len(ps) == 1:
                out[c] = of[ps[0]]
            else:
                both = [of[p] for p in ps]
                out[c] = (b"".join([x for x, _ in both]), b"".join([x for _, x in both]))
        self.pieces.long = [p for p in new if len(p) > MEMO_LENGTH]
        self.chunks.long = [c for c in fresh if len(c) > MEMO_LENGTH]
        return out

    def _decode_spaced(self, ids: list[int]) -> bytes:
        """Text of ids in UTF-8, a blank before each token."""
        text = self.utf8_of
        return b"".join([text[i] for i in ids])

    def encode_block(self, b: common.Block) -> Encoded:
        """All documents of a block.  Distinct chunks are encoded once, by their 64-bit
        hashes; the rest is gathering in numpy."""
        w = common.find_words(b, _SAME)
        order = np.argsort(w.hash)
        same = w.hash[order]
        new = np.r_[True, same[1:] != same[:-1]] if len(same) else np.zeros(0, bool)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        raw = b.data.tobytes()
        chunks = [raw[x:y] for x, y in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
        known = self.learn(set(chunks))
        both = [known[c] for c in chunks]
        return Encoded(*_gathered([x for x, _ in both], of, w.first, "<u4"), *_gathered([x for _, x in both], of, w.first, np.uint8))

    def encode_batch(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids and, decoded from them, its text in UTF-8."""
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string())], names=["text"])
        for b in common.blocks(iter([batch]), size=BLOCK_BYTES):
            got = self.encode_block(b)
            for i in range(len(b)):
                yield got.ids_of(i).tobytes(), got.text_of(i).tobytes()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of ids: the tokens' strings with blanks between, as the file asks."""
        return " ".join([self.text_of[int(i)] for i in ids])


def load(path: str) -> TrieBpe:
    """The file's encoder, with its memories, as long as this worker encodes."""
    return common.hold(f"bpe {path}", lambda: TrieBpe(path))


def encode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (array<int>), SHA-256 of the ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for b in common.steady(common.blocks(batches, text, BLOCK_BYTES)):
            got = bpe.encode_block(b)
            ids = pa.ListArray.from_arrays(pa.array(got.id_edges.astype(np.int32)), pa.array(got.ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.batch.column(key), pa.array(np.diff(got.id_edges)), ids, *got.marks()], names=[key, "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def digests(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, and SHA-256 of the ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for b in common.steady(common.blocks(batches, text, BLOCK_BYTES)):
            got = bpe.encode_block(b)
            yield pa.RecordBatch.from_arrays([b.batch.column(key), pa.array(np.diff(got.id_edges)), *got.marks()], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
