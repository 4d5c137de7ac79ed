"""Pre-tokenising for word-level BPE files: what the merges are applied to.

A text is cut at ASCII white space; no word-level BPE token crosses it.  Each
distinct chunk is normalised and split once.  Plain ASCII chunks take a regular
expression with the same alternatives as the file's, as do chunks of ASCII and
the letters of Latin-1; all others go through the library's own normaliser and
pre-tokeniser, so Unicode rules are the library's.
"""

from __future__ import annotations

import json
import os
import re

from tidewell.llm import common

#: fixed values: the split of the vocabulary file, and what it means for ASCII in lower case
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: the same with the letters of Latin-1, which lower-case one to one and are composed already
LATIN = re.compile(r"[\x20-\x7eÀ-ÖØ-öø-ÿ]+")
LATIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level letters: printable bytes stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(others)}


_LETTERS = _byte_letters()


def _read(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def load(path: str):
    """The library's tokenizer for a file, once a stage and worker, on one thread."""
    return common.hold(f"tokenizer {path}", lambda: _read(path))


class WordSplit:
    """Splits chunks of a ``tokenizers`` file whose words end in ``</w>``.

    ``ValueError`` if the file is of another make.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        added = spec.get("added_tokens", [])
        if (
            norm != ["NFC", "Replace", "Lowercase"]
            or pre[0].get("pattern") != {"Regex": SPLIT}
            or not pre[0].get("invert")
            or pre[1].get("type") != "ByteLevel"
            or pre[1].get("add_prefix_space")
            or spec["model"]["type"] != "BPE"
            or spec["model"].get("end_of_word_suffix") != "</w>"
            or any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] or re.search(r"\s", x["content"]) for x in added)
        ):
            raise ValueError(f"{path} isn't a word-level BPE file of the known make")
        self.model = spec["model"]
        self.special = {x["content"]: x["id"] for x in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None

    def pieces(self, chunk: str) -> list[str | int]:
        """Pieces in byte-level letters; a special token in the text is its id."""
        if self._special is not None and "<|" in chunk and self._special.search(chunk):
            out: list[str | int] = []
            for x in self._special.split(chunk):
                out += [self.special[x]] if x in self.special else self.pieces_of(x) if x else []
            return out
        return self.pieces_of(chunk)

    def pieces_of(self, chunk: str) -> list[str]:
        if chunk.isascii() and chunk.isprintable():
            return [chunk.lower()] if chunk.isalpha() else ASCII_SPLIT.findall(chunk.lower())
        if LATIN.fullmatch(chunk):
            if chunk.isalpha():
                return [chunk.lower().encode().decode("latin-1").translate(_LETTERS)]
            return [p if p.isascii() else p.encode().decode("latin-1").translate(_LETTERS) for p in LATIN_SPLIT.findall(chunk.lower())]
        t = self.tokenizer
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(chunk))]
