"""Token ids of texts with the public ``tokenizers`` library, a word at a time.

The tokenizer ``word_bpe_49k.json`` never joins text across white space, so the ids of
a text are those of its words in turn. Words repeat; their ids are kept in a bounded
table per Python worker, and a text is encoded by joining its words' ids. Words with
plain letters go straight to the library's BPE model; any others, with marks that may
compose or with special tokens, go through the library's whole chain. A tokenizer file with
other settings than those assumed here encodes each text as a whole.
"""

from __future__ import annotations

import functools
import json
from array import array

import public_tokenizers
import regex
from tokenizers import Tokenizer

#: Words whose ids a worker keeps at most, beyond which the table starts again, and letters of such a word.
KEPT_WORDS, KEPT_LETTERS = 200_000, 64
#: Letters of a text that are split into words at a time.
_PART = 1 << 20
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: A character that normalisation may change or join with another.
_COMPOSING = regex.compile(r"[^\u0000-\u02FF]").search
#: Marks that are a part of their own after a word's letters.
_ENDS = frozenset(".,;:!?")


# The settings of a tokenizer whose texts may be encoded a word at a time, with the splitting above.
_NORMALIZERS, _SPLITTERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]


def by_words(settings: dict) -> bool:
    """Whether a tokenizer file lower-cases, drops white space and splits by ``_PARTS`` into bytes, as is assumed here."""
    normalizers = (settings.get("normalizer") or {}).get("normalizers", [])
    splitters = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [x["type"] for x in normalizers] == _NORMALIZERS and normalizers[1].get("pattern") == {"Regex": r"\s+"} and normalizers[1].get("content") == " "
        and [x["type"] for x in splitters] == _SPLITTERS and splitters[0].get("pattern") == {"Regex": _PARTS.pattern} and splitters[0].get("behavior") == "Removed"
        and splitters[0].get("invert") is True and not splitters[1].get("add_prefix_space") and not splitters[1].get("use_regex")
        and settings["model"].get("type") == "BPE" and not settings.get("post_processor")
    )


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes, computed when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = by_words(json.loads(self.tokenizer.to_str()))
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if (word.isascii() or not _COMPOSING(word)) and "<|" not in word:
            get, low = self.parts.get, word.lower()
            if low.isalpha():
                ids = get(low) or self._part(low)
            elif low[-1:] in _ENDS and low[:-1].isalpha():
                ids = (get(low[:-1]) or self._part(low[:-1])) + (get(low[-1]) or self._part(low[-1]))
            else:
                ids = b"".join([get(part) or self._part(part) for part in _PARTS.findall(low)])
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= KEPT_LETTERS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        # visible ASCII letters stand for themselves
        spelled = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [x.id for x in self.model.tokenize(spelled)]).tobytes()
        if len(part) <= KEPT_LETTERS:
            if len(self.parts) >= KEPT_WORDS:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; none for a null."""
        if not text:
            return b""
        if not self.by_words:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        text, found, at = text.replace("\n", " "), [], 0
        while at < len(text):
            end = text.find(" ", at + _PART)
            end = len(text) if end < 0 else end
            found.append(b"".join(map(self.__getitem__, text[at:end].split(" "))))
            at = end
        return b"".join(found)


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)
