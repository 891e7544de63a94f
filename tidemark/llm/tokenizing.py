"""Whole-text tokenization with a word cache, equal to the library's own result.

A tokenizer that drops white space never makes a token across a blank or a line feed, so
a text's ids are those of its chunks between blanks and line feeds, in order; with the
splitter below, those of its words, numbers and runs of signs. Words repeat, so each worker
keeps the ids of those it has met, as little-endian 32-bit bytes. The cache has a fixed size
and starts again when full; it changes speed only.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

#: What the fast path is right for: the normaliser and splitter of the tokenizer file.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Texts of printable ASCII and Latin letters: no combining marks, no odd white space.
_PLAIN = re.compile("[\\n -~¡-ɏ]*")


def _plain_split():
    """``_SPLIT`` for lower-cased plain texts."""
    kinds = {"L": "", "N": ""}
    for c in map(chr, range(0x21, 0x250)):
        if (k := unicodedata.category(c)[0]) in kinds:
            kinds[k] += c
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^\\s{kinds['L']}{kinds['N']}]+").findall


def byte_alphabet() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 onwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for k, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + k)
    return table


class TextEncoder(dict):
    """piece -> its ids as bytes. ``ids(text)`` gives a whole text's."""

    def __init__(self, path: str, limit: int = 600_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self._known(spec)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.split = _plain_split()
        self.chunks = _Chunks(self)
        self.alphabet = byte_alphabet()
        self.tokenize = self.tokenizer.model.tokenize

    @staticmethod
    def _known(spec: dict) -> bool:
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [(x["type"], x.get("pattern", {}).get("Regex"), x.get("content")) for x in norm.get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        return (
            steps == [("NFC", None, None), ("Replace", "\\s+", " "), ("Lowercase", None, None)]
            and len(parts) == 2
            and (parts[0].get("pattern"), parts[0].get("behavior"), parts[0].get("invert")) == ({"Regex": _SPLIT}, "Removed", True)
            and (parts[1].get("type"), parts[1].get("use_regex"), parts[1].get("add_prefix_space")) == ("ByteLevel", False, False)
            and spec["model"]["type"] == "BPE"
            and not spec.get("post_processor")
        )

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        level = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        got = self[piece] = array("I", [t.id for t in self.tokenize(level)]).tobytes()
        return got

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``."""
        if not self.fast:
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and not any(s in chunk for s in self.special):
            return b"".join(map(self.__getitem__, self.split(chunk.lower())))
        return self.whole(chunk)


class _Chunks(dict):
    """The same for chunks between blanks; most are met again, and need no splitting then."""

    def __init__(self, encoder: TextEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.encoder.limit:
            self.clear()
        got = self[chunk] = self.encoder.chunk(chunk)
        return got


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
