"""Token ids by the tokenizers library, with a cache of its result for each pre-token.

A BPE tokenizer splits a text into pre-tokens by a pattern and encodes each alone, so the ids of a text are those of
its pre-tokens in turn. Texts outside the characters below, or that hold an added token, are encoded whole instead.
"""

from __future__ import annotations

import json
import re
from array import array

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile(f"[^\t\n\r -~{_LETTER}]")
_SUFFIX = "'(?:s|t|re|ve|m|ll|d)"
_BYTE_LEVEL = re.compile(rf"{_SUFFIX}| ?[{_LETTER}]+| ?[0-9]+| ?[^\t\n\r {_LETTER}0-9]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
_WORD_LEVEL = re.compile(rf"{_SUFFIX}|[{_LETTER}]+|[0-9]|[^\t\n\r {_LETTER}0-9]+")
#: Entries that a worker keeps at most; at the bound the cache starts anew.
CACHE = 500_000
_LOADED: dict[str, "Encoder"] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class _Cache(dict):
    def __init__(self, one):
        super().__init__()
        self.one = one

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[piece] = self.one(piece)
        return ids


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes the UTF-8 bytes of each character that the fast path takes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in [9, 10, 13, *range(32, 127), *range(0xC0, 0x100)]}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.pattern, self.lower = None, False
        if spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"):
            if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
                self.pattern = _BYTE_LEVEL
            elif pre.get("type") == "Sequence" and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and r"[\p{N}]|" in str(pre["pretokenizers"][0].get("pattern", {}).get("Regex")):
                self.pattern, self.lower = _WORD_LEVEL, True
        model, letters = self.tokenizer.model, _byte_letters()
        self.pieces = _Cache(lambda piece: array("I", [t.id for t in model.tokenize(piece.translate(letters))]).tobytes())
        self.chunks = _Cache(self._split)

    def _split(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def encode(self, text: str | None) -> bytes:
        """Ids as native unsigned 32-bit integers."""
        text = text or ""
        if self.pattern is None or _OTHER.search(text) or any(x in text for x in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.lower:  # white space only separates
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        return self._split(text)
