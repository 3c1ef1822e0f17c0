"""Token ids of a byte-level BPE vocabulary, as its ``tokenizers`` file defines them.

Texts go through a second coder built from the same file, several times as fast, wherever the two agree for
certain: the file's merges must be in the order of their ids, and the text must hold no special token's
string and only characters whose regex classes are the same everywhere. All other texts go through the
tokenizer itself.
"""

from __future__ import annotations

import json
import re
from functools import cached_property

import numpy as np
import regex

#: Fixed value: the public pre-token pattern of the byte-level vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Any character outside those whose pre-token classes are the same in every Unicode version since 1.1.
_UNSETTLED = re.compile(r"[^\n\r\t\x20-\x7e\xa1-\xac\xae-ǵ]")

_CODERS: dict[str, Coder] = {}


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Coder:
    def __init__(self, path: str):
        self.path = path
        self.pattern = regex.compile(PRETOKEN)
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        special = [re.escape(t["content"]) for t in content.get("added_tokens") or ()]
        self.special = re.compile("|".join(special)) if special else None
        self.fast = self._fast(content["model"])

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, which is loaded only where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _fast(model: dict):
        """The second coder, or None where the file's merges are not in the order of their ids."""
        import tiktoken

        vocab, alphabet = model["vocab"], _byte_of_char()
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or len(merged) + 256 > len(vocab):
            return None
        known = {i for i in vocab.values() if i < 256} | set(merged)
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if i in known}
        return tiktoken.Encoding("byte-level", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        """Whether the ids of the text are those of its pre-tokens, for certain."""
        return not _UNSETTLED.search(text) and not (self.special and self.special.search(text))

    def pretokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def ids(self, text: str) -> list[int]:
        if self.fast and self.plain(text):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """All ids of the text, as little-endian unsigned 32-bit bytes."""
        return np.array(self.ids(text), dtype="<u4").tobytes()

    def count(self, text: str) -> int:
        return len(self.ids(text))


def coder(path: str) -> Coder:
    """One coder per Python worker and vocabulary file."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file is; a parameter of the operators, read on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)
