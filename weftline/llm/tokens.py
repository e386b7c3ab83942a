"""Byte-pair token ids by pre-token: split a text once, look every pre-token up, encode only new ones with the library."""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

#: Below this code point the classes of the splitting pattern are spelled out; a text with a character at or above it goes to the library whole.
PLAIN = 0x250
_LOADED: dict[str, "Encoder"] = {}


def _members(test) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if test(chr(c)))


def _splitter() -> re.Pattern:
    letters = _members(lambda c: unicodedata.category(c)[0] == "L")
    digits = _members(lambda c: unicodedata.category(c)[0] == "N")
    spaces = re.escape("\t\n\x0b\x0c\r \x85\xa0")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _by_rank(path: str):
    """A rank-merging encoder of one pre-token for a vocabulary whose ids follow the order of its merges, else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if i < 256 + len(pairs)}
    return tiktoken.Encoding("pre-tokens", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Token ids of whole texts, equal to the library's with its default handling of special strings.

    ``entries`` bounds the pre-tokens kept in a worker; when they are too many, the cache starts anew.
    """

    def __init__(self, path: str, entries: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size()
        self.width = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.split = _splitter().findall
        self.single = _by_rank(path)
        self.foreign = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]").search
        self.entries, self.known, self.base = entries, {}, {}

    def plain(self, text: str) -> bool:
        return not self.foreign(text) and not any(s in text for s in self.special)

    def value(self, ids: list[int]):
        """What is kept for a pre-token."""
        return np.array(ids, self.width).tobytes()

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.entries:
            self.known = dict(self.base)
            new = [p for p in pieces if p not in self.known]
        found = map(self.single, new) if self.single else (e.ids for e in self.library.encode_batch(new, add_special_tokens=False))
        self.known.update(zip(new, map(self.value, found)))

    def values(self, text: str) -> list:
        if not self.plain(text):
            return [self.value(self.library.encode(text, add_special_tokens=False).ids)]
        pieces = self.split(text)
        try:
            return [self.known[p] for p in pieces]
        except KeyError:
            self.learn(set(pieces))
            return [self.known[p] for p in pieces]

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.values(text)), self.width)


class Lengths(Encoder):
    """Keeps token counts only; ``base`` is the broadcast tier and stays when the worker's own tier is emptied."""

    def value(self, ids: list[int]) -> int:
        return len(ids)

    def seed(self, base: dict[str, int]) -> None:
        if self.base is not base:
            self.base = base
            self.known = dict(base)


def loaded(kind: type[Encoder], path: str) -> Encoder:
    """One encoder for each worker process and file, kept between tasks."""
    key = f"{kind.__name__}:{path}"
    if key not in _LOADED:
        _LOADED[key] = kind(path)
    return _LOADED[key]
