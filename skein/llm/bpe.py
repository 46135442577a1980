"""Byte-pair encoding by last-token states.

A sequence of tokens is what byte-pair merging makes of a word exactly when
merging leaves each neighbouring pair of it as it is. So each prefix of a word
has exactly one possible last token: the one that is a suffix of the prefix and
that merging leaves beside the last token of the rest. The last token of every
prefix is therefore found from those of shorter prefixes, and words that share
a prefix share its states.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from .common import outlives


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Bpe:
    """Vocabulary and merges of a tokenizer file, and the states of prefixes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.stand_in = byte_alphabet()
        self._fits: dict[tuple[str, str], bool] = {}
        #: Tokens that merging can make.
        self.usable = {t for t in self.vocab if self.merged(self.symbols(t)) == [t]}
        #: By a token's last three symbols, the length of the longest token that ends so.
        self.reach: dict[str, int] = {}
        for token in self.usable:
            n = len(token) - (len(self.end) if self.end and token.endswith(self.end) else 0)
            if n >= 3:
                key = token[n - 3 :]
                self.reach[key] = max(n, self.reach.get(key, 0))

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """What merging makes of symbols: the lowest rank first, from left to right."""
        parts = list(parts)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 40))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging leaves ``left`` and ``right`` side by side."""
        key = (left, right)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[key] = self.merged(self.symbols(left) + self.symbols(right)) == [left, right]
        return known

    def last(self, text: str, n: int, lasts: list[str], tail: str = "") -> str:
        """The last token of ``text[:n]``, given those of its shorter prefixes (``lasts[i]`` of ``text[:i]``).

        There is only one, so the order of trials is free: first the token before, longer by one symbol.
        """
        vocab, fits = self.usable, self._fits
        grown = n - 1 - len(lasts[n - 1])
        token = text[grown:n] + tail
        if token in vocab and (not (left := lasts[grown]) or ((known := fits.get((left, token))) or known is None and self.fits(left, token))):
            return token
        i = n - self.reach.get(text[max(0, n - 3) : n] + tail, 3)
        if i < 0:
            i = 0
        while i < n:
            if i != grown:
                token = text[i:n] + tail
                if token in vocab:
                    left = lasts[i]
                    if not left:
                        return token
                    known = fits.get((left, token))
                    if known or known is None and self.fits(left, token):
                        return token
            i += 1
        raise ValueError(f"no token of the vocabulary ends {text[:n]!r}")

    def walk(self, words: Iterable[str], ends: bool) -> Iterator[tuple[str, list[str], list[int]]]:
        """Each distinct word with the last tokens and token counts of its prefixes, the empty one first.

        The sorted words are their trie laid out depth first: going from one to
        the next, the states of the prefix that both share stay, those below it
        are dropped, and only new nodes are worked out. ``ends``: the last state
        is that of the whole word with the end-of-word suffix, without a count.
        The lists are reused: read them before the next step.
        """
        lasts, counts, before, last = [""], [0], "", self.last
        for word in sorted(words):
            n = len(word)
            for shared in range(min(n - ends, len(lasts) - 1), -1, -1):
                if word.startswith(before[:shared]):
                    break
            del lasts[shared + 1 :], counts[shared + 1 :]
            for k in range(shared + 1, n + 1 - ends):
                token = last(word, k, lasts)
                lasts.append(token)
                counts.append(counts[k - len(token)] + 1)
            if ends:
                lasts.append(last(word, n, lasts, self.end))
                yield word, lasts, counts
                lasts.pop()
            else:
                yield word, lasts, counts
            before = word


@outlives
def load(path: str) -> Bpe:
    return Bpe(path)


@outlives
def library(path: str):
    """The tokenizers library's reading of the file, without truncation and padding, on one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def plain_classes(stop: int = 0x180) -> tuple[str, str]:
    """Letters and numbers below ``stop`` as the inside of character classes."""
    import unicodedata

    kinds: dict[str, str] = {"L": "", "N": ""}
    for c in map(chr, range(stop)):
        if (kind := unicodedata.category(c)[0]) in kinds:
            kinds[kind] += c
    return kinds["L"], kinds["N"]


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer on this machine; executors look it up for themselves."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
