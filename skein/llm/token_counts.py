"""Operator 9: token counts at every prefix.

For each document a vector holds, for every prefix of the text, how many
tokens the library would give that prefix. It comes from the last-token states
of the pieces (see ``bpe``): a prefix's count is one more than that of the
prefix without its last token. Truncation ("how much of this text fits N
tokens") and budget questions are then lookups, without encoding again.

The vectors are stored as steps from prefix to prefix, a byte each where all of
a text's steps fit (``steps``, ``read_steps``), and the figures of a row are
read from what is stored. Vectors of distinct pieces are kept in a bounded table
per worker; nothing is shuffled.

Defined results: a null text counts as empty; empty texts have no tokens and
empty vectors; a very long text is a block of its own; repeated rows give
repeated results; an empty table gives an empty one; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .bpe import Bpe, library, load, plain_classes, tokenizer_path
from .common import Recent, arrow_map, blocks, looked_up, outlives, single_spaced, units

TOKENIZER, LIMIT = "byte_bpe_50k.json", 512
#: Units and pieces kept per worker and round, and characters of text in work at once.
KEPT_UNITS, KEPT_PIECES, BLOCK_CHARS = 400_000, 250_000, 4_000_000
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")
_CONTRACTIONS = {"'re", "'ve", "'ll"}


class PrefixCounter:
    """Token counts of all prefixes of texts, for a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        self.bpe: Bpe = load(path)
        self.library = library(path)
        specials = sorted(self.bpe.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")")
        letters, numbers = plain_classes()
        #: The file's pattern for units without characters from U+0180 on and without runs of white space.
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^\\s{letters}{numbers}]+|\\s+")
        #: By piece and by unit, its counts, at one byte each where they fit; longer units have none.
        self.piece = Recent(KEPT_PIECES)
        self.unit = Recent(KEPT_UNITS)

    def learn(self, pieces: Iterable[str]) -> None:
        """Counts after each code point of new pieces of the pattern, by one walk over their trie."""
        stand_in, known = self.bpe.stand_in, self.piece.now
        space = stand_in[32]
        new = {}
        for p in self.piece.recall(set(pieces).difference(known)):
            if p.isascii() and p.isprintable():  # the space alone has another stand-in
                new[p.replace(" ", space)] = p
            else:
                new["".join([stand_in[x] for x in p.encode("utf-8", "replace")])] = p
        for coded, _, counts in self.bpe.walk(new, ends=False):
            piece = new[coded]
            if len(piece) == len(coded):
                found = counts[1:]
            else:
                found, at = [], 0
                for c in piece:
                    at += len(c.encode("utf-8", "replace"))
                    found.append(counts[at])
            if piece in _CONTRACTIONS:  # cut short, it is a quote and a letter
                found[1] = 2
            known[piece] = bytes(found) if max(found, default=0) < 256 else found

    def _joined(self, pieces: list[str]) -> list[int]:
        """Counts over consecutive pieces, each raised by the totals before it."""
        out: list[int] = []
        before = 0
        for p in pieces:
            own = self.piece.now[p]
            out.extend([before + x for x in own] if before else own)
            before += own[-1]
        return out

    def odd(self, text: str) -> np.ndarray:
        """A text whose white space needs the whole: cut after a run of it, the run is one piece."""
        pieces = [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        runs = list(_RUN.finditer(text))
        self.learn({*pieces, *(m.group() for m in runs)})
        out = np.asarray(self._joined(pieces), np.int32)
        starts, start, before = {}, 0, 0
        for p in pieces:
            starts[start] = before
            before += self.piece.now[p][-1]
            start += len(p)
        for m in runs:
            if m.end() < len(text) and m.start() in starts:
                out[m.end() - 1] = starts[m.start()] + self.piece.now[m.group()][-1]
        return out

    def learn_units(self, new: set[str]) -> None:
        parts = {u: [u] if (w := u[u[0] == " " :]).isascii() and w.isalpha() else self.pattern.findall(u) for u in self.unit.recall(new)}
        self.learn({p for ps in parts.values() for p in ps})
        known, unit = self.piece.now, self.unit.now
        for u, ps in parts.items():
            own = known[ps[0]] if len(ps) == 1 else self._joined(ps)
            if type(own) is bytes:
                unit[u] = own
            elif max(own) < 256:
                unit[u] = bytes(own)

    def plain(self, found: list[str], vectors: list[bytes | None]) -> np.ndarray:
        """A text from its units and their counts; those too long to be kept are worked out."""
        if None in vectors:
            pieces = [p for u in found for p in self.pattern.findall(u)]
            self.learn(pieces)
            return np.asarray(self._joined(pieces), np.int32)
        if not vectors:
            return np.zeros(0, np.int32)
        sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
        flat = np.frombuffer(b"".join(vectors), np.uint8)
        totals = flat[np.cumsum(sizes) - 1].astype(np.int32)
        return flat + np.repeat(np.cumsum(totals, dtype=np.int32) - totals, sizes)

    def segment(self, text: str) -> np.ndarray:
        if not single_spaced(text):
            return self.odd(text)
        found = units(text)
        return self.plain(found, looked_up(self.unit.now, [found], self.learn_units)[0])

    def with_specials(self, text: str) -> np.ndarray:
        """A text with special strings: up to its last character, each is plain text."""
        parts, out, before = self.special.split(text), [], 0
        for i in range(0, len(parts), 2):
            if i + 1 == len(parts):
                out.append(self.segment(parts[i]) + before)
                continue
            own = int(self.segment(parts[i])[-1]) if parts[i] else 0
            out += [self.segment(parts[i] + parts[i + 1][:-1]) + before, np.asarray([before + own + 1], np.int32)]
            before += own + 1
        return np.concatenate(out)

    def counts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text, tokens of ``text[:i + 1]`` at ``i``."""
        self.unit.turn()
        self.piece.turn()
        plain = [None if not t or "<|" in t or not single_spaced(t) else units(t) for t in texts]
        vectors = iter(looked_up(self.unit.now, [x for x in plain if x is not None], self.learn_units))
        for text, found in zip(texts, plain, strict=True):
            if found is not None:
                yield self.plain(found, next(vectors))
            elif not text:
                yield np.zeros(0, np.int32)
            else:
                yield self.with_specials(text) if "<|" in text else self.segment(text)


@outlives
def counter(path: str) -> PrefixCounter:
    """One counter a worker: its tables serve all the worker's tasks."""
    return PrefixCounter(path)


def steps(counts: np.ndarray) -> bytes:
    """Counts by their steps: a signed byte each, or where one does not fit, all counts in 4 bytes each."""
    own = np.diff(counts, prepend=0)
    small = own.astype(np.int8)
    return small.tobytes() if (small == own).all() else counts.astype("<i4").tobytes()


def read_steps(raw: bytes, chars: int) -> np.ndarray:
    """The counts of a text of ``chars`` code points from its stored steps."""
    return np.cumsum(np.frombuffer(raw, np.int8), dtype=np.int64) if len(raw) == chars else np.frombuffer(raw, "<i4").astype(np.int64)


def truncate(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(documents: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_chars, n_tokens, fit_chars, counts) of each row.

    ``counts``: the stored vector; ``fit_chars``: code points of the longest prefix of at most ``limit`` tokens.
    """

    def run(batches):
        own = counter(tokenizer_path(tokenizer))
        for b in batches:
            for part in blocks(b["text"], BLOCK_CHARS):
                texts = [t or "" for t in b["text"][part]]
                stored = [steps(v) for v in own.counts(texts)]
                read = [read_steps(v, len(t)) for v, t in zip(stored, texts, strict=True)]
                yield {
                    "doc_id": b["doc_id"][part],
                    "n_bytes": [len(t.encode("utf-8", "replace")) for t in texts],
                    "n_chars": [len(t) for t in texts],
                    "n_tokens": [int(v[-1]) if len(v) else 0 for v in read],
                    "fit_chars": [truncate(v, limit) for v in read],
                    "counts": stored,
                }

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(documents.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes bigint, n_chars bigint, n_tokens bigint, fit_chars bigint, counts binary")


def truncated(found: DataFrame, budget: int) -> DataFrame:
    """(doc_id, fit_chars) for another budget, from stored vectors alone."""

    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "fit_chars": [truncate(read_steps(v, n), budget) for v, n in zip(b["counts"], b["n_chars"], strict=True)]}

    kind = found.schema["doc_id"].dataType.simpleString()
    return arrow_map(found.select("doc_id", "n_chars", "counts"), run, f"doc_id {kind}, fit_chars bigint")
