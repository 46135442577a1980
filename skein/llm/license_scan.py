"""Operator 7: license scans with fuzzy search for short notices.

A text is reduced to its words (A-Z lower-cased), one space between them. The
base finds exact phrases. The method finds the notices of NOTICES with up to a
tenth of their characters wrong: a notice with at most k errors, cut into k + 1
pieces, holds one piece unharmed; the places of all pieces, found by their first bytes, are all
places where it can stand. There the regex library's bounded-error matching
decides, counts the errors and gives the span. Where notices overlap, the one
with the smallest share of errors stands. The score is the share of the best
notice's characters that are right, PHRASE_SCORE if only a phrase was found,
else 0.

Nothing is shuffled; memory is that of one batch of texts.

Defined results: null and empty texts have no words and no places (first_word
and last_word null, labels "", score 0); a very long text is searched whole; of
notices that overlap with equal shares of errors the longer one stands, then the
first by place and label; repeated rows give repeated results; an empty table
gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, arrow_map

#: The base: phrase and label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices and the labels that the method adds.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("creative commons attribution", "cc-by"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("made available under the terms of the eclipse public license", "epl"),
    ("licensed under the european union public licence", "eupl"),
    ("released under the boost software license", "bsl-1.0"),
    ("to the extent possible under law the author has waived all copyright", "cc0-1.0"),
    ("spdx license identifier apache 2 0", "apache-2.0"),
    ("spdx license identifier gpl 2 0", "gpl-2.0"),
    ("spdx license identifier gpl 3 0", "gpl-3.0"),
    ("spdx license identifier lgpl 2 1", "lgpl"),
    ("spdx license identifier mpl 2 0", "mpl"),
    ("spdx license identifier bsd 3 clause", "bsd-3-clause"),
    ("spdx license identifier mit", "mit"),
    ("all rights reserved", "all-rights-reserved"),
)
#: Share of a notice's characters that may be wrong.
ERRORS, PHRASE_SCORE = 0.1, 0.5


@dataclass(frozen=True)
class Found:
    label: str
    start: int  # characters of the reduced text
    end: int
    errors: int
    share: float


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES, errors: float = ERRORS) -> None:
        import regex

        self.phrases = [(p.encode(), label) for p, label in phrases]
        self.notices = []
        pieces = []
        for n, (text, label) in enumerate(notices):
            k = int(len(text) * errors)
            plain = regex.escape(text, literal_spaces=True)
            self.notices.append((text, label, k, [regex.compile(f"(?:{plain}){{e<={e}}}") for e in range(k + 1)]))
            bounds = [i * len(text) // (k + 1) for i in range(k + 2)]
            pieces += [(text[a:b].encode(), n, a) for a, b in zip(bounds, bounds[1:], strict=False)]
        #: Bytes of a seed that are looked up at every place of a text, and the pieces by them.
        self.q = min([8, *(len(p) for p, _, _ in pieces)])
        self.pieces: dict[bytes, list[tuple[bytes, int, int]]] = {}
        for piece in pieces:
            self.pieces.setdefault(piece[0][: self.q], []).append(piece)
        self.known = np.zeros(1 << 16, bool)
        for start in self.pieces:
            self.known[self._grams(start)] = True

    def _grams(self, raw: bytes) -> np.ndarray:
        """A 16-bit hash of the ``q`` bytes from each place on."""
        b = np.frombuffer(raw, np.uint8).astype(np.uint64)
        n = len(b) - self.q + 1
        h = b[:n].copy()
        for j in range(1, self.q):
            h <<= np.uint64(8)
            h |= b[j : j + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(48)).astype(np.int64)

    def seeds(self, words: bytes) -> list[tuple[int, int, int]]:
        """(place, notice, offset in it) of every piece found."""
        if len(words) < self.q:
            return []
        out = []
        for at in np.flatnonzero(self.known[self._grams(words)]).tolist():
            for piece, n, offset in self.pieces.get(words[at : at + self.q], ()):
                if words.startswith(piece, at):
                    out.append((at, n, offset))
        return out

    def base(self, words: bytes) -> list[tuple[int, str]]:
        """(word index, label) of each place; ``words`` has a space before, between and after the words."""
        out = []
        for phrase, label in self.phrases:
            at, before, word = words.find(phrase), 0, -1
            while at >= 0:
                if words[at - 1] == words[at + len(phrase)] == 32:
                    before, word = at, word + words.count(b" ", before, at)
                    out.append((word, label))
                at = words.find(phrase, at + 1)
        return out

    def _within(self, n: int, text: str, a: int, b: int) -> list[Found]:
        """A notice's occurrences in a window, those with the fewest errors first; what stands beside one is searched too."""
        notice, label, k, patterns = self.notices[n]
        if b - a < len(notice) - k:
            return []
        own = {text[i : i + 3] for i in range(a, b - 2)}
        if sum(notice[i : i + 3] in own for i in range(len(notice) - 2)) < len(notice) - 2 - 3 * k:
            return []  # an error harms three runs of three characters at most
        for errors, pattern in enumerate(patterns):
            if m := pattern.search(text, a, b):
                here = Found(label, m.start(), m.end(), errors, errors / len(notice))
                return [*self._within(n, text, a, m.start()), here, *self._within(n, text, m.end(), b)]
        return []

    def fuzzy(self, words: bytes) -> list[Found]:
        """Notices in a reduced text, none overlapping another, in order."""
        seeds = self.seeds(words)
        if not seeds:
            return []
        text = words.decode("utf-8", "replace")
        windows: dict[int, list[tuple[int, int]]] = {}
        for at, n, offset in seeds:
            k = self.notices[n][2]
            start = (at if len(text) == len(words) else len(words[:at].decode("utf-8", "replace"))) - offset
            windows.setdefault(n, []).append((max(0, start - k), start + len(self.notices[n][0]) + k))
        found = []
        for n, spans in windows.items():
            spans.sort()
            joined = [spans[0]]
            for a, b in spans[1:]:
                if a <= joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
                else:
                    joined.append((a, b))
            for a, b in joined:
                found += self._within(n, text, a, min(b, len(text)))
        found.sort(key=lambda f: (f.share, f.start - f.end, f.start, f.label))
        kept: list[Found] = []  # in order of place
        for f in found:
            at = bisect_left(kept, f.end, key=lambda x: x.start)  # those before begin before its end
            if not at or kept[at - 1].end <= f.start:
                kept.insert(at, f)
        return kept


def scan(documents: DataFrame, phrases=PHRASES, notices=NOTICES, errors: float = ERRORS) -> DataFrame:
    """(doc_id, n_words, places, notices) of each row.

    ``places``: (word, label) of the base; ``notices``: (label, first_word, words, errors, share).
    """

    def run(batches):
        scanner = Scanner(phrases, notices, errors)
        for b in batches:
            out: dict[str, list] = {"doc_id": b["doc_id"], "n_words": [], "places": [], "notices": []}
            for text in b["text"]:
                words = alnum_words(text)
                joined = b" ".join(words)
                out["n_words"].append(len(words))
                out["places"].append([{"word": w, "label": label} for w, label in sorted(scanner.base(b" " + joined + b" "))] if words else [])
                found = scanner.fuzzy(joined)
                reduced = joined.decode("utf-8", "replace") if found else ""
                out["notices"].append([{"label": f.label, "first_word": reduced.count(" ", 0, f.start), "words": reduced.count(" ", f.start, f.end) + 1, "errors": f.errors, "share": f.share} for f in found])
            yield out

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, places array<struct<word:bigint,label:string>>, notices array<struct<label:string,first_word:bigint,words:bigint,errors:bigint,share:double>>"
    return arrow_map(documents.select("doc_id", "text"), run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The figures of the contract, from places and notices."""
    base, more = F.array_distinct("places.label"), F.col("notices.label")
    best = F.lit(1.0) - F.array_min("notices.share")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.concat_ws(",", F.array_sort(base)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, more))).alias("labels"),
        F.coalesce(best, F.when(F.size("places") > 0, PHRASE_SCORE).otherwise(0.0)).alias("score"),
        F.size("notices").cast("long").alias("n_notices"),
    )
