"""Operator 2: BPE encoding and decoding by a prefix-sharing trie.

Per Arrow batch the distinct unseen words go into a trie. A depth-first walk
carries the last-token states down, so the encoding of a shared prefix is
worked out once; at a word's end the states are read backwards into its ids.
Words already encoded stay in a bounded table of the worker, so memory does not
grow with the input, and no row leaves its partition: the operator shuffles
nothing. Texts are decoded from their ids alone.

Defined results: a null or empty text has no ids and decodes to ""; a very long
text is encoded whole, as a block of its own; repeated rows give repeated
results; an empty table gives an empty one; columns other than ``doc_id`` and
``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .bpe import Bpe, library, load, plain_classes, tokenizer_path
from .common import Recent, arrow_map, blocks, looked_up, outlives, plain

TOKENIZER = "word_bpe_49k.json"
#: Units kept encoded per worker and round, and characters of text in work at once.
KEPT_UNITS, BLOCK_CHARS = 200_000, 4_000_000
#: Python's own lower-casing and white space agree with the library's on Latin-1 without these, and normalisation changes nothing there.
_CONTROLS = b"\x1c\x1d\x1e\x1f"
#: Units that the library splits.
_LIBRARY = re.compile("[\x1c-\x1f\u0180-\U0010ffff]")


class TrieCodec:
    """Encodes and decodes texts with a word-end BPE file."""

    def __init__(self, path: str) -> None:
        self.bpe: Bpe = load(path)
        self.library = library(path)
        specials = sorted(self.bpe.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        letters, numbers = plain_classes()
        #: The file's pattern for units without characters from U+0180 on.
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        self.units = Recent(KEPT_UNITS)
        self.names = [self.bpe.names.get(i, "") for i in range(max(self.bpe.names) + 1)]

    def pieces(self, unit: str) -> list[str]:
        """The pieces of a run without white space, in byte stand-ins."""
        if unit.isascii() and unit.isalpha():
            return [unit]
        if _LIBRARY.search(unit):
            return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(unit)]
        found = self.pattern.findall(unit)
        if unit.isascii() and unit.isprintable():
            return found
        stand_in = self.bpe.stand_in
        return ["".join([stand_in[b] for b in p.encode()]) for p in found]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of new words from one walk over their trie: a word's states read backwards are its tokens."""
        names, cut, out = self.bpe.vocab, len(self.bpe.end), {}
        for word, lasts, _ in self.bpe.walk(words, ends=True):
            token = lasts[-1]
            tokens, at = [token], len(word) + cut - len(token)
            while at:
                token = lasts[at]
                tokens.append(token)
                at -= len(token)
            tokens.reverse()
            out[word] = b"".join([names[t].to_bytes(4, "little") for t in tokens])
        return out

    def _learn_units(self, new: set[str]) -> None:
        units = self.units.now
        parts = {u: self.pieces(u) for u in self.units.recall(new)}
        # an ASCII piece of one unit can be a unit of its own, as in "word," and "word"; of others the stand-ins could be taken for one
        words = {p: units[p] for ps in parts.values() if len(ps) > 1 for p in ps if p in units and p.isascii() and p.isprintable()}
        words.update(self._learn({p for ps in parts.values() for p in ps}.difference(words)))
        for u, ps in parts.items():
            units[u] = words[ps[0]] if len(ps) == 1 else b"".join([words[p] for p in ps])

    def split(self, text: str) -> list[str]:
        """The units of a normalised text; no piece of the pattern holds white space."""
        if not plain(text, _CONTROLS):
            return self.library.normalizer.normalize_str(text).split(" ")
        return text.lower().split()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids (little-endian, 4 bytes each) of each text."""
        self.units.turn()
        parts = [self.special.split(t) if t and self.special and "<|" in t else [t or ""] for t in texts]
        lists = [[u for u in self.split(p) if u] for ps in parts for p in ps[::2]]  # every second part is a special string
        done = iter(looked_up(self.units.now, lists, self._learn_units))
        for ps in parts:
            found = next(done)
            for special in ps[1::2]:
                found = [*found, self.bpe.special[special].to_bytes(4, "little"), *next(done)]
            yield b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The library's decoding without a decoder: the tokens, one space between them."""
        return " ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))


@outlives
def codec(path: str) -> TrieCodec:
    """One codec a worker: its table serves all the worker's tasks."""
    return TrieCodec(path)


def encode_decode(documents: DataFrame, tokenizer: str = TOKENIZER, ids: bool = True, decoded: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row.

    With ``ids`` also the ids themselves (little-endian, 4 bytes each), with ``decoded`` the decoded text.
    """

    def run(batches):
        own = codec(tokenizer_path(tokenizer))
        for b in batches:
            for part in blocks(b["text"], BLOCK_CHARS):
                rows = list(own.encode(b["text"][part]))
                texts = [own.decode(x) for x in rows]
                out = {
                    "doc_id": b["doc_id"][part],
                    "n_tokens": [len(x) // 4 for x in rows],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in rows],
                    "decoded_sha256": [hashlib.sha256(d.encode("utf-8", "replace")).hexdigest() for d in texts],
                }
                yield out | ({"ids": rows} if ids else {}) | ({"decoded": texts} if decoded else {})

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return arrow_map(documents.select("doc_id", "text"), run, schema + ", ids binary" * ids + ", decoded string" * decoded)
