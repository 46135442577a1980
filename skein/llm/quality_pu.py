"""Operator 8: a quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; all other documents are unlabelled.
A first model tells positives from unlabelled ones and gives the class prior:
the smallest upper bound, over score cuts, of the unlabelled share above the
cut by the positive share above it. The model then minimises the non-negative
unbiased risk for that prior: prior * R+(positives) plus the larger of zero and
R-(unlabelled) - prior * R-(positives). It is additive: each property of a text
is cut at quantiles, each piece has a weight.

Properties come from the text alone. The fit reads at most SAMPLE positives and
SAMPLE unlabelled documents, the first by a hash of doc_id, one row each, never
those held out (crc32 of the doc_id as text, modulo 5, is 0). Scoring maps over
all rows and shuffles nothing. ``SAMPLE`` is the documented bound of what reaches
the driver.

Defined results: null and empty texts are scored by their (empty) properties; a
very long text is read whole; without any usable positive or unlabelled row
every score is 0.5; a document labelled both ways counts as not trusted; a null
doc_id is not held out and never learnt from; rows that share a doc_id are
scored each by its own text and learnt from as one, the one with the smallest
properties; an empty table gives an empty one; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

SAMPLE, BINS, STEPS, RATE, RIDGE, CUT = 10_000, 16, 2500, 0.1, 1e-5, 0.3
FOLDS = 5

_GROUPS = {
    "symbols": b"#*$%&", "bars": b"|<>", "bangs": b"!", "digits": b"0123456789", "stops": b".", "commas": b",", "lines": b"\n", "spaces": b" \t\r\x0b\x0c",
    "quotes": b"\"'`", "brackets": b"()[]{}", "marks": b"?:;-_=+/\\@^~", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "other": bytes(range(128, 256)),
}
_OF = np.full(256, len(_GROUPS), np.int64)
for _i, _v in enumerate(_GROUPS.values()):
    _OF[list(_v)] = _i
_LINE, _SPACE, _UPPER, _LOWER = map(list(_GROUPS).index, ("lines", "spaces", "upper", "lower"))
PROPERTIES = [*_GROUPS, "capitals", "words", "word_bytes", "distinct", "doubled", "doubled_lines", "lines_words"]


def properties(text: str | None) -> list[float]:
    """Shares of kinds of bytes, and how the words and lines of a text repeat."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw) or 1
    kinds = np.bincount(_OF, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=len(_GROUPS) + 1)[:-1]
    words = raw.split()
    m = len(words) or 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = kinds[_UPPER], kinds[_LOWER]
    return [
        *(kinds / n),
        upper / (upper + lower + 1),
        np.log1p(len(words)),
        (n - kinds[_SPACE] - kinds[_LINE]) / m,
        len(set(words)) / m,
        sum(map(eq, words, words[1:])) / m,
        1 - len(set(lines)) / (len(lines) or 1),
        len(lines) / m,
    ]


@dataclass(frozen=True)
class Model:
    """Cuts of each property, a weight for each piece, and the class prior."""

    cuts: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def pieces(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") + j * (BINS + 1) for j, c in enumerate(self.cuts)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.pieces(x)].sum(axis=1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _descend(cuts: np.ndarray, pos: np.ndarray, unl: np.ndarray, risk) -> Model:
    """Adam on the additive weights; ``risk`` gives the derivatives at the raw scores of both samples."""
    size = len(cuts) * (BINS + 1)
    shape = Model(cuts, np.zeros(size), 0.0, 0.0)
    p, u = shape.pieces(pos), shape.pieces(unl)
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, STEPS + 1):
        dp, du = risk(w[p].sum(axis=1) + w[-1], w[u].sum(axis=1) + w[-1])
        g = np.bincount(p.ravel(), np.repeat(dp, p.shape[1]), size) + np.bincount(u.ravel(), np.repeat(du, u.shape[1]), size)
        g = np.r_[g + RIDGE * w[:-1], dp.sum() + du.sum()]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(cuts, w[:-1], float(w[-1]), 0.0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(pos: np.ndarray, unl: np.ndarray, doubt: float = 0.05) -> float:
    """The smallest upper bound of (unlabelled share above a cut) / (positive share above it), by scores of unseen rows."""
    cuts = np.unique(pos)
    high_p = 1 - np.searchsorted(np.sort(pos), cuts) / len(pos)
    high_u = 1 - np.searchsorted(np.sort(unl), cuts) / len(unl)
    slack = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(len(unl)))
    at = int(np.argmin((high_u + slack) / high_p))
    return float(np.clip(high_u[at] / high_p[at], 0.02, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None = None) -> Model:
    """The model of samples of positives and unlabelled rows (rows of ``properties``)."""
    cuts = np.quantile(np.concatenate([pos, unl]), np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    if prior is None:
        def told(zp, zu):  # positives against unlabelled
            return -_sigmoid(-zp) / len(zp) / 2, _sigmoid(zu) / len(zu) / 2

        first = _descend(cuts, pos[::2], unl[::2], told)
        prior = class_prior(first.raw(pos[1::2]), first.raw(unl[1::2])) if min(len(pos), len(unl)) > 1 else 0.5

    def risk(zp, zu):
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = -prior * _sigmoid(-zp) / len(zp)
        if rest < 0:  # where the bound is broken, step back up
            return prior * _sigmoid(zp) / len(zp), -_sigmoid(zu) / len(zu)
        return up - prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)

    found = _descend(cuts, pos, unl, risk)
    return Model(found.cuts, found.weights, found.bias, prior)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _first(ids: DataFrame, n: int) -> DataFrame:
    return ids.filter(F.col("doc_id").isNotNull() & ~held_out()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model, from at most ``sample`` positives and ``sample`` unlabelled rows; None where there are none."""
    spark = documents.sparkSession
    trusted = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    kinds = {r[0]: 2 for r in _first(documents.select("doc_id"), sample).collect()}
    for r in _first(trusted, sample).collect():
        kinds[r[0]] = kinds.get(r[0], 0) + 1
    if not kinds:
        return None
    kind = documents.schema["doc_id"].dataType.simpleString()
    chosen = F.broadcast(spark.createDataFrame(list(kinds.items()), f"doc_id {kind}, kind int"))  # at most twice the sample

    def run(batches):
        for b in batches:
            yield {"kind": b["kind"], "doc_id": b["doc_id"], "x": [properties(t) for t in b["text"]]}

    read = arrow_map(documents.select("doc_id", "text").join(chosen, "doc_id"), run, f"doc_id {kind}, kind int, x array<double>")
    rows = read.groupBy("doc_id", "kind").agg(F.min("x").alias("x")).collect()  # as many as were chosen, whatever repeats
    rows.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([r.x for r in rows]).reshape(-1, len(PROPERTIES))
    kind_of = np.array([r.kind for r in rows], int)
    pos, unl = x[kind_of % 2 == 1], x[kind_of >= 2]
    return fit(pos, unl) if len(pos) and len(unl) else None


def score(documents: DataFrame, model: Model | None, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # some hundred numbers

    def run(batches):
        own = sent.value
        for b in batches:
            x = np.array([properties(t) for t in b["text"]]).reshape(-1, len(PROPERTIES))
            yield {"doc_id": b["doc_id"], "score": (own.score(x) if own else np.full(len(x), 0.5)).tolist()}

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = arrow_map(documents.select("doc_id", "text"), run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    return score(documents, learn(documents, labels, sample), cut)
