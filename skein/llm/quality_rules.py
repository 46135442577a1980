"""Operator 4: quality rules with risk-controlled thresholds, in DataFrame functions only.

Base figures of each text are counted inside its row, so no row leaves its
partition and no array outgrows its text. Each rule compares a share with a
cutoff. Per stratum (language), labelled good documents that pass the base are
the holdout. From the most lenient cutoff of a rule to stricter ones, a cutoff
is certified while an exact binomial test rejects, at its level, that the share
of good documents it turns away exceeds the rule's part of RISK; the first
failure ends the sequence, so testing along it needs no correction, and the
level DOUBT is divided by rules and strata (Bonferroni). So with probability
1 - DOUBT no stratum loses more than RISK of its good documents to all rules
together. Without a certified cutoff a rule turns nothing away.

Scale: counts per stratum combine before their shuffle; the table of cutoffs has
one row a stratum, broadcast up to BROADCAST_STRATA, which is counted first.

Defined results: null and empty texts have no words and fail the base; a null
lang belongs to the stratum of the empty one; a very long text is counted whole
inside its row; labels other than 1 and null doc_ids are not in a
holdout, and a document labelled both ways is not good; repeated rows get
repeated results; an empty table gives an empty one; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
RISK, DOUBT, BROADCAST_STRATA = 0.02, 0.05, 10_000
#: Rules: share, and its cutoffs from lenient to strict. A larger share is turned away.
RULES = {
    "symbols": (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01),
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeats": (0.28, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05, 0.03),
    "lines": (0.2, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01),
}
BLANK = "[\\x20\\x09-\\x0D]+"


def figures(documents: DataFrame) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals) of each row."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANK), "")).withColumn("n", F.size("words"))
    # windows by hash: pairs, pairs of pairs, and so on
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        rows = rows.withColumn("hashes", F.zip_with("hashes", F.slice("hashes", F.lit(1 + step), F.greatest("n", F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("hashes", F.slice("hashes", F.lit(1), F.greatest(F.col("n") - (WINDOW - 1), F.lit(0))))
    # only texts with equal hashes go on, to the words of the windows in question
    rows = rows.withColumn("again", F.size(F.array_distinct("hashes")) < F.size("hashes"))
    rows = rows.withColumn("sorted", F.when(F.col("again"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("g"), i.alias("p"))))))

    def equal_ones(name: str) -> Column:
        return F.filter(name, lambda x, i: F.coalesce(x["g"] == F.get(name, i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(name, i + 1)["g"], F.lit(False)))

    rows = rows.withColumn("maybe", equal_ones("sorted"))
    rows = rows.withColumn("named", F.sort_array(F.transform("maybe", lambda x: F.struct(F.concat_ws(" ", F.slice("words", x["p"] + 1, WINDOW)).alias("g"), x["p"].alias("p")))))
    rows = rows.withColumn("places", F.sort_array(F.transform(equal_ones("named"), lambda x: x["p"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("places", start, lambda s, p: F.struct((s["n"] + (p + WINDOW - F.greatest(s["end"], p)).cast("long")).alias("n"), (p + WINDOW).alias("end")))["n"]
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    return rows.select(
        "doc_id", "stratum", F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def share(rule: str) -> Column:
    over = {"symbols": "word_chars", "capitals": "word_chars", "repeats": "n_words", "lines": "n_words"}[rule]
    count = {"symbols": "n_symbols", "capitals": "n_capitals", "repeats": "n_repeat_words", "lines": "n_dup_lines"}[rule]
    return F.col(count) / F.greatest(F.col(over), F.lit(1))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n draws at p, exactly; 1 from the mean on, where no test at a small level rejects."""
    start = F.struct((n * F.log1p(F.lit(-p))).alias("log"), F.lit(1.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:  # the log of the last term, and the sum of all in units of it
        ratio = (n - i + 1) * F.lit(p) / (i * F.lit(1 - p))
        return F.struct((s["log"] + F.log(ratio)).alias("log"), (F.lit(1.0) + s["sum"] / ratio).alias("sum"))

    ones = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    last = F.aggregate(ones, start, step, lambda s: F.exp(s["log"]) * s["sum"])
    return F.when((k >= n * F.lit(p)) | (n <= 0), F.lit(1.0)).otherwise(last)


def cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """One row a stratum: its good documents (n) and each rule's certified cutoff, or null."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    held = counted.filter(~base_failed()).join(good, "doc_id", "left_semi")
    turned = [F.sum((share(r) > c).cast("long")).alias(f"{r}_{i}") for r, cs in RULES.items() for i, c in enumerate(cs)]
    table = cut(held.groupBy("stratum").agg(F.count("*").alias("n"), *turned))
    level = doubt / (len(RULES) * max(1, table.count()))
    chosen = []
    for rule, cs in RULES.items():
        tried = F.array(*[F.struct(F.lit(float(c)).alias("c"), F.col(f"{rule}_{i}").alias("k")) for i, c in enumerate(cs)])
        start = F.struct(F.lit(True).alias("on"), F.lit(None).cast("double").alias("cut"))

        def step(s: Column, x: Column) -> Column:
            on = s["on"] & (binomial_cdf(x["k"], F.col("n"), risk / len(RULES)) <= level)
            return F.struct(on.alias("on"), F.when(on, x["c"]).otherwise(s["cut"]).alias("cut"))

        chosen.append(F.aggregate(tried, start, step)["cut"].alias(f"cut_{rule}"))
    return table.select("stratum", "n", *chosen)


def judge(documents: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """The base figures, base_failed and kept of each row, with the stratum."""
    counted = cut(figures(documents))
    table = cut(cutoffs(counted, labels, risk, doubt))
    side = F.broadcast(table) if table.count() <= BROADCAST_STRATA else table
    rows = counted.join(side, "stratum", "left")
    away = F.lit(False)
    for rule in RULES:
        away = away | F.coalesce(share(rule) > F.col(f"cut_{rule}"), F.lit(False))
    failed = base_failed()
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~away).alias("kept"))
