"""The corpus pipeline: documents to training-ready, encoded documents, stage by stage.

Each stage reads what its predecessor kept. Labels are only looked up by doc_id,
and never for rows that are held out.

Defined results, of every stage: other columns than doc_id and text are carried
along, whatever their names and kinds, and ``n_chars`` follows a text that is
cut, where there is such a column; null and empty texts and very long ones are
rows like others; an empty table gives an empty one. What else holds is said at
each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe_codec, decontam, near_dup, quality_pu, substring_dedup
from skein.llm.common import Tables, alnum_words, arrow_map, cut, table

#: Word shingles and percent of similarity of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 8 does not reject. A stage of one map: the score is joined to nothing.

    Each row is judged by its own text, null doc_ids and repeats too; without usable labels nothing is rejected.
    """
    model = quality_pu.learn(docs, table(spark, sf_dir, "labels"))
    sent = spark.sparkContext.broadcast(model)  # some hundred numbers

    def run(batches):
        import numpy as np

        own = sent.value
        for b in batches:
            x = np.array([quality_pu.properties(t) for t in b["text"]]).reshape(-1, len(quality_pu.PROPERTIES))
            keep = np.flatnonzero(own.score(x) >= quality_pu.CUT) if own else range(len(x))
            yield {c: [v[i] for i in keep] for c, v in b.items()}

    return arrow_map(docs, run, _schema(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest doc_id, of equal ones the first text.

    Rows that share a doc_id go only if their texts are linked; rows without words or doc_id stay.
    """
    rows, key = docs.filter("doc_id is not null"), "doc_id"
    if not rows.groupBy("doc_id").count().filter("count > 1").isEmpty():  # then rows are told apart by their order
        key = "row_" + "_" * max(map(len, docs.columns))  # longer than any of the table's
        rows = cut(rows.repartitionByRange("doc_id", F.md5("text")).sortWithinPartitions("doc_id", "text").withColumn(key, F.monotonically_increasing_id()))
    found = near_dup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), SHINGLE, PERCENT).filter("kept").select(F.col("doc_id").alias(key))
    return rows.join(found, key, "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those that are nothing else go.

    Rows without doc_id pass as they are; rows that share one are cut each by its own text.
    """
    return substring_dedup.remove(docs, substring_dedup.passages(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str, block_bytes: int = decontam.BLOCK_BYTES) -> DataFrame:
    """Documents without benchmark passages; those that are nothing else go. Each row is cut by its own text, whatever its doc_id."""
    benchmark = table(spark, sf_dir, "benchmark")
    out, held = docs, None
    while True:  # a later block's cuts can join a window of an earlier one: until a whole round cuts nothing
        blocks = decontam.item_blocks(benchmark, block_bytes)
        for items in blocks:
            out = _clean(spark, out, items)
        if isinstance(blocks, list):  # a single one, searched until nothing is left
            return out
        out, last = cut(out), held or _extent(docs)
        held = _extent(out)
        if held == last:
            return out


def _extent(docs: DataFrame) -> tuple:
    """Rows and characters: every cut takes some."""
    return tuple(docs.agg(F.count("*"), F.sum(F.length("text"))).first())


def _clean(spark: SparkSession, docs: DataFrame, items: list[tuple]) -> DataFrame:
    sent = spark.sparkContext.broadcast(items)  # bounded by the block

    def run(batches):
        phrases = decontam.Phrases(sent.value, decontam.WINDOW)
        for shard in decontam.shards(batches, decontam.SHARD_CHARS):
            texts, todo = list(shard["text"]), list(range(len(shard["text"])))
            hit: set[int] = set()
            while todo:  # joined ends can form a window again: until none is left
                found = decontam.search_shard(phrases, [texts[i] for i in todo])
                todo = [i for i, (_, spans, _) in zip(todo, found, strict=True) if spans]
                for i, spans in zip(todo, (s for _, s, _ in found if s), strict=True):
                    texts[i] = decontam.without_spans(texts[i], spans)
                hit.update(todo)
            keep = [i for i, t in enumerate(texts) if i not in hit or alnum_words(t)]
            out = shard | {"text": texts}
            if "n_chars" in shard:
                out["n_chars"] = [len(t) if i in hit else n for i, (t, n) in enumerate(zip(texts, shard["n_chars"], strict=True))]
            yield {c: [v[i] for i in keep] for c, v in out.items()}

    return arrow_map(docs, run, _schema(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hashes of ids and of the decoded text, of each row."""
    return bpe_codec.encode_decode(docs, decoded=False)


def _schema(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("decontamination", decontamination),
    ("BPE encoding", encoding),
]

#: SQL cannot express a fitted classifier, signatures or merges; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet below the shared folder and read again; a stage's table goes when the next one stands."""
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = tables.keep(str(i), stage(spark, docs, sf_dir))
        if i:
            tables.drop(str(i - 1))
    return docs
