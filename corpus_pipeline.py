"""A corpus pipeline of five stages, each one of the operators in tallyrill.llm at work on all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; rows are kept whole or leave, except that substring
deduplication shortens texts. An empty table passes through every stage.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.llm import bpe, decontaminate, jaccard, suffixes, tables, toxicity


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, scores at 0.5 or more go."""
    model = toxicity.learn(docs, tables.table(spark, sf_dir, "labels"))
    return toxicity.below(docs, model, 0.5)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents whose sets of five-word shingles are connected by similarities of 0.8 or more, the one with the smallest doc_id stays; of rows that repeat doc_id and text, one."""
    return jaccard.representatives(docs, k=5, num=80, den=100)


def without_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes or more that start earlier in the corpus are cut out of texts. A character that a cut parts goes, too; a null text stays null."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("_none"), F.lit(0).alias("_"), *rest).alias("_row"))
    kept = suffixes.dedup_substrings(packed, length=100, with_it="_row")
    text = F.when(~F.col("_row._none"), suffixes.whole_characters("kept"))
    kept = kept.select(text.alias("text"), "_row")
    named = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")} | {c: F.col("_row").getField(c) for c in rest}
    return kept.select(*(named[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a shorter item) go."""
    return decontaminate.clean(docs, tables.table(spark, sf_dir, "benchmark"), size=10)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digest of the text that they decode to."""
    import public_tokenizers

    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard", one_of_near_duplicates),
    ("suffix_dedup", without_repeated_substrings),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: SQL can express neither a trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with tables.scratch() as keep:  # what a stage wrote for itself goes when its result is written
            docs = keep(tables.written(stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
