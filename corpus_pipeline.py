"""A corpus from raw documents: each stage's result is written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of ``documents``. Nulls, empty texts, repeated rows and empty
tables go through with the results that the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.llm import byte_bpe, line_dedup, ngram_join, quality_rules, source_mix
from sundew.llm.queries import tokenizer_file
from sundew.plans.tables import materialize, ranked, release, tidy

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have too few words and go; an empty table gives an empty one."""
    return quality_rules.quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier equal or nearly equal line has; documents left without a word go. ``n_chars`` is counted anew."""
    kept = line_dedup.line_dedup(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.where(~changed | F.col("kept_text").rlike(line_dedup.NOT_BLANK)).select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """The documents with ``__row``, a number of each row's own, whatever its id. Written once, so that it stays."""
    return materialize(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), label)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the one of smallest id, null last. Rows are classed one by one, whatever their ids."""
    rows = numbered(docs, "pipeline-copies")
    classes = ngram_join.similar(rows.select("__row", "text"), key="__row").where("n_links > 0").select("__row", "class_id")
    # rows with one id go by their texts, so that the choice does not depend on the partitions
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text", "source", "lang", "n_chars").alias("h"), "__row")
    classed = materialize(classes.join(rows.select("__row", order.alias("place")), "__row"), "pipeline-classes")
    first = classed.groupBy("class_id").agg(F.min("place")["__row"].alias("__row"))
    gone = classed.select("__row").join(first, "__row", "left_anti")
    return rows.join(gone, "__row", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Rows are taken one by one, whatever their ids."""
    rows = numbered(docs, "pipeline-mix")
    # the mix draws by a place that depends on the rows alone; equal rows may change places
    light = rows.select("__row", "doc_id", "source", F.xxhash64("text", "lang", "n_chars").alias("h"), source_mix.word_count().alias("size"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("source").asc_nulls_last(), F.col("h"), F.col("__row")]
    places = materialize(ranked(light, order, "place", "pipeline-order").select("place", "__row", "source", "size"), "pipeline-places")
    mixed = source_mix.mix(places.select(F.col("place").alias("doc_id"), "source", "size")).where("copies > 0").select(F.col("doc_id").alias("place"), "copies")
    taken = rows.join(places.select("place", "__row").join(mixed, "place").drop("place"), "__row")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids (packed), checked by decoding them again. A null text has no ids and is exact; an empty table gives an empty one."""
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(docs.select("doc_id", "source", "text"), path, keep=["doc_id", "source"], verify=True)
    return encoded.select("doc_id", "source", "n_tokens", "ids", "exact")


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("mixing sources to target weights", mixing), ("byte-level BPE", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        after = materialize(stage(spark, docs, sf_dir), f"pipeline-{number}")
        if number:
            release(docs)
        tidy(spark)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)


#: The cube method and the compression bands have no SQL; the tests check each stage by brute force.
ORACLE_SQL = None
