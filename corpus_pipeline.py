"""Corpus pipeline: documents through five stages, each written as Parquet and reread as the next one's input.

All stages but the last return the columns of documents, whatever their names, with their values.

1. quality           documents that the quality classifier rejects go
2. near duplicates   of each group of linked documents one row stays: the one with the smallest doc_id (null last), then text digest
3. decontamination   documents that hold a benchmark item go
4. mixing            all documents stay; rows and files are put in the order of the mix
5. token files       ids in block files, in the order of the mix, and what reading them back gives

Nulls in any column, empty and very long texts, repeated rows, columns whose names clash and empty tables go through
every stage: null and empty texts are judged by their site alone and hold no near duplicate or item, a null source is a
source of its own, rows that are repeated keep together, and an empty table stays one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm import decontaminate, mixing, ngram_join, quality, token_files
from pactum.llm.shared import broadcast_if_small, plain_names, stash


#: Rows that go to a Python worker at once: whole texts are wide, and JVM and worker each hold batches of them.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    small_batches(spark)
    docs, as_before = plain_names(docs, "doc_id", "text", "source", "lang")
    return as_before(quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep"))


def row_name() -> Column:
    """A row's name: 64 bits of doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def row_proof() -> Column:
    """64 bits that tell rows of one name apart, from another digest of doc_id and text; nulls differ from all values."""
    said = F.when(F.col("text").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("text")))
    return F.xxhash64(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), said), 256))


def named_rows(docs: DataFrame, most_turns: int = 20) -> tuple[DataFrame, DataFrame]:
    """docs with a name `_key` that rows share only if doc_id and text are the same, and the names that several rows have.

    Names that stand for different rows are found by one aggregation of (name, proof); all their rows are named anew, until
    none is left.  n rows have about n * n / 2**65 such pairs, three of 10**10, so a second turn is rare.
    """
    named = docs.withColumns({"_key": row_name(), "_proof": row_proof()})
    for turn in range(most_turns):
        rows = named.groupBy("_key").agg(F.count("*").alias("rows"), F.min("_proof").alias("least"), F.max("_proof").alias("most"))
        several = stash(rows.where("rows > 1").select("_key", (F.col("least") < F.col("most")).alias("differ")), "pipeline-several")
        shared = several.where("differ").select("_key", F.lit(True).alias("_shared"))
        if shared.isEmpty():
            return named.drop("_proof"), several.select("_key")
        named = named.join(broadcast_if_small(shared, 16), "_key", "left")
        named = named.withColumn("_key", F.when(F.col("_shared"), F.xxhash64("_key", "_proof", F.lit(turn))).otherwise(F.col("_key"))).drop("_shared")
    raise RuntimeError("rows did not get names of their own")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, by doc_id (null last) and a digest of doc_id and text; rows repeated under one doc_id and text stay once."""
    small_batches(spark)
    docs, as_before = plain_names(docs, "doc_id", "text")
    keyed, twice = named_rows(docs)
    joined = ngram_join.join_documents(keyed.select(F.col("_key").alias("doc_id"), "text"), links=False).select(F.col("doc_id").alias("_key"), "component_id")
    joined = stash(joined, "pipeline-components")
    several = stash(joined.where("component_id <> _key").select("component_id").distinct(), "pipeline-grouped")
    linked = stash(joined.join(broadcast_if_small(several, 16), "component_id").select("_key", "component_id").distinct(), "pipeline-linked")
    ids = keyed.select("doc_id", "_key").join(broadcast_if_small(linked, 24), "_key")
    best = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("best")).select("best._key")
    extra = linked.select("_key").join(broadcast_if_small(stash(best, "pipeline-best"), 16), "_key", "left_anti")
    extra, twice = broadcast_if_small(stash(extra, "pipeline-ids"), 16), broadcast_if_small(twice, 16)
    kept = keyed.join(extra, "_key", "left_anti")
    if not twice.isEmpty():
        kept = kept.join(twice, "_key", "left_anti").unionByName(kept.join(twice, "_key", "left_semi").dropDuplicates(["_key"]))
    return as_before(kept.drop("_key"))


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    small_batches(spark)
    docs, as_before = plain_names(docs, "doc_id", "text")
    return as_before(decontaminate.remove_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows that follow the mix."""
    small_batches(spark)
    docs, as_before = plain_names(docs, "doc_id", "source")
    places = mixing.mix(docs).groupBy("doc_id").agg(F.min("position").alias("_position")).withColumnRenamed("doc_id", "_id")
    places = broadcast_if_small(stash(places, "pipeline-places"), 32)
    placed = docs.join(places, docs["doc_id"].eqNullSafe(places["_id"]))
    return as_before(placed.repartitionByRange("_position").sortWithinPartitions("_position"))


def stored_order(docs: DataFrame) -> tuple:
    """Columns that give the order of rows as they were written: number of the file, place in it; doc_id for rows that come from no file."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return ("doc_id",)
    return (F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.col("_metadata.file_name"), F.col("_metadata.row_index"))


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and more, read back from files that keep the order of the rows."""
    small_batches(spark)
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.token_report(docs, str(tokenizer_path), order=stored_order(docs))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_unleaked),
    ("mixing", in_mixed_order),
    ("token_files", to_token_files),
]

#: The classifier, the mix and the tokenizer can't be told in SQL; tests hold the near-duplicate, quality, mixing and token stages against versions by hand, decontamination against its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"pipeline-{name}")
    return docs
