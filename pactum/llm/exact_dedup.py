"""Exact duplicates by recipes of content-defined chunks, with DataFrame functions alone.

Each text is cut where its own content says so: a chunk ends at the first white space after a sentence mark once it has
LEAST characters, or at MOST characters.  So equal texts have equal chunks, and texts that share long stretches share
most of theirs.  A document's recipe is the ordered list of its chunks' digests, packed as bytes of one width; it is
made where the text is read and takes about one byte in sixty.

Chunks are deduplicated by digest and content in one shuffle with map-side dedup, the only one that moves text: a
digest that stands for one content alone is that content's identifier.  Digests that stand for several contents (never
seen with SHA-256, tested with a poor one) are told apart by the rank of their content, and the recipes that hold them
are written anew with it.  From there on texts are compared as their lists of verified identifiers: two texts are equal
if, and only if, their lists are.  Groups are counted by partial sums; the rows of one group are dealt over SALTS parts
to learn the row that stays, so a group of a third of all rows is not one task's.

Null counts as empty; all empty texts are one group, whose list is empty.  Of equal texts the largest doc_id stays
(null is smaller than any); of rows that repeat this doc_id too, one stays.  Very long texts are bounded by their
own list of chunks, within their task.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.shared import stash

#: Characters of a chunk before its end is looked for, and at most.
LEAST, MOST = 1024, 8192
#: Parts that the rows of one group are dealt to.
SALTS = 256


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """array<string>: the chunks of a text in order; joined they are the text."""
    pattern = rf"(?s).{{{least},{most}}}?(?:(?<=[.!?;:\n])\s|\z)|.{{1,{most}}}"
    return F.when(F.length(text) <= least, F.filter(F.array(text), lambda t: t != "")).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def sha_128(chunk: Column) -> Column:
    """The first half of SHA-256, as 32 hex digits."""
    return F.substring(F.sha2(chunk, 256), 1, 32)


def _packed(names: Column) -> Column:
    return F.unhex(F.array_join(names, ""))


def recipes(docs: DataFrame, digest: Callable[[Column], Column] = sha_128, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(row, doc_id, text_sha256, recipe) of docs (doc_id, text), where recipes are equal if, and only if, texts are."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = rows.select("doc_id", "text", chunks(F.col("text"), least, most).alias("chunks"))
    # written once, so that row numbers hold from here on
    listed = stash(
        cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform("chunks", digest).alias("names")), "recipes"
    )
    contents = cut.select(F.explode("chunks").alias("chunk")).select(digest(F.col("chunk")).alias("name"), "chunk").distinct()
    shared = stash(contents.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "collided")
    plain = listed.select("row", "doc_id", "text_sha256", _packed(F.col("names")).alias("recipe"))
    if shared.isEmpty():
        return plain
    # all lists are written anew, each name with the rank of its content, within one plan that numbers the rows itself
    ranks = contents.join(shared, "name", "left_semi").select("name", "chunk", F.dense_rank().over(Window.partitionBy("name").orderBy("chunk")).alias("rank"))
    numbered = cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"), "chunks")
    placed = numbered.select("row", "doc_id", "text_sha256", F.posexplode_outer("chunks").alias("at", "chunk")).withColumn("name", digest(F.col("chunk")))
    ranked = F.concat("name", F.lpad(F.hex(F.coalesce("rank", F.lit(0))), 16, "0"))
    named = placed.join(ranks, ["name", "chunk"], "left").select("row", "doc_id", "text_sha256", F.when(F.col("chunk").isNotNull(), F.struct("at", ranked.alias("name"))).alias("entry"))
    again = named.groupBy("row", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    return stash(again.select("row", "doc_id", "text_sha256", _packed(F.transform("entries", lambda e: e["name"])).alias("recipe")), "recipes")


def exact_groups(listed: DataFrame, salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of recipes."""
    dealt = listed.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    parts = dealt.groupBy("recipe", "salt").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("stays"))
    groups = parts.groupBy("recipe").agg(F.sum("n").alias("group_size"), F.max("stays").alias("stays"), F.collect_list("salt").alias("salts"))
    # one row for each part that a group has rows in, at most `salts` of them
    answers = groups.select("recipe", "group_size", "stays", F.explode("salts").alias("salt"))
    joined = dealt.join(answers, ["recipe", "salt"])
    return joined.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "text_sha256")


def dedup_exact(docs: DataFrame) -> DataFrame:
    """Each row of docs (doc_id, text) with the row that stays of its equals: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(recipes(docs))
