"""Importance resampling towards a target's hashed n-grams, scored without exploding a text.

Words are runs of letters, digits and characters beyond ASCII after A-Z are lower-cased; features are all runs of 1
to `widths` consecutive words, repeats counted; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo `buckets`.
Higher-order functions make each text's bucket array.  Of all source texts and of all target texts only the count of
each bucket is shuffled (partial sums first, so at most `buckets` rows a task) and reaches the driver; the gains made
of them are one literal array, over which a document's buckets are summed up.  Adding Gumbel noise to the weights and
taking the highest draws without replacement in proportion to the exponent of the weight.

Very long texts are taken in pieces cut where a word begins (PIECE characters and what is left of a word), the last
words of a piece carried into the next, so the arrays of one piece at a time are in memory and no run is lost.

Null and empty texts have no features and weight 0.  Repeated rows are rows of their own, each drawn or not; ties
go to the smaller doc_id (null last), then by n_features and weight.  A null doc_id draws as the empty text would.
Empty tables give empty results; an empty target leaves gains that follow from its counts of 0.  Other columns are
not read, so their names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.shared import stash

BUCKETS = 10_000
#: Longer texts are taken in pieces of about this many characters.
PIECE = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Within lower-cased text: what belongs to a word, and what stands between words.  Java matches the plain class many times faster than the other one negated.
IN_WORD, BETWEEN = r"[0-9a-z\x{80}-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_NO_WORDS = "cast(array() as array<string>)"
#: A row's number within its partition stands in the lower bits of monotonically_increasing_id, the partition's above.
ROW_BITS = 33


def _lowered(text: Column) -> Column:
    """A-Z lower-cased and no other letter; plain ASCII takes the quicker way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{IN_WORD}+"), F.lit(0))


def _tail(words: Column, n: int) -> Column:
    return F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n)


def _units(text: Column, widths: int, piece: int) -> Column:
    """array<struct<carried, text>>: the pieces of a text, each with the words before it that its first runs need."""
    whole = F.array(F.struct(F.expr(_NO_WORDS).alias("carried"), text.alias("text")))
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}{IN_WORD}*+{BETWEEN}*+"), F.lit(0))

    def grown(state: Column, p: Column) -> Column:
        kept = _tail(F.concat(state["carried"], _tail(_words(p), widths - 1)), widths - 1)
        return F.struct(kept.alias("carried"), F.array_append(state["units"], F.struct(state["carried"].alias("carried"), p.alias("text"))).alias("units"))

    none = F.struct(F.expr(_NO_WORDS).alias("carried"), F.expr("cast(array() as array<struct<carried:array<string>,text:string>>)").alias("units"))
    return F.when(F.length(text) <= piece, whole).otherwise(F.aggregate(cut, none, grown, lambda s: s["units"]))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often `use` has it."""
    return F.transform(F.array(value), use)[0]


def _bucket_array(carried: Column, words: Column, widths: int, buckets: int) -> Column:
    """The bucket of each run that ends within `words`."""

    def bucket(feature: Column) -> Column:
        return F.pmod(F.crc32(feature), F.lit(buckets)).cast("int")

    def of_width(width: int) -> Column:
        def buckets_of(row: Column) -> Column:
            runs = row
            for k in range(1, width):
                left = F.greatest(F.size(row) - k, F.lit(0))
                runs = F.zip_with(F.slice(runs, F.lit(1), left), F.slice(row, F.lit(k + 1), left), lambda run, word: F.concat(run, F.lit(" "), word))
            return F.transform(runs, bucket)

        return _named(F.concat(_tail(carried, width - 1), words), buckets_of)

    return F.concat(F.transform(words, bucket), *map(of_width, range(2, widths + 1)))


def _pieces(texts: DataFrame, text: str, widths: int, piece: int, *columns: Column) -> DataFrame:
    lowered = texts.select(*columns, _lowered(F.col(text)).alias("text"))
    return lowered.select(*lowered.columns[:-1], _units(F.col("text"), widths, piece).alias("units"))


def bucket_counts(texts: DataFrame, text: str, widths: int = 2, buckets: int = BUCKETS, piece: int = PIECE) -> list[int]:
    """How often each bucket occurs in all texts; `buckets` numbers, whatever the number of texts."""
    units = _pieces(texts, text, widths, piece).select(F.explode("units").alias("u"))
    rows = units.select(F.explode(_named(_words(F.col("u.text")), lambda words: _bucket_array(F.col("u.carried"), words, widths, buckets))).alias("bucket"))
    counts = [0] * buckets
    for row in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the logarithm of target share over source share, smoothed by one count a bucket."""
    n, s_all, t_all = float(len(source)), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source, target)]


def importance_weights(
    docs: DataFrame, gains: list[int], widths: int = 2, seed: int = 7, piece: int = PIECE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row; docs are read once and texts don't leave their task."""
    literal = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")

    def measured(u: Column) -> Column:
        return _named(_words(u["text"]), lambda words: F.struct(
            F.size(words).cast("long").alias("n"),
            F.aggregate(_bucket_array(u["carried"], words, widths, len(gains)), F.lit(0).cast("long"), lambda a, b: a + F.element_at(literal, b + 1)).alias("gain"),
        ))

    def total(name: str) -> Column:
        return F.aggregate("units", F.lit(0).cast("long"), lambda a, u: a + u[name])

    zero = F.lit(0).cast("long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = _pieces(docs, text, widths, piece, F.col(doc_id).alias("doc_id")).select("doc_id", F.transform("units", measured).alias("units"))
    rows = rows.select("doc_id", total("n").alias("n_words"), total("gain").alias("gain"))
    features = sum((F.greatest(F.col("n_words") - k, zero) for k in range(1, widths)), F.col("n_words"))
    rows = rows.select("doc_id", "n_words", features.alias("n_features"), "gain")
    # floor(gain / n_features) in integers
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(zero)
    return rows.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))


def ranked(scored: DataFrame, percent: int = 25, least_words: int = 20) -> DataFrame:
    """scored with `rank` of the highest `percent` of the rows that have enough words, null for the others.

    Rows are dealt by ranges of their order, numbered within each range, and each range's number of rows is added to
    the next ones': no task sees more than its range, and one row a range is summed up.
    """
    scored = stash(scored, "weights")
    fit = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    order = [fit.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    dealt = stash(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", ROW_BITS)
    parts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"), F.count_if(fit).alias("_fit"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", before.alias("_before"), F.floor(F.sum("_fit").over(Window.partitionBy()) * percent / 100).alias("_drawn"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << ROW_BITS) - 1) + 1
    joined = dealt.join(F.broadcast(parts), part == F.col("_part"))
    return joined.select(*scored.columns, F.when(place <= F.col("_drawn"), place).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, widths: int = 2, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of docs (doc_id, text) towards target (text)."""
    gains = bucket_gains(bucket_counts(docs, "text", widths, buckets), bucket_counts(target, "text", widths, buckets))
    return ranked(importance_weights(docs, gains, widths, seed), percent, least_words)
