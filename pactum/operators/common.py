"""Shapes that many operators share: first rows by key, keyed overwrites, ordered text of a group, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.sources.files import shared_path

#: A side is broadcast only if the bytes of its rows, summed up, stay below this.
BROADCAST_BYTES = 32 << 20


def top_by(df: DataFrame, key: str | list[str], *order: Column | str, n: int = 1, place: str | None = None) -> DataFrame:
    """The first n rows of each key in an order; Spark limits each group before the shuffle as well as after it."""
    keys = [key] if isinstance(key, str) else key
    name = place or "_place"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if place else out.drop(name)


def replaced_by_key(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of `existing` whose key has no incoming row, and all incoming rows: deletion by key, then insertion."""
    kept = existing.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def absent(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the existing ones; null keys are never there."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def ordered_text(value: Column, separator: str, *order: Column | str) -> Column:
    """Aggregate: non-null values joined in an order; null if there are none."""
    names = [f"o{k}" for k in range(len(order))]
    listed = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(n) for o, n in zip(order, names, strict=True)], value.alias("v")))))
    return F.when(F.size(listed) > 0, F.array_join(F.transform(listed, lambda x: x["v"]), separator))


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of df takes: texts and binaries by length, nested columns by their text, 8 for all others."""
    width = F.lit(16)
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif kind in ("array", "map", "struct"):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            width = width + 8
    return width


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for at most `limit` bytes, summed over all rows; else leave the join to a shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df)).alias("n")).first()["n"] or 0) <= limit else df


def is_approved() -> Column:
    return F.coalesce(F.col("status") == "APPROVED", F.lit(False))


def count_when(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def rounded(value: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(value + 0.5).cast("long")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and no executor's loss undoes it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
