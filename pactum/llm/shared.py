"""What several operators need: tables in the shared folder, checked broadcasts, links to components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm.wordhash import tidy
from pactum.sources.files import noted

#: A side is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: spark.checkpoint.dir; where that is unset the warehouse, or on one machine (tests) a temporary folder."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        at = f"file://{tempfile.gettempdir()}/pactum-shared" if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; inside sources.files.scratch() what is written there goes at its end."""
    return noted(f"{shared_dir(spark)}/pactum/{name}-{uuid.uuid4().hex}")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and no executor's loss undoes it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES, rows: int | None = None) -> DataFrame:
    """Hint a broadcast when the counted size is under `limit`; else leave the join to a shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= limit else df


def free_name(df: DataFrame, base: str) -> str:
    """`base`, with as many underscores as make it a name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def plain_names(docs: DataFrame, *needed: str):
    """docs with all columns but the needed ones under plain names of their own, and a function that gives a result the old columns back.

    So other columns can't clash with what an operator adds, and come through with their values.
    """
    names = docs.columns
    plain = [n if n in needed else f"column_{k}" for k, n in enumerate(names)]
    return docs.toDF(*plain), lambda out: out.select(*plain).toDF(*names)


def with_computed(df: DataFrame, fields: str, compute) -> DataFrame:
    """df with further columns that compute(batches) yields, as one list of Arrow arrays for each Arrow batch.

    Rows and all other columns pass through untouched, so no join is needed to
    put results beside whole documents.  A column of df with the name of a result is replaced by it.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(fields).fields
    df = df.drop(*[f.name for f in added])
    names = df.columns
    # names that would be read as paths travel under others
    df = df.toDF(*[free_name(df, f"_{k}") if {".", "`"} & set(c) else c for k, c in enumerate(names)])
    schema = StructType([*df.schema.fields, *added])

    def run(batches):
        import pyarrow as pa

        state = compute()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *state(batch)], names=schema.names)
            del batch
            tidy()

    return df.mapInArrow(run, schema).toDF(*names, *[f.name for f in added])


#: Up to so many links (16 MB) one task joins them by union-find; beyond that the rounds below do.
FEW_LINKS = 1_000_000


def components(edges: DataFrame, name: str, max_rounds: int = 60, few_links: int = FEW_LINKS) -> DataFrame:
    """Connected components of links: (node, component = smallest node reachable), for nodes that have links.

    edges: (src, dst) longs; order, repeats and self links don't matter.
    Counted first: a bounded number of links is joined in one task.  More are
    joined in rounds of large-star and small-star steps: each node's neighbours
    are hung on the smallest one, until every node hangs on its root.  Minima
    are map-side combined, a hub's rows are joined (and split by AQE when
    skewed), and each round ends in a table in the shared folder.
    """
    hung = stash(_oriented(edges), f"{name}-links")
    before = _signature(hung)
    if before[0] <= few_links:
        return stash(hung.coalesce(1).mapInPandas(_joined, "node long, component long"), f"{name}-components")
    for _ in range(max_rounds):
        both = hung.unionByName(hung.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("src"), F.col("m").alias("dst"))
        large = _oriented(large)
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(root, "hi")
        small = joined.select(F.col("lo").alias("src"), F.col("m").alias("dst")).unionByName(root.select(F.col("hi").alias("src"), F.col("m").alias("dst")))
        hung = stash(_oriented(small), f"{name}-links")
        now = _signature(hung)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    children = hung.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return children.unionByName(hung.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _joined(batches):
    import numpy as np
    import pandas as pd

    parts = [b[["hi", "lo"]].to_numpy(np.int64) for b in batches]
    if not parts or not sum(map(len, parts)):
        return
    ids, links = np.unique(np.concatenate(parts), return_inverse=True)
    root = list(range(len(ids)))
    for a, b in links.reshape(-1, 2).tolist():
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[max(a, b)] = min(a, b)
    # ids are in order and every link points down, so one pass upwards settles all
    for k, r in enumerate(root):
        root[k] = root[r]
    yield pd.DataFrame({"node": ids, "component": ids[np.array(root)]})


def _oriented(edges: DataFrame) -> DataFrame:
    return (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct()
    )


def _signature(df: DataFrame) -> tuple:
    mixed = F.xxhash64("hi", "lo")
    row = df.agg(F.count("*").alias("n"), F.bit_xor(mixed).alias("x"), F.sum(F.shiftright(mixed, 20)).alias("s")).first()
    return tuple(row)
