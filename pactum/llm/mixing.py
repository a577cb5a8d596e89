"""Mixing sources to target weights by Pfair scheduling of blocks.

Each source's documents are dealt into blocks of BLOCK_DOCS, in an order given
by a hash.  A source of weight w may start its j-th block (from 1) in slot
floor((j - 1) / w) and must have it by slot ceil(j / w).  In every slot the
eligible block with the earliest deadline goes first; on ties the one whose window
overlaps its successor's, then the heavier source, then the source's name.  At any slot
each source is less than one block from its share.

Sources end at different times.  When one ends, a new phase begins: the
weights of the others are scaled up to one and their windows start anew, so
the bound holds within each phase and every document has a place.  Weights are
exact fractions throughout.  Sources of weight zero come after all others,
by their sizes.

The schedule is one walk over the slots, since a block's slot follows from those of the blocks before.  It depends on
counts and weights alone and runs in one task, which holds a block for each source and hands slots on as it goes: its
memory doesn't grow with the table, its time does with the blocks, two to three millionths of a second each, so
10**10 documents, 1.6 * 10**8 blocks, take about seven minutes of one core.  A block has BLOCK_DOCS documents at every
size.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pactum.llm.shared import broadcast_if_small, stash

#: Documents in a block.
BLOCK_DOCS = 64
#: Deadlines beyond a long are given as this.
FAR = (1 << 63) - 1
#: Documents numbered by one task at a time: a source is salted into groups of about this size.
GROUP_DOCS = 4096
SLOTS = "source string, block long, slot long, phase int, release long, deadline long, start long"


def schedule(sources: list[tuple[str, int, Fraction]]):
    """Yield (source, block, slot, phase, release, deadline) for (name, blocks, weight); weights are scaled to one.

    Sources of weight zero begin when no other is left, then with their blocks for weights.
    """
    idle = [(name, blocks, Fraction(blocks)) for name, blocks, weight in sources if blocks > 0 and weight == 0]
    left = {name: [0, blocks, weight] for name, blocks, weight in sources if blocks > 0 and weight > 0}
    slot, phase = 0, 0
    while left or idle:
        if not left:
            left, idle = {name: [0, blocks, weight] for name, blocks, weight in idle}, []
        # one denominator for all, so windows are whole numbers divided by whole numbers
        common = math.lcm(*(w.denominator for _, _, w in left.values()))
        parts = {name: int(w * common) for name, (_, _, w) in left.items()}
        total, begin, done = sum(parts.values()), slot, False
        waiting, ready = [(0, name, 1) for name in sorted(left)], []
        while not done:
            at = slot - begin
            while waiting and waiting[0][0] <= at:
                _, name, j = heapq.heappop(waiting)
                w = parts[name]
                deadline, rest = divmod(j * total, w)
                # a window that ends within a slot has that slot in common with the next one
                heapq.heappush(ready, (deadline + (rest > 0), rest == 0, -w, name, j))
            if not ready:
                slot += 1
                continue
            deadline, _, _, name, j = heapq.heappop(ready)
            state, w = left[name], parts[name]
            yield name, state[0], slot, phase, begin + (j - 1) * total // w, min(FAR, begin + deadline)
            state[0] += 1
            slot += 1
            if state[0] == state[1]:
                del left[name]
                done = True
            else:
                heapq.heappush(waiting, (j * total // w, name, j + 1))
        phase += 1


def target_weights(counts: dict[str, int], weights: dict[str, float] | None, temperature: float = 0.7) -> dict[str, Fraction]:
    """Given weights as exact fractions; sources without one, or all, by size to the power `temperature`."""
    total = sum(counts.values()) or 1
    out = {}
    for name, n in counts.items():
        w = (weights or {}).get(name)
        out[name] = Fraction((n / total) ** temperature if w is None else w)
        if out[name] < 0:
            raise ValueError(f"weight of source {name!r} is negative")
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, source, block, slot, phase, release, deadline, position: every row of docs has its place in the mix.

    A null source is a source of its own, named ''.  Rows of a source are ordered by a hash of their
    doc_id; repeated rows follow each other and all get places.  Texts, however long, and further
    columns are not looked at.  An empty table gives an empty table.  The driver holds one row
    per source; block_docs is the size of a block.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    # one row per source, not per document
    sizes = {r["source"]: r["n"] for r in counts.collect()}
    plan = sorted((name, -(-n // block_docs), n) for name, n in sizes.items())
    shares = target_weights(sizes, weights)
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP_DOCS)).cast("long")
    salted = rows.join(broadcast_if_small(counts, 40, rows=len(sizes)), "source").withColumn("order", F.xxhash64("doc_id")).withColumn("salt", F.pmod(F.col("order"), groups))
    inside = F.row_number().over(Window.partitionBy("source", "salt").orderBy("order", "doc_id"))
    sums = stash(salted.groupBy("source", "salt").agg(F.count("*").alias("size")), "mix-groups")
    before = sums.withColumn("before", F.sum("size").over(Window.partitionBy("source").orderBy("salt")) - F.col("size")).drop("size")
    numbered = salted.withColumn("rank", inside).join(before, ["source", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    placed = numbered.select("doc_id", "source", F.floor(F.col("rank") / block_docs).alias("block"), F.pmod(F.col("rank"), F.lit(block_docs)).alias("within"))

    def run(batches):
        import pandas as pd

        for _ in batches:
            pass
        at, n_of = 0, {name: n for name, _, n in plan}
        names = [c.split()[0] for c in SLOTS.split(", ")]
        columns: list[list] = [[] for _ in names]
        for row in schedule([(name, blocks, shares[name]) for name, blocks, _ in plan]):
            for held, value in zip(columns, (*row, at), strict=True):
                held.append(value)
            at += min(block_docs, n_of[row[0]] - row[1] * block_docs)
            if len(columns[0]) >= 50_000:
                yield pd.DataFrame(dict(zip(names, columns, strict=True)))
                columns = [[] for _ in names]
        if columns[0]:
            yield pd.DataFrame(dict(zip(names, columns, strict=True)))

    # the schedule depends on counts and weights alone: one row per block, written by one task as it goes
    slots = stash(spark.range(0, 1, 1, 1).mapInPandas(run, SLOTS), "mix-slots")
    n_blocks = sum(b for _, b, _ in plan)
    return placed.join(broadcast_if_small(slots, 80, rows=n_blocks), ["source", "block"]).select(
        "doc_id", "source", "block", "slot", "phase", "release", "deadline", (F.col("start") + F.col("within")).alias("position")
    )
