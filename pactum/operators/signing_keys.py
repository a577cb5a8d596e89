"""Signing keys by their ids: created, rotated into new versions, revoked.

A key is named by the event that made it.  CREATE makes version 1.  ROTATE names a key and makes the next version of
it, unless that key doesn't exist by then or was revoked before; the key it names is ROTATED from then on (and may be
rotated again).  REVOKE names a key and ends it.  Whether a key exists depends on the rotation that made it, and that on
the one before; such chains are resolved by pointer doubling: each round every key learns about twice as many of its
ancestors, so a chain of n rotations takes log2(n) joins, each on unique ids and ended by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.operators.common import stash


def _made(events: DataFrame) -> DataFrame:
    """(id, company_id, key_id, sound): keys that events would make, with whether the step itself is allowed: the key named is
    one that an earlier event would make, and wasn't revoked before this event."""
    makers = events.where(F.col("action").isin("CREATE", "ROTATE"))
    named = makers.select(F.col("id").alias("key_id"), F.lit(True).alias("known"))
    # a revocation counts from when its key exists, so the first one after the key was made
    later = events.where(F.col("action") == "REVOKE").where("key_id < id").groupBy("key_id").agg(F.min("id").alias("revoked_at"))
    rows = makers.join(named, "key_id", "left").join(later, "key_id", "left")
    rotates = F.col("known").isNotNull() & (F.col("key_id") < F.col("id")) & ~F.coalesce(F.col("revoked_at") < F.col("id"), F.lit(False))
    created = F.col("action") == "CREATE"
    return rows.select("id", F.when(created, F.col("company_id")).alias("company_id"), F.when(~created, F.col("key_id")).alias("key_id"), (created | F.coalesce(rotates, F.lit(False))).alias("sound"))


def resolved(events: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, company_id, previous_id, key_version) of the keys that exist: every step from their CREATE on was allowed.

    events: (id, company_id, action, key_id), ids unique and in order of time.  The company is that of the CREATE.
    """
    # `steps`: how many keys a key has looked at, itself included, down to where its pointer stands
    rows = stash(_made(events).select("id", "company_id", "sound", F.col("key_id").alias("previous_id"), F.col("key_id").alias("up"), F.lit(1).cast("long").alias("steps")), "keys")
    for _ in range(max_rounds):
        # what isn't sound is settled: nothing above it matters
        if rows.where(F.col("sound") & F.col("up").isNotNull()).isEmpty():
            return rows.where("sound").select("id", "company_id", "previous_id", F.col("steps").alias("key_version"))
        above = rows.select(F.col("id").alias("up"), F.col("sound").alias("a_sound"), F.col("up").alias("a_up"), F.col("steps").alias("a_steps"), F.col("company_id").alias("a_company"))
        moved = rows.join(above, "up", "left")
        open_ = F.col("sound") & F.col("up").isNotNull()
        rows = stash(moved.select(
            "id", F.when(open_, F.col("a_company")).otherwise(F.col("company_id")).alias("company_id"), F.when(open_, F.coalesce("a_sound", F.lit(False))).otherwise(F.col("sound")).alias("sound"),
            "previous_id", F.when(open_, F.col("a_up")).alias("up"), F.when(open_, F.col("steps") + F.coalesce("a_steps", F.lit(0))).otherwise(F.col("steps")).alias("steps"),
        ), "keys")
    raise RuntimeError("rotations form a ring")


def key_lifecycle(events: DataFrame) -> DataFrame:
    """(id, company_id, previous_id, key_version, status): the keys that events leave behind.

    REVOKED once a revocation names the key after it was made; else ROTATED once a rotation of it took place; else ACTIVE.
    """
    keys = resolved(events)
    used = events.where(F.col("action") == "REVOKE").where("key_id < id").select(F.col("key_id").alias("id")).distinct().withColumn("revoked", F.lit(True))
    turned = keys.select(F.col("previous_id").alias("id")).where("id is not null").distinct().withColumn("rotated", F.lit(True))
    status = F.when(F.col("revoked").isNotNull(), "REVOKED").when(F.col("rotated").isNotNull(), "ROTATED").otherwise("ACTIVE")
    return keys.join(used, "id", "left").join(turned, "id", "left").select("id", "company_id", "previous_id", "key_version", status.alias("status"))


def key_outcomes(events: DataFrame) -> DataFrame:
    """(id, outcome) of every event: created, rotated, revoked; missing where it names no key that exists by then, refused where that key is revoked."""
    keys = resolved(events)
    made = keys.select("id", F.lit(True).alias("made"))
    named = keys.select(F.col("id").alias("key_id"), F.lit(True).alias("exists"))
    rows = events.join(made, "id", "left").join(named, "key_id", "left")
    there = F.col("exists").isNotNull() & (F.col("key_id") < F.col("id"))
    outcome = (
        F.when(F.col("action") == "CREATE", "created").when(~F.coalesce(there, F.lit(False)), "missing").when(F.col("action") == "REVOKE", "revoked")
        .when(F.col("made").isNotNull(), "rotated").otherwise("refused")
    )
    return rows.select("id", outcome.alias("outcome"))
