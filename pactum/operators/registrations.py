"""Registrations by acceptance: companies that clash on either of two keys, staff that is anchored at last.

A company's request is refused when its tax code or its name is that of a stored company, or of an earlier request that
was accepted; one that was refused takes nothing.  Which requests are accepted therefore depends on those before, and
is found in rounds: of the requests that are still open, those that come first both under their tax code and under
their name are accepted at once, and all that share a key with an accepted one are refused.  Each round ends in a
table in the shared folder.  The last few open requests (at most `few`) are settled in one task by the rule itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.operators.common import stash

#: So many open requests fit one task (about 100 bytes each).
FEW_OPEN = 200_000
COMPANY_KEYS = ("tax_code", "company_name")
STAFF_FIELDS = ("user_name", "email", "company_id", "role_id")


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) == ""


def _any_blank(columns: tuple[str, ...]) -> Column:
    out = _blank(columns[0])
    for c in columns[1:]:
        out = out | _blank(c)
    return out


def accepted(requests: DataFrame, stored: DataFrame, keys: tuple[str, ...] = COMPANY_KEYS, few: int = FEW_OPEN) -> DataFrame:
    """(id, *keys) of the requests that are accepted: complete, and in conflict on no key with a stored row or an earlier accepted request.

    Of requests with the same keys only the first can be accepted, so one row stands for them from the start and a
    combination that many rows repeat is no task's burden.  Winners of a round are found by partial minima and met by
    id, and leave the open requests by anti-joins, which Spark splits where a key is skewed.
    """
    rows = requests.where(~_any_blank(keys)).groupBy(*keys).agg(F.min("id").alias("id")).select("id", *keys)
    for key in keys:
        rows = rows.join(stored.where(~_blank(key)).select(key).distinct(), key, "left_anti")
    rows = stash(rows.select("id", *keys), "open")
    found = None
    while True:
        left = rows.count()
        if left <= few:
            last = rows.coalesce(1).mapInPandas(_by_rule(keys), rows.schema)
            return last if found is None else found.unionByName(last)
        won = rows
        for key in keys:
            won = won.join(rows.groupBy(key).agg(F.min("id").alias("id")).select("id"), "id", "left_semi")
        won = stash(won.select("id", *keys), "won")
        found = won if found is None else found.unionByName(won)
        for key in keys:
            rows = rows.join(won.select(key), key, "left_anti")
        rows = stash(rows.select("id", *keys), "open")


def _by_rule(keys: tuple[str, ...]):
    def run(batches):
        import pandas as pd

        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values("id")
        taken, keep = [set() for _ in keys], []
        for values in rows[list(keys)].itertuples(index=False, name=None):
            free = not any(v in t for v, t in zip(values, taken, strict=True))
            keep.append(free)
            if free:
                for v, t in zip(values, taken, strict=True):
                    t.add(v)
        yield rows[keep]

    return run


def company_registrations(requests: DataFrame, companies: DataFrame, answers: DataFrame, few: int = FEW_OPEN) -> DataFrame:
    """(id, outcome, status, tx_id, block_number) of requests (id, company_name, tax_code).

    missing: a field lacks; duplicate: a stored company or an accepted request has the tax code or the name; else the
    company is stored, and what the ledger answered (request_id, ok, tx_id, block_number) makes it registered (ACTIVE)
    or, refused or unanswered, an error (ERROR).  A company in error is stored all the same and keeps its keys.
    """
    kept = accepted(requests, companies, few=few).select("id", F.lit(True).alias("kept"))
    told = answers.where("ok").select(F.col("request_id").alias("id"), "tx_id", "block_number")
    rows = requests.join(kept, "id", "left").join(told, "id", "left")
    outcome = (
        F.when(_any_blank(COMPANY_KEYS), "missing").when(F.col("kept").isNull(), "duplicate").when(F.col("tx_id").isNull(), "error").otherwise("registered")
    )
    rows = rows.withColumn("outcome", outcome)
    stored = F.col("outcome") == "registered"
    status = F.when(stored, "ACTIVE").when(F.col("outcome") == "error", "ERROR")
    return rows.select("id", "outcome", status.alias("status"), F.when(stored, F.col("tx_id")).alias("tx_id"), F.when(stored, F.col("block_number")).alias("block_number"))


def staff_registrations(requests: DataFrame, staff: DataFrame, companies: DataFrame, roles: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, user_name, outcome) of requests (id, user_name, email, company_id, role_id), in order of id for each name.

    missing: a field lacks; unknown: no such company or role; duplicate: the name is anchored by then, in staff (with a
    block number) or by an earlier request; else the name is stored or tried anew, and the ledger's answer makes it
    registered or an error.  So each name has errors up to its first good answer and duplicates from there on.
    """
    c, r = companies.select(F.col("id").alias("company_id"), F.lit(True).alias("has_company")), roles.select(F.col("id").alias("role_id"), F.lit(True).alias("has_role"))
    ok = answers.where("ok").select(F.col("request_id").alias("id"), F.lit(True).alias("ok"))
    anchored = staff.where((F.col("status") == "ACTIVE") & F.col("block_number").isNotNull()).select("user_name").distinct().withColumn("stored", F.lit(True))
    rows = requests.join(c, "company_id", "left").join(r, "role_id", "left").join(ok, "id", "left").join(anchored, "user_name", "left")
    fit = ~_any_blank(STAFF_FIELDS) & F.col("has_company").isNotNull() & F.col("has_role").isNotNull()
    first = rows.where(fit & F.col("ok") & F.col("stored").isNull()).groupBy("user_name").agg(F.min("id").alias("first_ok"))
    outcome = (
        F.when(_any_blank(STAFF_FIELDS), "missing").when(~fit, "unknown").when(F.col("stored").isNotNull() | (F.col("id") > F.col("first_ok")), "duplicate")
        .when(F.col("id") == F.col("first_ok"), "registered").otherwise("error")
    )
    return rows.join(first, "user_name", "left").select("id", "user_name", outcome.alias("outcome"))


def stored_staff(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(user_name, email, company_id, role_id, status): what each name's last stored or repeated registration left behind."""
    held = requests.join(outcomes.where(F.col("outcome").isin("registered", "error")).select("id", "outcome"), "id")
    last = held.groupBy("user_name").agg(F.max_by(F.struct("email", "company_id", "role_id", "outcome"), "id").alias("last"))
    return last.select("user_name", "last.email", "last.company_id", "last.role_id", F.when(F.col("last.outcome") == "registered", "ACTIVE").otherwise("ERROR").alias("status"))
