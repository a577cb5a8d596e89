"""Registrations, approvals, keys and verification: expected rows by hand and by sequential loops."""

import hashlib
import random

import pytest

COMPANY = "id long, company_name string, tax_code string"


def by_loop(requests, companies):
    names, codes, out = {c[1] for c in companies}, {c[2] for c in companies}, {}
    for i, n, t in sorted(requests):
        if not n or not t:
            out[i] = "missing"
        elif n in names or t in codes:
            out[i] = "duplicate"
        else:
            out[i] = "kept"
            names.add(n)
            codes.add(t)
    return out


def test_refused_requests_take_nothing(spark):
    from pactum.operators import registrations as R

    asked = [(1, "N1", "T1"), (2, "N2", "T1"), (3, "N2", "T2"), (4, "", "T9"), (5, "N9", None), (6, "N3", "T2"), (7, "n1", "T7"), (8, "Old", "T8"), (9, "N9", "OLD"), (10, "N10", "T10")]
    stored = spark.createDataFrame([(1, "Old", "OLD"), (2, "N20", ""), (3, None, None)], COMPANY)
    answers = spark.createDataFrame([(1, True, "a", 5), (3, False, "b", 6), (10, True, "c", 7), (2, True, "d", 8)], "request_id long, ok boolean, tx_id string, block_number long")
    got = {r["id"]: tuple(r)[1:] for r in R.company_registrations(spark.createDataFrame(asked, COMPANY), stored, answers).collect()}
    assert got[1] == ("registered", "ACTIVE", "a", 5) and got[3] == ("error", "ERROR", None, None) and got[10] == ("registered", "ACTIVE", "c", 7) and got[7] == ("error", "ERROR", None, None)
    assert {k for k, v in got.items() if v[0] == "missing"} == {4, 5} and {k for k, v in got.items() if v[0] == "duplicate"} == {2, 6, 8, 9}


@pytest.mark.parametrize("few", [200_000, 40])
def test_acceptance_is_that_of_the_loop(spark, few):
    """10,000 random requests with crosswise conflicts, one name and one pair that many share."""
    from pactum.operators import registrations as R

    rng = random.Random(few)
    asked = [(k, f"n{rng.randrange(2500)}", f"t{rng.randrange(2500)}") for k in range(8000)]
    asked += [(8000 + k, "hot name", f"t{rng.randrange(4000)}") for k in range(1000)] + [(9000 + k, "same", "same") for k in range(500)]
    asked += [(9500 + k, rng.choice(["", None, "x"]), rng.choice(["", None, "y"])) for k in range(500)]
    rng.shuffle(asked)
    asked = [(k, n, t) for k, (_, n, t) in enumerate(asked)]
    companies = [(1, "n7", "t8"), (2, "n9", "t10")]
    kept = R.accepted(spark.createDataFrame(asked, COMPANY).repartition(6), spark.createDataFrame(companies, COMPANY), few=few).collect()
    assert {r["id"] for r in kept} == {k for k, v in by_loop(asked, companies).items() if v == "kept"}


def test_staff_registrations(spark):
    from pactum.operators import registrations as R

    asked = [(1, "an", "e", 1, 1), (2, "an", "e2", 1, 2), (3, "an", "e3", 1, 1), (4, "old", "e", 1, 1), (5, "half", "e", 1, 1), (6, "half", "f", 2, 1), (7, "no", None, 1, 1), (8, "no", "e", 9, 1), (9, "no", "e", 1, 9), (10, "", "e", 1, 1)]
    requests = spark.createDataFrame(asked, "id long, user_name string, email string, company_id long, role_id long")
    staff = spark.createDataFrame([("old", "ACTIVE", 5), ("half", "ERROR", 6)], "user_name string, status string, block_number long")
    companies, roles = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1,), (2,)], "id long")
    answers = spark.createDataFrame([(2, True, "a", 1), (3, True, "b", 2), (4, True, "c", 3), (5, False, "d", 4)], "request_id long, ok boolean, tx_id string, block_number long")
    got = R.staff_registrations(requests, staff, companies, roles, answers)
    assert {r["id"]: r["outcome"] for r in got.collect()} == {
        1: "error", 2: "registered", 3: "duplicate", 4: "duplicate", 5: "error", 6: "error", 7: "missing", 8: "unknown", 9: "unknown", 10: "missing"}
    assert sorted(tuple(r) for r in R.stored_staff(requests, got).collect()) == [("an", "e2", 1, 2, "ACTIVE"), ("half", "f", 2, 1, "ERROR")]


STEPS, EDGES, FLOWS = "id long, workflow_id long, status string", "prerequisite_id long, dependent_id long, workflow_id long", "id long, status string"
EVENTS = "id long, workflow_id long, step_id long, user_id long, action string, comment string"


def board(spark):
    steps = [(1, 1, "PENDING"), (2, 1, "PENDING"), (3, 1, None), (9, 2, "PENDING")]
    return spark.createDataFrame([(1, "PENDING"), (2, "IN_PROGRESS"), (3, "PENDING")], FLOWS), spark.createDataFrame(steps, STEPS), spark.createDataFrame([(1, 2, 1), (2, 3, 1)], EDGES)


#: event, outcome, step and workflow after it
TOLD = [
    ((1, 1, 2, 7, "FORCE_COMPLETE", "x"), "blocked", "PENDING", "PENDING"),
    ((2, 1, 1, 7, "APPROVED", "plain"), "signed", "PENDING", "PENDING"),
    ((3, 1, 2, 7, "APPROVED", "x"), "blocked", "PENDING", "PENDING"),
    ((4, 1, 1, 8, "FORCE_COMPLETE", None), "completed", "APPROVED", "IN_PROGRESS"),
    ((5, 1, 2, 8, "REJECTED", "no"), "rejected", "REJECTED", "REJECTED"),
    ((6, 1, 2, 8, "FORCE_COMPLETE", "again"), "completed", "APPROVED", "IN_PROGRESS"),
    ((7, 1, 3, 8, "FORCE_COMPLETE", ""), "completed", "APPROVED", "COMPLETED"),
    ((8, 1, 3, 8, "FORCE_COMPLETE", "twice"), "completed", "APPROVED", "COMPLETED"),
    ((9, 1, 1, 8, "REJECTED", None), "rejected", "REJECTED", "REJECTED"),
    ((10, 1, 2, 8, "FORCE_COMPLETE", ""), "blocked", "APPROVED", "REJECTED"),
    ((11, 1, 9, 8, "REJECTED", ""), "missing", None, "REJECTED"),
    ((12, 2, 9, 8, "LATER", ""), "invalid", "PENDING", "IN_PROGRESS"),
    ((13, 77, 9, 8, "REJECTED", ""), "missing", None, None),
    ((14, 2, 9, 8, "REJECTED", ""), "rejected", "REJECTED", "REJECTED"),
    ((15, 2, None, 8, "REJECTED", ""), "missing", None, "REJECTED"),
]


def test_approvals_in_order(spark):
    from pactum.operators import approvals as A

    flows, steps, edges = board(spark)
    events = spark.createDataFrame([e for e, *_ in TOLD], EVENTS).repartition(5)
    out = A.approval_outcomes(events, flows, steps, edges)
    got = {r["id"]: (r["outcome"], r["step_status"], r["workflow_status"]) for r in out.collect()}
    assert got == {e[0]: (o, s, w) for e, o, s, w in TOLD}
    assert {r["id"]: r["comment"] for r in out.collect()}[4] == A.FORCED_COMMENT
    found = {r["step_id"]: tuple(r)[1:] for r in A.step_results(out, steps).collect()}
    assert found == {1: ("REJECTED", 3, None), 2: ("APPROVED", 2, "again"), 3: ("APPROVED", 2, "twice"), 9: ("REJECTED", 1, "")}
    assert {r["workflow_id"]: tuple(r)[1:] for r in A.workflow_results(out, flows).collect()} == {1: ("REJECTED", 3), 2: ("REJECTED", 0), 3: ("PENDING", 0)}
    assert A.approval_outcomes(events.where("false"), flows, steps, edges).count() == 0


def test_approvals_of_a_stream(spark, tmp_path):
    """States outlive batches and restarts: the same outcomes from files that arrive one by one."""
    from pactum.operators import approvals as A

    flows, steps, edges = board(spark)
    starts = A.boards(flows, steps, edges)

    def run():
        events = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        query = A.approval_stream(events, starts).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress"))
        query.trigger(availableNow=True).start().awaitTermination()

    for part in (TOLD[:5], TOLD[5:9], TOLD[9:]):
        spark.createDataFrame([e for e, *_ in part], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    got = {r["id"]: (r["outcome"], r["step_status"], r["workflow_status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {e[0]: (o, s, w) for e, o, s, w in TOLD}


def keys_by_loop(events):
    keys, out = {}, {}
    for i, company, action, key in sorted(events):
        if action == "CREATE":
            keys[i], out[i] = [company, None, 1, "ACTIVE"], "created"
        elif key not in keys:
            out[i] = "missing"
        elif action == "REVOKE":
            keys[key][3], out[i] = "REVOKED", "revoked"
        elif keys[key][3] == "REVOKED":
            out[i] = "refused"
        else:
            keys[key][3], out[i] = "ROTATED", "rotated"
            keys[i] = [keys[key][0], key, keys[key][2] + 1, "ACTIVE"]
    return keys, out


def test_keys_by_id(spark):
    """Two live keys of one company turn and end by themselves; then long random chains against a loop."""
    from pactum.operators import signing_keys as K

    schema = "id long, company_id long, action string, key_id long"
    events = [(1, None, "ROTATE", 2), (2, 5, "CREATE", None), (3, 5, "CREATE", None), (4, None, "ROTATE", 2), (5, None, "REVOKE", 3), (6, None, "ROTATE", 3), (7, None, "ROTATE", 4), (8, None, "ROTATE", 2), (9, None, "REVOKE", 4), (10, None, "ROTATE", 6), (11, None, "REVOKE", 99)]
    got = {r["id"]: tuple(r)[1:] for r in K.key_lifecycle(spark.createDataFrame(events, schema)).collect()}
    assert got == {2: (5, None, 1, "ROTATED"), 3: (5, None, 1, "REVOKED"), 4: (5, 2, 2, "REVOKED"), 7: (5, 4, 3, "ACTIVE"), 8: (5, 2, 2, "ACTIVE")}
    told = {r["id"]: r["outcome"] for r in K.key_outcomes(spark.createDataFrame(events, schema)).collect()}
    assert told == {1: "missing", 2: "created", 3: "created", 4: "rotated", 5: "revoked", 6: "refused", 7: "rotated", 8: "rotated", 9: "revoked", 10: "missing", 11: "missing"}
    rng = random.Random(2)
    events = [(1, 1, "CREATE", None)]
    for i in range(2, 1500):
        action = rng.choices(["CREATE", "ROTATE", "REVOKE"], [1, 30, 1])[0]
        # mostly the newest key, so chains grow long
        key = None if action == "CREATE" else i - 1 if rng.random() < 0.97 else rng.randrange(1, i + 5)
        events.append((i, rng.randrange(9) if action == "CREATE" else None, action, key))
    keys, out = keys_by_loop(events)
    df = spark.createDataFrame(events, schema)
    assert {r["id"]: list(r)[1:] for r in K.key_lifecycle(df).collect()} == keys
    assert {r["id"]: r["outcome"] for r in K.key_outcomes(df).collect()} == out
    assert max(k[2] for k in keys.values()) > 20


VERSIONS = "version_id long, contract_id long, version_number long, contract_code string, change_summary string, content string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_verification_ladder(spark, tmp_path):
    """One version on each rung, versions of two contracts with neighbouring ids, gaps, and a log that batches write once."""
    from pactum.operators import proofs

    rows = [
        (10, 1, 1, "A", "", "one"), (11, 2, 1, "B", None, "other"), (12, 1, 2, "A", "x", "two"), (13, 2, 3, "B", "y", "after a gap"), (14, 1, 3, "A", "z", "changed"),
        (15, 1, 4, "A", "w", "four"), (16, 1, 5, "A", "sum", ""), (17, 1, 6, "A", None, None), (30, 3, 1, "C", None, "sent"), (31, 3, 2, "C", None, None),
    ]
    versions = spark.createDataFrame(rows, VERSIONS)
    made = {r["version_id"]: r for r in proofs.hash_proofs(versions).collect()}
    assert made[11]["previous_hash"] is None and made[13]["previous_hash"] is None and made[12]["previous_hash"] == sha("one")
    assert made[16]["document_hash"] == sha("A-5-sum") and made[16]["file_size"] == 7 and made[31]["document_hash"] == sha("C-2-") and made[31]["previous_hash"] == sha("sent")
    assert made[12]["merkle_root"] == sha(sha("two") + sha("one")) and made[10]["merkle_root"] == sha(sha("one"))
    stored = [(10, sha("one"), None), (11, sha("other"), None), (12, sha("two"), sha("one")), (13, sha("after a gap"), "anything"), (14, sha("three"), sha("two")), (15, sha("four"), sha("other")), (16, sha("A-5-sum"), sha("four")), (30, sha("sent"), None)]
    store = spark.createDataFrame(stored, "version_id long, document_hash string, previous_hash string")
    tx = spark.createDataFrame([(12, "CONFIRMED"), (10, "FAILED"), (15, "CONFIRMED")], "version_id long, status string")
    found = proofs.verify_proofs(versions, store, tx)
    told = {10: proofs.LOCAL, 11: proofs.LOCAL, 12: proofs.ANCHORED, 13: proofs.LOCAL, 14: proofs.CHANGED, 15: proofs.BROKEN_CHAIN, 16: proofs.LOCAL, 17: proofs.NO_PROOF, 30: proofs.LOCAL, 31: proofs.NO_PROOF}
    assert {r["version_id"]: r["message"] for r in found.collect()} == told
    by = {r["version_id"]: r for r in found.collect()}
    assert by[14]["proof_hash"] == sha("three") and by[14]["current_hash"] == sha("changed") and by[17]["current_hash"] is None and not by[15]["verified"] and by[12]["anchored"]
    # anchored since the ledger answered, and not before
    answers = spark.createDataFrame([(30, True, "t2", 9, "b"), (30, True, "t1", 8, "a"), (10, False, "t3", 7, "c"), (12, True, "t4", 6, "d")], "version_id long, ok boolean, tx_id string, block_number long, block_hash string")
    fresh, audits = proofs.anchor(store, tx, answers)
    assert [tuple(r)[:4] for r in fresh.collect()] == [(30, "t1", 8, "a")] and [(r["tx_id"], r["resource"]) for r in audits.collect()] == [("t1", "HashProof:30")]
    after = proofs.verify_proofs(versions, store, tx.unionByName(fresh.select("version_id", "status")))
    assert {r["version_id"]: r["message"] for r in after.collect()} == told | {30: proofs.ANCHORED}
    path = str(tmp_path / "log")
    log = lambda df, batch: sorted((r["batch_id"], r["version_id"], r["verify_result"]) for r in proofs.log_verifications(df, path, batch, 4).collect())
    once = log(found, "before")
    assert log(found, "before") == once and len(once) == len(rows)
    both = log(after, "after")
    assert both == sorted(once + [("after", r["version_id"], r["verified"]) for r in after.collect()])
    assert log(after.where("version_id < 12"), "after") == sorted(once + [("after", 10, True), ("after", 11, True)])
