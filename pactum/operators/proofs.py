"""Hash proofs and their verification, anchoring, certificates, ledger and block hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pactum.functions import names as N
from pactum.operators.common import absent, count_when, top_by

# Messages of the checks.
NO_PROOF = "No hash proof generated for this version."
CHANGED = "Integrity check failed: document hash mismatch."
BROKEN_CHAIN = "Version chain integrity check failed: previous hash mismatch."
ANCHORED = "Integrity successfully verified with blockchain anchors."
LOCAL = "Integrity verified locally, but not anchored to the blockchain."
NO_CERTIFICATE, OTHER_OWNER = "Signature certificate not found", "Certificate does not belong to the user"
INACTIVE, EXPIRED = "Certificate is not active or has been revoked", "Certificate is expired"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def document_hash(content: Column, code: Column, number: Column, change: Column) -> Column:
    """The hash of the content; of code, number and change joined by dashes where it is null or empty."""
    return sha256(F.coalesce(F.nullif(content, F.lit("")), F.concat_ws("-", code, number.cast("string"), change)))


def merkle_root(own: Column, previous: Column) -> Column:
    return sha256(F.concat(own, F.coalesce(previous, F.lit(""))))


def with_previous(versions: DataFrame, ahead: DataFrame, *columns: str) -> DataFrame:
    """versions with columns of the version of the same contract and the number before, named previous_...; null across gaps.

    Of several versions with one number the smallest version_id counts.
    """
    first = ahead.groupBy("contract_id", "version_number").agg(F.min_by(F.struct("version_id", *columns), "version_id").alias("p"))
    before = first.select("contract_id", (F.col("version_number") + 1).alias("version_number"), *[F.col(f"p.{c}").alias(f"previous_{c}") for c in ("version_id", *columns)])
    return versions.join(before, ["contract_id", "version_number"], "left")


def hash_proofs(versions: DataFrame) -> DataFrame:
    """Proofs of versions (version_id, contract_id, version_number, contract_code, change_summary, content).

    Each is chained to the hash of its contract's version before.  Sizes are bytes of contents, characters of what
    stands for an empty one: code, number and change summary.
    """
    none = F.lit("")
    code, number, change = F.col("contract_code"), F.col("version_number"), F.coalesce("change_summary", none)
    stands = F.length(F.concat_ws("-", code, number.cast("string"), change))
    size = F.when(F.coalesce("content", none) != "", F.octet_length("content")).otherwise(stands)
    own = versions.select("version_id", "contract_id", "version_number", document_hash(F.col("content"), code, number, change).alias("document_hash"), size.alias("file_size"))
    out = with_previous(own, own, "document_hash").withColumnRenamed("previous_document_hash", "previous_hash")
    return out.select("version_id", "document_hash", "file_size", "previous_hash").withColumn("merkle_root", merkle_root(F.col("document_hash"), F.col("previous_hash")))


def verify_proofs(versions: DataFrame, proofs: DataFrame, transactions: DataFrame) -> DataFrame:
    """(version_id, verified, message, proof_hash, current_hash, anchored): every version against its stored proof.

    versions: as for hash_proofs; proofs: (version_id, document_hash, previous_hash).  In turn: is there a proof, has
    the version the hash it had, is the hash before it that of the proof of its contract's version before (where there
    are both), and has a confirmed transaction anchored it.  Texts are hashed where they are read; what is joined are
    ids and hashes.
    """
    stored = proofs.select("version_id", F.col("document_hash").alias("proof_hash"), "previous_hash")
    now = document_hash(F.col("content"), F.col("contract_code"), F.col("version_number"), F.coalesce("change_summary", F.lit("")))
    hashed = versions.select("version_id", "contract_id", "version_number", now.alias("now"))
    anchors = transactions.where(F.col("status") == "CONFIRMED").select("version_id").distinct().withColumn("tx", F.lit(True))
    rows = with_previous(hashed, hashed).join(stored, "version_id", "left").join(anchors, "version_id", "left")
    before = proofs.select(F.col("version_id").alias("previous_version_id"), F.col("document_hash").alias("before"))
    rows = rows.join(before, "previous_version_id", "left")
    message = (
        F.when(F.col("proof_hash").isNull(), NO_PROOF).when(F.col("now") != F.col("proof_hash"), CHANGED)
        .when(F.col("before").isNotNull() & ~F.col("previous_hash").eqNullSafe(F.col("before")), BROKEN_CHAIN).when(F.col("tx").isNotNull(), ANCHORED).otherwise(LOCAL)
    )
    rows = rows.withColumn("message", message)
    current = F.when(F.col("proof_hash").isNotNull(), F.col("now"))
    return rows.select("version_id", F.col("message").isin(ANCHORED, LOCAL).alias("verified"), "message", "proof_hash", current.alias("current_hash"), (F.col("message") == ANCHORED).alias("anchored"))


def log_verifications(results: DataFrame, path: str, batch_id: str, user_id: int | None = None) -> DataFrame:
    """Append the results of a batch to the log below a path, and give the whole log: (batch_id, version_id, verify_result, reason, user_id).

    A batch owns the folder of its id and replaces it, so one that is run again, after a failure or by mistake, leaves
    one set of rows; other batches' rows stay as they are.
    """
    rows = results.select("version_id", F.col("verified").alias("verify_result"), F.col("message").alias("reason"), F.lit(user_id).cast("long").alias("user_id"))
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return verification_log(results.sparkSession, path)


def verification_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("version_id long, verify_result boolean, reason string, user_id long, batch_id string").option("basePath", path).parquet(path)


def store_proofs(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Proofs after new ones: one per version, the new one where there are both."""
    cols = ["version_id", "document_hash", "previous_hash"]
    return existing.select(*cols).join(fresh.select("version_id"), "version_id", "left_anti").unionByName(fresh.select(*cols))


def anchor(proofs: DataFrame, transactions: DataFrame, answers: DataFrame, sender: str = "System") -> tuple[DataFrame, DataFrame]:
    """The transactions and audit entries that anchoring leaves behind, from what the ledger answered.

    Every proof without a confirmed transaction is sent; answers: (version_id, ok, tx_id, block_number, block_hash), the
    first good one (by tx_id) counts.  A proof that got none stays without and is sent again next time.  The proofs of
    the result are verified from then on.
    """
    todo = absent(proofs, transactions.where(F.col("status") == "CONFIRMED"), "version_id").select("version_id")
    good = answers.where("ok").groupBy("version_id").agg(F.min_by(F.struct("tx_id", "block_number", "block_hash"), "tx_id").alias("a"))
    sent = todo.join(good, "version_id")
    fresh = sent.select("version_id", "a.*", F.lit("CONFIRMED").alias("status"), F.lit("INVOKE").alias("tx_type"), F.lit(sender).alias("sender"))
    audits = sent.select("a.tx_id", F.lit("Anchor Proof").alias("action"), F.concat(F.lit("HashProof:"), F.col("version_id").cast("string")).alias("resource"), F.lit("VERIFIED").alias("after_state"))
    return fresh, audits


def latest_proof(proofs: DataFrame) -> DataFrame:
    """The one proof made last, ties by version: what a signature refers to."""
    return proofs.orderBy(F.desc("generated_at"), F.desc("version_id")).limit(1)


def newest_proofs(proofs: DataFrame, n: int = 10) -> DataFrame:
    return proofs.orderBy(F.desc("generated_at"), F.desc("version_id")).limit(n).select("version_id", "document_hash", "verified")


def top_transactions(approvals: DataFrame, n: int = 20) -> DataFrame:
    return approvals.orderBy(F.desc("approved_at"), F.desc("id")).limit(n).select("id", "user_id", "approved_at")


def chain_stats(transactions: DataFrame, proofs: DataFrame, certificates: DataFrame, signatures: DataFrame) -> DataFrame:
    """Totals, verified proofs and the highest block (0 for none) in one row."""
    tx = transactions.agg(F.count("*").alias("transactions"), F.coalesce(F.max("block_number"), F.lit(0)).alias("latest_block"))
    p = proofs.agg(F.count("*").alias("proofs"), count_when(F.col("verified")).alias("verified_proofs"))
    c, s = certificates.agg(F.count("*").alias("certificates")), signatures.agg(F.count("*").alias("signatures"))
    return tx.join(F.broadcast(p)).join(F.broadcast(c)).join(F.broadcast(s))


def proof_history(proofs: DataFrame, transactions: DataFrame, audits: DataFrame) -> DataFrame:
    """(version_id, tx_id, status, audits): each proof's transactions, each with an array of its audit entries, empty for none."""
    a = audits.groupBy("tx_id").agg(F.sort_array(F.collect_list(F.struct("id", "action"))).alias("audits"))
    tx = transactions.select("version_id", F.col("id").alias("tx_id"), "status")
    return proofs.select("version_id").join(tx, "version_id").join(a, "tx_id", "left").withColumn("audits", F.coalesce("audits", F.array()))


def ledger_stats(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count("*").alias("transactions"), F.count_distinct("record_key").alias("records"), count_when(F.col("is_delete")).alias("deletions"), F.coalesce(F.max("tx_id"), F.lit(0)).alias("max_block"))


def ledger_history(ledger: DataFrame) -> DataFrame:
    """Every state of every key, numbered by time; deletions have an empty record and leave no current one."""
    by_time = Window.partitionBy("record_key").orderBy("written_at", "tx_id")
    last = F.lead("tx_id").over(by_time).isNull()
    return ledger.select("record_key", "tx_id", "written_at", "is_delete", F.coalesce("record", F.lit("")).alias("record"), F.row_number().over(by_time).alias("revision"), (last & ~F.col("is_delete")).alias("is_current"))


def put_if_absent(writes: DataFrame, keys: DataFrame) -> DataFrame:
    """The first write of each key that isn't among the keys there already."""
    fresh = absent(writes.where(~F.col("is_delete")), keys, "record_key")
    return top_by(fresh, "record_key", "tx_id").select("record_key", "tx_id", "record")


def with_expiry(certificates: DataFrame) -> DataFrame:
    return certificates.withColumn("valid_to", N.days_later(F.col("valid_from"), F.col("valid_days")))


def active_certificates(certificates: DataFrame, now: Column) -> DataFrame:
    """Certificates that are active, not revoked and valid at a moment."""
    fit = (F.col("status") == "ACTIVE") & ~F.col("revoked") & (F.col("valid_to") >= now)
    return with_expiry(certificates).where(fit).select("id", "user_id", N.minute(F.col("valid_to")).alias("valid_to"))


def signing_checks(requests: DataFrame, certificates: DataFrame, now: Column) -> DataFrame:
    """(id, error): what speaks against signing with a certificate; '' for nothing."""
    c = with_expiry(certificates).select(F.col("id").alias("certificate_id"), F.col("user_id").alias("owner"), "status", "revoked", "valid_to")
    error = (
        F.when(F.col("owner").isNull(), NO_CERTIFICATE).when(F.col("owner") != F.col("user_id"), OTHER_OWNER)
        .when((F.col("status") != "ACTIVE") | F.col("revoked"), INACTIVE).when(F.col("valid_to") < now, EXPIRED).otherwise("")
    )
    return requests.join(c, "certificate_id", "left").select("id", error.alias("error"))


def _sized(hexes: Column) -> Column:
    """A DER length of one byte for less than 128 bytes, and the bytes, in hexadecimal."""
    return F.concat(F.lpad(F.lower(F.hex(F.floor(F.length(hexes) / 2).cast("long"))), 2, "0"), hexes)


def block_hash(number: Column, previous_hash: Column, data_hash: Column) -> Column:
    """SHA-256 of a block header as a DER sequence of the number and two octet strings (hashes in hexadecimal, under 63 bytes each)."""
    raw = F.lower(F.hex(number))
    even = F.when(F.length(raw) % 2 == 1, F.concat(F.lit("0"), raw)).otherwise(raw)
    # the first bit of a DER integer is its sign
    digits = F.when(F.substring(even, 1, 1) >= "8", F.concat(F.lit("00"), even)).otherwise(even)
    body = F.concat(F.lit("02"), _sized(digits), F.lit("04"), _sized(previous_hash), F.lit("04"), _sized(data_hash))
    return sha256(F.unhex(F.concat(F.lit("30"), _sized(body))))


def block_bytes(number: Column, previous_hash: Column, data_hash: Column) -> Column:
    """A block whose first field is its header: number, previous hash and data hash, tagged and with lengths in seven-bit groups."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.floor(number / F.pow(F.lit(2.0), k * 7)).cast("long") % 128)
    used = F.greatest(F.lit(1), F.array_max(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.when(F.element_at(groups, k) > 0, k).otherwise(0))))
    varint = F.array_join(F.transform(F.sequence(F.lit(1), used), lambda k: F.lpad(F.hex(F.element_at(groups, k) + F.when(k < used, 128).otherwise(0)), 2, "0")), "")
    field = lambda tag, h: F.when(F.length(h) > 0, F.concat(F.lit(tag), _sized(h))).otherwise("")
    header = F.concat(F.lit("08"), varint, field("12", previous_hash), field("1a", data_hash))
    return F.unhex(F.concat(F.lit("0a"), _sized(header)))


@F.pandas_udf(StructType([StructField("number", LongType()), StructField("previous_hash", StringType()), StructField("data_hash", StringType())]))
def parse_block(blocks: pd.Series) -> pd.DataFrame:
    """Number and hashes in the header of serialized blocks; nulls for what isn't one."""

    def varint(b: bytes, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (b[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if b[at - 1] < 0x80:
                return value, at

    def header(b: bytes | None):
        out = {1: 0, 2: b"", 3: b""}
        try:
            if b[0] != 0x0A:
                return None, None, None
            size, at = varint(b, 1)
            end = at + size
            while at < end:
                tag, at = varint(b, at)
                if tag & 7 == 0:
                    out[tag >> 3], at = varint(b, at)
                elif tag & 7 == 2:
                    n, at = varint(b, at)
                    out[tag >> 3], at = b[at : at + n], at + n
                else:
                    return None, None, None
        except (IndexError, TypeError):
            return None, None, None
        return out[1], out[2].hex(), out[3].hex()

    return pd.DataFrame([header(b) for b in blocks], columns=["number", "previous_hash", "data_hash"]).astype({"number": "Int64"})


def block_headers(blocks: DataFrame) -> DataFrame:
    """number, previous_hash, data_hash, block_hash of serialized blocks (column `block`)."""
    parsed = blocks.select(parse_block(F.col("block")).alias("h")).select("h.*")
    return parsed.withColumn("block_hash", block_hash(F.col("number"), F.col("previous_hash"), F.col("data_hash")))
