"""Audit log: what a request did, who sent it, what may be kept of its payload."""

from __future__ import annotations

import json
from urllib.parse import parse_qsl

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Secrets in payloads, what stands for them, and the lengths that are kept.
SECRETS = ("password", "password_hash", "secret")
MASK, ACTION_CHARS, PAYLOAD_CHARS = "******", 100, 4000
WRITING = ("POST", "PUT", "DELETE", "PATCH")
JSON_TYPE, FORM_TYPE = "application/json", "application/x-www-form-urlencoded"
LIST_PATHS = ("/api/contracts/", "/api/contracts/list/")
NOISE = ("/static/", "/media/")


def contract_in_path(path: Column, what: str) -> Column:
    """The contract's id in .../contracts/<id>/<what>/...; null if there is none."""
    return F.nullif(F.regexp_extract(path, rf"/contracts/(\d+)/{what}/", 1), F.lit(""))


def contract_id_of(path: Column) -> Column:
    """The contract that an analysis, a review or a detail page is about."""
    has = lambda w: F.contains(path, F.lit(f"/{w}/"))
    return (
        F.when(path.isin("/login/", "/logout/", "/admin-dashboard/", "/api/admin/config/ocr/", *LIST_PATHS) | F.startswith(path, F.lit("/api/admin/users/")), None)
        .when(has("analyze"), contract_in_path(path, "analyze")).when(has("review"), contract_in_path(path, "review")).when(has("detail"), contract_in_path(path, "detail"))
    ).try_cast("long")


def named_action(path: Column, method: Column, code: Column) -> Column:
    """What a known path means; null if it means nothing.  `code` is that of contract_id_of(), null if no such contract is stored."""
    has = lambda w: F.contains(path, F.lit(w))
    post = method == "POST"
    user = lambda: F.element_at(F.split(path, "/"), -3)
    told = lambda text, what: F.when(code.isNotNull(), F.concat(F.lit(f"{text}: "), code)).when(
        contract_in_path(path, what).isNotNull(), F.concat(F.lit(f"{text} (ID: "), contract_in_path(path, what), F.lit(")")))
    admin = F.startswith(path, F.lit("/api/admin/users/"))
    return (
        F.when((path == "/login/") & post, "Logged in successfully").when(path == "/logout/", "Logged out").when(path == "/admin-dashboard/", "Accessed custom Admin Dashboard")
        .when(admin & has("/delete/"), F.concat(F.lit("Admin request to delete user (ID: "), user(), F.lit(")")))
        .when(admin & has("/retry/"), F.concat(F.lit("Admin request to retry anchoring user (ID: "), user(), F.lit(")")))
        .when((path == "/api/admin/config/ocr/") & post, "Admin changed system OCR configuration")
        .when(path.isin(*LIST_PATHS), F.when(post, "Uploaded/Created a new contract"))
        .when(has("/analyze/"), told("Triggered AI analysis for contract", "analyze")).when(has("/review/"), told("Submitted expert review for contract", "review"))
        .when(has("/detail/"), F.when(code.isNotNull(), F.concat(F.lit("Viewed contract details: "), code)))
        .when(path == "/identity/", "Accessed Identity Registry").when((path == "/api/companies/") & post, "Registered a new company node")
        .when((path == "/api/register-user/") & post, "Registered a new decentralized staff identity").when(path == "/workflows/", "Accessed Workflow Board")
        .when(has("/approve/"), "Approved/Rejected workflow step")
    )


def any_action(path: Column, method: Column) -> Column:
    """What is noted of other requests: writes, and visits outside the interfaces."""
    page = (method == "GET") & ~F.startswith(path, F.lit("/api/")) & ~F.startswith(path, F.lit("/admin/"))
    return F.when(method.isin(*WRITING), F.concat(F.lit("Performed "), method, F.lit(" request on "), path)).when(page, F.concat(F.lit("Visited page: "), path))


def classify(requests: DataFrame, contracts: DataFrame) -> DataFrame:
    """(id, action) of requests that are no noise and didn't fail; an action is null where nothing is noted."""
    path, method = F.col("path"), F.col("method")
    noise = F.startswith(path, F.lit(NOISE[0])) | F.startswith(path, F.lit(NOISE[1])) | (path == "/api/admin/stats/") | F.contains(path, F.lit("favicon"))
    rows = requests.where((F.col("status_code") < 400) & ~noise).withColumn("contract_id", contract_id_of(path))
    coded = rows.join(contracts.select(F.col("id").alias("contract_id"), "contract_code"), "contract_id", "left")
    action = F.coalesce(named_action(path, method, F.col("contract_code")), any_action(path, method))
    return coded.select("id", F.substring(action, 1, ACTION_CHARS).alias("action"))


def client_ip(forwarded_for: Column, remote: Column) -> Column:
    """The first address that was forwarded, else the sender's."""
    return F.when(F.coalesce(forwarded_for, F.lit("")) != "", F.element_at(F.split(forwarded_for, ","), 1)).otherwise(remote)


def _payload_of(method: str | None, content_type: str | None, body: str | None, query: str | None) -> str | None:
    """One request's payload as it is kept: top-level secrets of a JSON body or a form masked, the last value of each GET parameter."""
    if method in WRITING:
        if content_type == JSON_TYPE and body:
            try:
                told = json.loads(body)
            except ValueError:
                return None
            return json.dumps(told | {k: MASK for k in SECRETS if k in told} if isinstance(told, dict) else told)
        form: dict[str, list[str]] = {}
        for k, v in parse_qsl(body or "", keep_blank_values=True) if content_type == FORM_TYPE else ():
            form.setdefault(k, []).append(v)
        return json.dumps(form | {k: [MASK] for k in SECRETS if k in form}) if form else None
    given = dict(parse_qsl(query or "", keep_blank_values=True)) if method == "GET" else {}
    return json.dumps(given) if given else None


@F.pandas_udf(StringType())
def kept_payload(method: pd.Series, content_type: pd.Series, body: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([_payload_of(*row) for row in zip(method, content_type, body, query, strict=True)], dtype=object)


def mask_requests(requests: DataFrame) -> DataFrame:
    """(id, ip_address, payload) of every request (id, method, content_type, body, query, forwarded_for, remote_addr).

    Writing requests keep their JSON or form with secrets masked at the top level, GET ones their parameters, others
    nothing; a body that isn't the JSON it says it is keeps nothing.  Only requests that can have a payload go to Python.
    """
    can = F.col("method").isin(*WRITING, "GET")
    of = lambda c: F.when(can, F.col(c))
    payload = kept_payload(of("method"), of("content_type"), of("body"), of("query"))
    return requests.select("id", client_ip(F.col("forwarded_for"), F.col("remote_addr")).alias("ip_address"), F.substring(payload, 1, PAYLOAD_CHARS).alias("payload"))
