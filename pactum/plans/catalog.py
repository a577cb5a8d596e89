"""Registered queries: operators bound to the domain tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions import names as N
from pactum.operators import analyses, approvals, audit, proofs, registrations, registry, signing_keys, text_ops, workflows
from pactum.plans import text_queries
from pactum.plans.twins import TWINS
from pactum.sources import files
from pactum.sources.domain import Domain, twin


def _now():
    """The moment that certificates are judged at."""
    return F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")


def _history_pages(d: Domain) -> DataFrame:
    out = None
    for mode in registry.HISTORY_ORDERS:
        page = registry.history_page(d["analysis_run"], mode)
        out = page if out is None else out.unionByName(page)
    return out


def _contract_tree(d: Domain) -> DataFrame:
    """The nested result laid flat: counts, and what the arrays hold in order."""
    tree = registry.contract_tree(d["contract"], d["version"], d["contract_file"], d["analysis_run"])
    joined = lambda kind, item: F.array_join(F.transform(F.filter("versions", lambda v: F.size(v[kind]) > 0), lambda v: F.array_join(F.transform(v[kind], item), ",")), "|")
    total = lambda kind: F.aggregate("versions", F.lit(0).cast("long"), lambda a, v: a + F.size(v[kind]))
    return tree.select(
        "id", "contract_code", F.size("versions").alias("versions"), total("files").alias("files"), joined("files", lambda f: f["file_path"]).alias("file_paths"),
        total("analyses").alias("analyses"), joined("analyses", lambda a: F.coalesce(a["overall_score"].cast("string"), F.lit("-"))).alias("scores"),
    )


def _reanalysis(d: Domain) -> DataFrame:
    again = d["analysis"].where("version_id % 4 = 1").select(F.col("version_id").alias("id"), "version_id", F.lit("again").alias("model_name"), "overall_score")
    return analyses.reanalysed(d["analysis_run"].select("id", "version_id", "model_name", "overall_score"), again)


def _reextract(d: Domain) -> DataFrame:
    old = d["clause"].select("id", "version_id")
    new = old.where("version_id % 3 = 1").select((F.col("id") + 10_000_000).alias("id"), "version_id")
    entities = d["clause"].select(F.col("id").alias("entity_id"), F.col("id").alias("clause_id"))
    return analyses.cascade(entities, analyses.reanalysed(old, new), "clause_id").select("entity_id", "clause_id")


def _analysis_list(d: Domain) -> DataFrame:
    told = F.transform("findings_preview", lambda r: F.concat_ws(":", r["risk_name"], r["risk_level"], r["severity_level"]))
    return analyses.analysis_list(d["analysis_run"], d["version"], d["contract"], d["run_finding"], d["rule"]).withColumn("findings_preview", F.array_join(told, "; "))


def _entity_spread(d: Domain) -> DataFrame:
    have = d["clause_entity"].where("entity_type = 'DATE_EXPIRE' AND clause_id % 2 = 0")
    have = have.select("clause_id", "entity_type", F.lit("v0").alias("entity_value"), F.lit("V0").alias("normalized_value"), F.lit(0.5).cast("decimal(5,2)").alias("confidence"))
    return analyses.spread_entities(d["api_entity"], d["clause"], have)


def _clause_order(d: Domain) -> DataFrame:
    kinds = F.explode(F.array(F.lit("PARTY"), F.lit("ACTION"))).alias("entity_type")
    return analyses.entity_order(d["clause"].select("id", kinds, F.col("title").alias("entity_value")), d["clause"])


def _replaced(d: Domain) -> tuple[DataFrame, DataFrame]:
    old = d["workflow_run"]
    new = old.where("version_id % 5 = 2").select((F.col("version_id") + 1_000_000).alias("id"), "version_id", F.lit("WF_NEW").alias("workflow_type")).distinct()
    return workflows.replaced_workflows(old, new, d["approval"].select("id", F.col("step_id").alias("workflow_id")))


def _step_roles(d: Domain) -> DataFrame:
    every = d.spark.createDataFrame([(n,) for n, _ in workflows.STEP_ROLES], "step_name string")
    return workflows.step_roles(d["step"].select("step_name").unionByName(every))


def _proof_upsert(d: Domain) -> DataFrame:
    return proofs.store_proofs(d["stored_proof"].where("version_id % 3 <> 0"), proofs.hash_proofs(d["document"]).where("version_id % 3 = 0"))


def _verification_log(d: Domain) -> DataFrame:
    """Two batches, the first of them run twice."""
    found, path = proofs.verify_proofs(d["document"], d["stored_proof"], d["chain_tx"]), files.shared_path(d.spark, "verifications")
    for batch, odd in (("morning", 1), ("evening", 0), ("morning", 1)):
        log = proofs.log_verifications(found.where(F.col("version_id") % 2 == odd), path, batch, user_id=odd + 7)
    return log


def _outcomes(d: Domain) -> DataFrame:
    return approvals.approval_outcomes(d["approval"].withColumnRenamed("status", "action"), d["workflow"], d["step"], d["dependency"])


def _staff_outcomes(d: Domain) -> DataFrame:
    return registrations.staff_registrations(d["staff_request"], d["anchored_staff"], d["company"], d["role"], d["ledger_answer"])


def _proof_history(d: Domain) -> DataFrame:
    nested = proofs.proof_history(d["stored_proof"], d["chain_tx"], d["chain_audit"])
    ids = F.array_join(F.transform("audits", lambda a: a["id"].cast("string")), ",")
    return nested.select("version_id", "tx_id", "status", F.size("audits").alias("audits"), ids.alias("audit_ids"))


def _blocks(d: Domain) -> DataFrame:
    return proofs.block_headers(d["block"].select(proofs.block_bytes(F.col("number"), F.col("previous_hash"), F.col("data_hash")).alias("block")))


def _file_gate(d: Domain) -> DataFrame:
    bare = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(F.col("page_id") % 4 == 0, "/a.PDF").when(F.col("page_id") % 4 == 1, "/b.docx").otherwise(""))
    named = d["pages"].select("page_id", bare.alias("path"), F.octet_length("html").alias("length"))
    return files.with_kinds(named).select("page_id", "ext", "file_type", "mime", "size_mb")


def _scan_flags(d: Domain) -> DataFrame:
    told = d["conversations"].select(F.col("conv_id").alias("doc_id"), "text", F.when(F.col("role") == "user", "ocr").otherwise("native").alias("source"), (F.col("turn") % 10 / 10).alias("confidence"))
    return text_ops.scan_flags(told)


def _law_articles(d: Domain) -> DataFrame:
    known = d["law"].select("law_name", "article_number")
    return text_ops.law_articles(known.unionByName(known.select("law_name", F.lit("Article X").alias("article_number"))), d["law"])


BOUND: dict[str, Callable[[Domain], DataFrame]] = {
    # contracts, companies and staff
    "contract_portfolio": lambda d: registry.contract_portfolio(d["contract"], d["version"], d["analysis"]),
    "contract_list": lambda d: registry.contract_list(d["contract"], d["version"], d["analysis"]),
    "contract_search": lambda d: registry.contract_search(d["contract"], "Draft"),
    "admin_contract_search": lambda d: registry.admin_search(d["contract"], "high agree", ("contract_code", "title", "contract_type"), status="APPROVED").select("id", "contract_code", "title"),
    "contract_kpis": lambda d: registry.contract_kpis(d["contract"], d["version"], d["analysis"]),
    "analysis_history": lambda d: registry.analysis_history(d["analysis"], d["version"], d["contract"], d["finding"], d["rule"]),
    "history_search": lambda d: registry.history_search(d["analysis"], d["version"], d["contract"], "agreement 1", "HIGH"),
    "history_pages": _history_pages,
    "history_kpis": lambda d: registry.history_kpis(d["analysis"]),
    "global_counts": lambda d: registry.global_counts(users=d["staff"], companies=d["company"], contracts=d["contract"], logs=d["request"]),
    "risk_catalog": lambda d: registry.contracts_by_rule(d["contract"], d["version"], d["finding"], d["rule"]),
    "company_directory": lambda d: registry.company_directory(d["company"]),
    "user_directory": lambda d: registry.user_directory(d["staff"], d["role"], d["company"]),
    "role_gate": lambda d: registry.role_gate(d["staff"], d["role"]),
    "audit_page": lambda d: registry.audit_page(d["request"], d["staff"], page=3),
    "tenant_scope": lambda d: registry.visible_companies(d["staff"], d["company"]),
    "company_scope": lambda d: registry.company_groups(d["company"]),
    "visible_contracts": lambda d: registry.visible_contracts(d["contract"], d["company"], d["staff"], user_id=5).select("id", "contract_code"),
    "tenant_company": lambda d: registry.tenant_companies(d["staff"]),
    "contract_access": lambda d: registry.access_counts(d["staff"], d["company"], d["contract"]),
    "contract_info_lookup": lambda d: registry.contract_info(d["workflow"].withColumn("version_id", F.col("id") * 8 + 3), d["version"], d["contract"]),
    "company_versions": lambda d: registry.company_versions(d["version"], d["contract"], d["staff"].select("company_id")),
    "latest_and_oldest": lambda d: registry.version_ends(d["version"]),
    "next_versions": lambda d: registry.next_versions(d["contract"], d["version"]),
    "previous_versions": lambda d: registry.previous_versions(d["version"]),
    "contract_tree": _contract_tree,
    "company_registration": lambda d: registrations.company_registrations(d["company_request"], d["company"], d["ledger_answer"]),
    "staff_registration": _staff_outcomes,
    "registered_staff": lambda d: registrations.stored_staff(d["staff_request"], _staff_outcomes(d)),
    "certificate_serials": lambda d: registry.certificate_serials(d["staff"], d["company"]),
    "safe_file_codes": lambda d: d["contract"].select("id", N.safe_file_code(F.col("title")).alias("code")),
    # analyses, findings, reviews and texts of versions
    "risk_score": lambda d: analyses.risk_scores(d["finding"]),
    "version_list": lambda d: analyses.version_list(d["version"], d["analysis_run"]),
    "version_files": lambda d: analyses.version_files(d["version"], d["contract_file"]),
    "finding_clause_match": lambda d: analyses.match_findings(d["api_finding"], d["clause"]),
    "rule_codes": lambda d: analyses.rule_codes(d["rule"]),
    "rule_get_or_create": lambda d: analyses.get_or_create_rules(d["api_finding"], d["rule"]),
    "rule_table": lambda d: analyses.with_new_rules(d["rule"], analyses.get_or_create_rules(d["api_finding"], d["rule"])),
    "summary_upsert": lambda d: analyses.upsert_summaries(d["summary_event"]),
    "review_outcomes": lambda d: analyses.review_outcomes(d["review"], d["analysis"]),
    "contract_status": lambda d: analyses.contract_status(d["contract"], d["contract_event"]),
    "reanalysis": _reanalysis,
    "reextract_cascade": _reextract,
    "analysis_list": _analysis_list,
    "entity_clear": lambda d: analyses.without_model_entities(d["clause_entity"], d["clause"], d["clause"].where("version_id % 2 = 1")),
    "entity_spread": _entity_spread,
    "clause_types": lambda d: analyses.clause_types(d["clause"]),
    "clause_order": _clause_order,
    "clause_texts": lambda d: analyses.first_clauses(d["clause"]),
    "raw_contents": lambda d: analyses.raw_contents(d["clause"].select("version_id").distinct(), d["page_text"], d["file_text"], d["clause"]),
    # workflows and keys
    "workflow_progress": lambda d: workflows.progress(d["workflow"], d["step"]),
    "workflow_kpis": lambda d: workflows.kpis(d["workflow"]),
    "blocked_steps": lambda d: workflows.blocked_steps(d["dependency"], d["step"]),
    "approvable_steps": lambda d: workflows.approvable_steps(d["dependency"], d["step"]),
    "reviewable_steps": lambda d: workflows.reviewable_steps(d["step"], d["workflow"]),
    "first_pending_step": lambda d: workflows.first_pending_steps(d["step"]),
    "step_renumber": lambda d: workflows.renumbered(d["step"], 3),
    "approval_outcomes": _outcomes,
    "approval_fold": lambda d: approvals.step_results(_outcomes(d), d["step"]),
    "approval_workflows": lambda d: approvals.workflow_results(_outcomes(d), d["workflow"]),
    "workflow_completion": lambda d: approvals.completion(d["step"]),
    "dependency_checks": lambda d: workflows.dependency_checks(d["edge_request"], d["step"], d["dependency"]),
    "step_signers": lambda d: workflows.step_signers(d["approval"], d["staff"], d["role"]),
    "anchor_steps": lambda d: workflows.anchor_steps(d["step"]),
    "default_workflow": lambda d: workflows.default_workflows(d["workflow"]),
    "step_roles": _step_roles,
    "latest_workflow": lambda d: workflows.latest_workflows(d["workflow_run"]),
    "workflow_replace": lambda d: _replaced(d)[0],
    "workflow_replace_signatures": lambda d: _replaced(d)[1].select("id", "workflow_id"),
    "key_lifecycle": lambda d: signing_keys.key_lifecycle(d["key_event"]),
    "key_outcomes": lambda d: signing_keys.key_outcomes(d["key_event"]),
    "active_keys": lambda d: workflows.active_keys(d["signing_key"]),
    "required_fields": lambda d: workflows.key_requests(d["key_request"]),
    # proofs, ledger and certificates
    "hash_proofs": lambda d: proofs.hash_proofs(d["document"]),
    "verify_proofs": lambda d: proofs.verify_proofs(d["document"], d["stored_proof"], d["chain_tx"]),
    "verification_log": _verification_log,
    "proof_upsert": _proof_upsert,
    "anchor_proofs": lambda d: proofs.anchor(d["stored_proof"], d["chain_tx"], d["ledger_answer"])[0],
    "anchor_audits": lambda d: proofs.anchor(d["stored_proof"], d["chain_tx"], d["ledger_answer"])[1],
    "latest_proof": lambda d: proofs.latest_proof(d["stored_proof"]).select("version_id", "document_hash"),
    "newest_proofs": lambda d: proofs.newest_proofs(d["stored_proof"]),
    "chain_stats": lambda d: proofs.chain_stats(d["chain_entry"], d["stored_proof"], d["certificate"], d["sign_request"]),
    "proof_history": _proof_history,
    "top_transactions": lambda d: proofs.top_transactions(d["approval"]),
    "ledger_stats": lambda d: proofs.ledger_stats(d["ledger"]),
    "ledger_history": lambda d: proofs.ledger_history(d["ledger"]),
    "ledger_put_if_absent": lambda d: proofs.put_if_absent(d["ledger"], d["company"].select(F.concat(F.lit("COMPANY_"), F.col("id").cast("string")).alias("record_key"))),
    "active_certificates": lambda d: proofs.active_certificates(d["certificate"], _now()),
    "signing_checks": lambda d: proofs.signing_checks(d["sign_request"], d["certificate"], _now()),
    "block_headers": _blocks,
    # audit log and files
    "audit_classify": lambda d: audit.classify(d["request"], d["contract"]),
    "audit_mask": lambda d: audit.mask_requests(d["request"]),
    "file_gate": _file_gate,
    "page_scan_flags": _scan_flags,
    "law_article_lookup": _law_articles,
}


def _query(operator: Callable[[Domain], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(Domain(spark, sf_dir))

    return run


QUERIES = {name: _query(operator) for name, operator in BOUND.items()} | text_queries.QUERIES
ORACLES = {name: twin(sql) for name, sql in TWINS.items()} | text_queries.ORACLES
