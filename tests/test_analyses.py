"""Lists of analyses, entities of a model's answer, and step texts, by hand."""

import datetime

from pyspark.sql import functions as F


def test_analysis_list(spark):
    from pactum.operators import analyses as A

    at = datetime.datetime(2024, 5, 6, 7, 8, 9)
    runs = spark.createDataFrame([(1, 10, "m", 79.99, "s", at), (2, 10, "n", None, None, at), (3, 11, "m", 80.0, "t", None)], "id long, version_id long, model_name string, overall_score double, summary string, created_at timestamp_ntz")
    versions = spark.createDataFrame([(10, 5), (11, 6)], "id long, contract_id long")
    contracts = spark.createDataFrame([(5, 1, "C-5", "five", "DRAFT"), (6, 2, "C-6", "six", "ANALYZED")], "id long, company_id long, contract_code string, title string, status string")
    # names in order of findings, not of rules; a name's first finding tells its level
    findings = [(9, 1, 1, "LOW"), (4, 1, 2, "HIGH"), (7, 1, 3, "LOW"), (5, 1, 4, "MEDIUM"), (6, 1, 2, "LOW"), (8, 1, 5, "LOW"), (1, 3, 9, "LOW")]
    rules = [(1, "alpha", "HIGH"), (2, "beta", "LOW"), (3, "gamma", "LOW"), (4, "beta", "HIGH"), (5, "delta", "LOW"), (9, "x", None)]
    got = A.analysis_list(runs, versions, contracts, spark.createDataFrame(findings, "id long, analysis_id long, rule_id long, risk_level string"), spark.createDataFrame(rules, "id long, rule_name string, severity string"))
    by = {r["id"]: r for r in got.collect()}
    assert [tuple(x) for x in by[1]["findings_preview"]] == [("beta", "HIGH", "LOW"), ("gamma", "LOW", "LOW"), ("delta", "LOW", "LOW")]
    assert (by[1]["findings_count"], by[1]["overall_score"], by[1]["risk_label"], by[1]["created_at"]) == (6, 79, "MEDIUM", "2024-05-06 07:08")
    assert (by[2]["findings_count"], by[2]["overall_score"], by[2]["risk_label"], by[2]["findings_preview"]) == (0, 0, "LOW", [])
    assert (by[3]["risk_label"], by[3]["contract_title"], by[3]["contract_status"], by[3]["created_at"]) == ("HIGH", "six", "ANALYZED", None)
    assert {r["id"] for r in A.analysis_list(runs, versions, contracts, got.sparkSession.createDataFrame(findings, "id long, analysis_id long, rule_id long, risk_level string"), spark.createDataFrame(rules, "id long, rule_name string, severity string"), company_id=2).collect()} == {3}


def test_entities_of_a_model(spark):
    from pactum.operators import analyses as A

    clauses = spark.createDataFrame([(1, 7, "Term"), (2, 7, "Long term"), (3, 8, "Term"), (4, 7, "")], "id long, version_id long, title string")
    have = spark.createDataFrame([(1, "TAX_CODE", "1"), (1, "PARTY", "p"), (2, "DATE_EXPIRE", "d"), (3, "TAX_CODE", "2"), (99, "TAX_CODE", "x")], "clause_id long, entity_type string, entity_value string")
    left = A.without_model_entities(have, clauses, spark.createDataFrame([(7,), (7,)], "version_id long"))
    assert sorted((r["clause_id"], r["entity_type"]) for r in left.collect()) == [(1, "PARTY"), (3, "TAX_CODE"), (99, "TAX_CODE")]
    found = [(5, 7, "TERM ", "TAX_CODE", "1", "n", 0.5), (6, 7, "term", "TAX_CODE", "9", "first", None), (7, 7, "Term", "TAX_CODE", "9", "second", 0.25), (8, 7, None, "X", "y", None, 0.75), (9, 9, "Term", "X", "z", None, 0.75)]
    full = have.where("clause_id = 1 AND entity_type = 'TAX_CODE'").withColumns({"normalized_value": F.lit("kept"), "confidence": F.lit(0.1).cast("decimal(5,2)")})
    out = A.spread_entities(spark.createDataFrame(found, "id long, version_id long, clause_title string, entity_type string, entity_value string, normalized_value string, confidence double"), clauses, full)
    assert sorted((r["clause_id"], r["entity_type"], r["entity_value"], r["normalized_value"], float(r["confidence"])) for r in out.collect()) == [
        (1, "TAX_CODE", "1", "kept", 0.1), (1, "TAX_CODE", "9", "first", 1.0), (2, "TAX_CODE", "1", "n", 0.5), (2, "TAX_CODE", "9", "first", 1.0), (4, "X", "y", None, 0.75)]


def test_step_texts_go_through_anchoring(spark):
    from pactum.operators import workflows as W

    steps = [(1, 1, 1, "Dự thảo chung", 4, "own"), (2, 1, 2, "Ký kết", 4, "gone"), (3, 1, 3, "Rà soát", 7, None), (4, 2, 1, "Giám đốc duyệt", 3, "by the director")]
    got = W.anchor_steps(spark.createDataFrame(steps, "id long, workflow_id long, step_order int, step_name string, role_id int, description string"))
    told = {w: [(r["step_order"], r["description"]) for r in sorted(got.where(F.col("workflow_id") == w).collect(), key=lambda r: r["step_order"])] for w in (1, 2)}
    assert told[1] == [(1, "own"), (2, ""), (3, W.APPROVAL_TEXT), (4, W.CLOSING_TEXTS[0]), (5, W.CLOSING_TEXTS[1])]
    assert told[2] == [(1, W.INTAKE_TEXT), (2, "by the director"), (3, W.CLOSING_TEXTS[0]), (4, W.CLOSING_TEXTS[1])]
