"""Risk analyses, findings, reviews, summaries, entities and the text of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.functions import names as N
from pactum.functions.text import strip
from pactum.operators.common import ordered_text, replaced_by_key, top_by

# Levels that a review may give, and the states that events lead a contract to.
REVIEW_LEVELS = ("LOW", "MEDIUM", "HIGH")
STATUS_AFTER = {"CREATE": "DRAFT", "ANALYZE": "ANALYZING", "ANALYZED": "ANALYZED", "FAILED": "DRAFT", "EXTRACT": "DRAFT", "NEW_VERSION": "DRAFT", "REVIEW": "APPROVED"}


def risk_scores(findings: DataFrame) -> DataFrame:
    """version_id, findings, overall_score, summary: the mean score of findings that have a severity, cut to an integer; 0 without any."""
    counted = F.when(F.col("severity") != "NONE", F.col("risk_score"))
    scored = findings.groupBy("version_id").agg(F.count("*").alias("findings"), F.floor(F.coalesce(F.avg(counted), F.lit(0.0))).cast("int").alias("overall_score"))
    told = F.concat(F.lit("Total "), F.col("findings").cast("string"), F.lit(" findings, score "), F.col("overall_score").cast("string"))
    return scored.withColumn("summary", told)


def latest_analyses(runs: DataFrame) -> DataFrame:
    """The newest analysis of each version by time, ties by id."""
    return top_by(runs, "version_id", F.desc("created_at"), F.desc("id"))


def oldest_analyses(runs: DataFrame) -> DataFrame:
    """The analysis of each version with the smallest id: what an unordered first row is."""
    return top_by(runs, "version_id", "id")


def version_list(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Versions with score and level of their oldest analysis ('NONE' without one), and score and model of their latest."""
    old = oldest_analyses(runs).select("version_id", F.col("overall_score").cast("double").alias("overall_score"), "risk_level")
    new = latest_analyses(runs).select("version_id", F.col("id").alias("latest_id"), F.col("overall_score").alias("latest_score"))
    v = versions.select(F.col("id").alias("version_id"), "contract_id", "version_number")
    return v.join(old, "version_id", "left").join(new, "version_id", "left").withColumn("risk_level", F.coalesce("risk_level", F.lit("NONE")))


def version_files(versions: DataFrame, files: DataFrame) -> DataFrame:
    """Each version with the file of the smallest id, its path below the media folder and its extension ('.pdf' for none)."""
    one = top_by(files, "version_id", "id").select("version_id", F.col("id").alias("file_id"), N.media_path(F.col("file_path")).alias("path"))
    ext = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    out = versions.select(F.col("id").alias("version_id")).join(one, "version_id", "left")
    return out.withColumn("ext", F.when(F.col("file_id").isNotNull(), F.when(ext == "", ".pdf").otherwise(ext)))


def match_findings(findings: DataFrame, clauses: DataFrame) -> DataFrame:
    """(finding_id, clause_id) within a version where the titles are equal or one holds the other, trimmed, case aside.

    Blank titles match blank titles only.  The version is the join key and the
    titles a condition on top, so the plan is a hash or merge join.
    """
    tidy = lambda c: F.lower(strip(F.coalesce(F.col(c), F.lit(""))))
    f = findings.select(F.col("id").alias("finding_id"), "version_id", tidy("clause_title").alias("told"))
    c = clauses.select(F.col("id").alias("clause_id"), "version_id", tidy("title").alias("own"))
    told, own = F.col("told"), F.col("own")
    match = (told == own) | (told != "") & (own != "") & (F.contains(own, told) | F.contains(told, own))
    return f.join(c, "version_id").where(match).select("finding_id", "clause_id")


def get_or_create_rules(wanted: DataFrame, rules: DataFrame, name: str = "risk_category", level: str = "risk_level") -> DataFrame:
    """rule_name, rule_code, severity, rule_id, created: for each wanted name, case and outer blanks aside, its rule or a new one.

    Of the stored rules of a name the one with the smallest id counts; a new
    one takes spelling and severity of the finding with the smallest id.
    """
    key = lambda c: F.lower(strip(F.col(c)))
    asked = top_by(wanted.withColumn("_key", key(name)), "_key", "id")
    have = rules.groupBy(F.lower("rule_name").alias("_key")).agg(F.min(F.struct("id", "rule_name")).alias("r"))
    joined = asked.join(have, "_key", "left")
    own = strip(F.col(name))
    return joined.select(
        F.coalesce("r.rule_name", own).alias("rule_name"), N.rule_code(F.coalesce("r.rule_name", own)).alias("rule_code"),
        F.when(F.col("r").isNull(), F.col(level)).alias("severity"), F.col("r.id").alias("rule_id"), F.col("r").isNull().alias("created"),
    )


def with_new_rules(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """The rules and the created ones behind them, numbered on from the highest id in order of their names."""
    fresh = asked.where("created")
    top = rules.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # new rules are few beside findings: one name each
    numbered = fresh.withColumn("n", F.row_number().over(Window.orderBy("rule_name"))).join(F.broadcast(top))
    added = numbered.select((F.col("top") + F.col("n")).alias("id"), "rule_name", F.concat(F.lit("Auto-created category for "), F.col("rule_name"), F.lit(".")).alias("description"))
    return rules.select("id", "rule_name", "description").unionByName(added)


def rule_codes(rules: DataFrame) -> DataFrame:
    """One row per rule name with its smallest id and both kinds of code."""
    names = rules.groupBy("rule_name").agg(F.min("id").alias("rule_id"))
    return names.select("rule_name", "rule_id", N.created_rule_code(F.col("rule_name")).alias("created_code"), N.rule_code(F.col("rule_name")).alias("rule_code"))


def upsert_summaries(events: DataFrame) -> DataFrame:
    """(version_id, summary, model_id): the last summary of each version, and the last model that was named."""
    named = F.when(F.col("model_id") != "", F.col("model_id"))
    return events.groupBy("version_id").agg(F.max_by("summary", "id").alias("summary"), F.max_by(named, F.when(named.isNotNull(), F.col("id"))).alias("model_id"))


def store_entities(entities: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing entities and those new by clause, type and value; of equal new ones the first by id stays."""
    key = ["clause_id", "entity_type", "entity_value"]
    fresh = top_by(entities.join(existing.select(*key), key, "left_anti"), key, "id")
    return existing.unionByName(fresh.select(*existing.columns))


def analysis_list(runs: DataFrame, versions: DataFrame, contracts: DataFrame, findings: DataFrame, rules: DataFrame, company_id: int | None = None, preview: int = 3) -> DataFrame:
    """Every analysis as its list shows it: contract, model, score, label, summary, number of findings, the first risks, and when.

    findings: (id, analysis_id, rule_id, risk_level); rules: (id, rule_name, severity).  The preview has the first
    finding, by id, of each risk name, and the first `preview` of these: (risk_name, risk_level, severity_level).  Only
    an analysis' distinct names are numbered, and its findings counted by partial sums.
    """
    v = versions.select(F.col("id").alias("version_id"), "contract_id")
    c = contracts.select(F.col("id").alias("contract_id"), "company_id", "contract_code", F.col("title").alias("contract_title"), F.col("status").alias("contract_status"))
    c = c if company_id is None else c.where(F.col("company_id") == company_id)
    counts = findings.groupBy("analysis_id").agg(F.count("*").alias("findings_count"))
    named = findings.join(rules.select(F.col("id").alias("rule_id"), "rule_name", "severity"), "rule_id")
    first = named.groupBy("analysis_id", "rule_name").agg(F.min(F.struct("id", "risk_level", "severity")).alias("f"))
    first = top_by(first.select("analysis_id", "rule_name", "f.*"), "analysis_id", "id", "rule_name", n=preview, place="place")
    shown = F.struct("place", F.struct(F.col("rule_name").alias("risk_name"), "risk_level", F.col("severity").alias("severity_level")).alias("r"))
    first = first.groupBy("analysis_id").agg(F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["r"]).alias("findings_preview"))
    score = F.coalesce(F.col("overall_score").cast("int"), F.lit(0))
    rows = runs.join(v, "version_id").join(c, "contract_id").withColumnRenamed("id", "analysis_id").join(counts, "analysis_id", "left").join(first, "analysis_id", "left")
    none = F.array().cast("array<struct<risk_name:string,risk_level:string,severity_level:string>>")
    return rows.select(
        F.col("analysis_id").alias("id"), "contract_id", "contract_code", "contract_title", "contract_status", "model_name", score.alias("overall_score"), N.risk_label(F.col("overall_score")).alias("risk_label"),
        "summary", F.coalesce("findings_count", F.lit(0)).alias("findings_count"), F.coalesce("findings_preview", none).alias("findings_preview"), N.minute(F.col("created_at")).alias("created_at"),
    )


# Types of entities that a model makes.
MODEL_TYPES = ("COMPANY_NAME", "TAX_CODE", "CONTRACT_VALUE", "DATE_EFFECTIVE", "DATE_EXPIRE")


def without_model_entities(entities: DataFrame, clauses: DataFrame, version_ids: DataFrame) -> DataFrame:
    """Entities (clause_id, entity_type) before some versions are extracted again: those that a model made for their clauses are gone."""
    again = clauses.join(version_ids.select("version_id").distinct(), "version_id", "left_semi").select(F.col("id").alias("clause_id"))
    made = again.withColumn("entity_type", F.explode(F.array(*map(F.lit, MODEL_TYPES))))
    return entities.join(made, ["clause_id", "entity_type"], "left_anti")


def spread_entities(found: DataFrame, clauses: DataFrame, existing: DataFrame) -> DataFrame:
    """existing (clause_id, entity_type, entity_value, normalized_value, confidence) and the entities of a model's answer.

    found: (id, version_id, clause_title, ...).  An entity goes to every clause of its version whose title matches as
    findings' do; of one clause, type and value what is there stays, and of new ones the first by id.
    """
    placed = found.join(match_findings(found, clauses).withColumnRenamed("finding_id", "id"), "id")
    return store_entities(placed.select("id", "clause_id", "entity_type", "entity_value", "normalized_value", F.coalesce("confidence", F.lit(1)).cast("decimal(5,2)").alias("confidence")), existing)


def entity_order(entities: DataFrame, clauses: DataFrame) -> DataFrame:
    """Entities of each version, numbered by clause, type and value."""
    c = clauses.select(F.col("id").alias("clause_id"), "version_id")
    joined = entities.select(F.col("id").alias("clause_id"), "entity_type", "entity_value").join(c, "clause_id")
    place = F.row_number().over(Window.partitionBy("version_id").orderBy("clause_id", "entity_type", "entity_value"))
    return joined.withColumn("position", place)


def review_outcomes(reviews: DataFrame, analyses: DataFrame) -> DataFrame:
    """(id, outcome, status): reviews of an analysis that is there, at a level that may be given, are stored and approve the contract."""
    known = analyses.select("version_id").distinct().withColumn("known", F.lit(True))
    joined = reviews.join(known, "version_id", "left")
    outcome = F.when(F.col("known").isNull(), "Analysis not found.").when(~F.coalesce(F.col("level").isin(*REVIEW_LEVELS), F.lit(False)), "Invalid risk level.").otherwise("stored")
    return joined.select("id", outcome.alias("outcome")).withColumn("status", F.when(F.col("outcome") == "stored", "APPROVED"))


def contract_status(contracts: DataFrame, events: DataFrame) -> DataFrame:
    """(id, status): what the last event, by time and id, leads to; the stored status where nothing happened."""
    moves = F.create_map(*[F.lit(x) for pair in STATUS_AFTER.items() for x in pair])
    last = events.groupBy("contract_id").agg(F.max_by("action", F.struct("happened_at", "id")).alias("action")).withColumnRenamed("contract_id", "id")
    return contracts.join(last, "id", "left").select("id", F.coalesce(F.try_element_at(moves, F.col("action")), F.col("status")).alias("status"))


def reanalysed(analyses: DataFrame, incoming: DataFrame) -> DataFrame:
    """Analyses after new ones: a version that is analysed again loses all it had."""
    return replaced_by_key(analyses, incoming, "version_id")


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there (key = the parent's id)."""
    return children.join(parents.select(F.col("id").alias(key)), key, "left_semi")


def clause_types(clauses: DataFrame) -> DataFrame:
    """(version_id, clause_types): distinct types of a version's clauses, in order, joined by commas; nulls left out."""
    distinct = clauses.where("clause_type is not null").select("version_id", "clause_type").distinct()
    return distinct.groupBy("version_id").agg(ordered_text(F.col("clause_type"), ",", "clause_type").alias("clause_types"))


def page_contents(pages: DataFrame) -> DataFrame:
    """(version_id, content): raw pages joined by a blank line, by id."""
    return pages.where(F.col("context_type") == "raw_text").groupBy("version_id").agg(ordered_text(F.coalesce("content", F.lit("")), "\n\n", "id").alias("content"))


def clause_contents(clauses: DataFrame, marked: bool = True) -> DataFrame:
    """(version_id, content): clauses joined by a blank line, by id; titles between dashes or bare."""
    title, body = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))
    one = F.concat(F.lit("--- "), title, F.lit(" ---\n"), body) if marked else F.concat(title, F.lit("\n"), body)
    return clauses.groupBy("version_id").agg(ordered_text(one, "\n\n", "id").alias("content"))


def raw_contents(version_ids: DataFrame, pages: DataFrame, files: DataFrame, clauses: DataFrame, marked: bool = True) -> DataFrame:
    """(version_id, content, origin): a version's text from its pages, else its file, else its clauses; '' if all are empty.

    `files` has the decrypted text of a version's file (version_id, content).
    """
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    out = version_ids.select("version_id")
    for name, df in (("pages", page_contents(pages)), ("file", files.select("version_id", "content")), ("clauses", clause_contents(clauses, marked))):
        out = out.join(df.withColumnRenamed("content", name), "version_id", "left")
    origin: Column = F.when(filled("pages").isNotNull(), "pages").when(filled("file").isNotNull(), "file").when(filled("clauses").isNotNull(), "clauses")
    return out.select("version_id", F.coalesce(filled("pages"), filled("file"), filled("clauses"), F.lit("")).alias("content"), origin.alias("origin"))


def first_clauses(clauses: DataFrame, most: int = 15, characters: int = 800) -> DataFrame:
    """The first clauses of each version by id, each cut to a number of characters: what a prompt holds."""
    return top_by(clauses, "version_id", "id", n=most).select("version_id", "id", F.substring("content", 1, characters).alias("content"))
