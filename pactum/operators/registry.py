"""Contracts, companies and staff: lists, searches, counts and who may see what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions import names as N
from pactum.operators.common import broadcast_if_small, count_when, ordered_text, rounded, top_by

# Words of a group of companies that see each other, roles that manage.
BRANDS = ("fpt", "techcom", "vin", "viettel")
MANAGING = ("MANAGER", "ADMIN")
# Companies that stand together in a run of rows (a small part of a page of a columnar file, and whole bytes whatever
# an index takes), that one list is made of, and that one task has; users that meet a run at a time.
RUN, LIST, TASK_COMPANIES, SLICE = 128, 8192, 1024, 1024


def latest_versions(versions: DataFrame) -> DataFrame:
    """contract_id, version_id, version_number: the highest number, ties by id."""
    return top_by(versions, "contract_id", F.desc("version_number"), F.desc("id")).select("contract_id", F.col("id").alias("version_id"), "version_number")


def contract_scores(contracts: DataFrame, versions: DataFrame, analyses: DataFrame) -> DataFrame:
    """All contracts with version_id, version_number and overall_score of their latest version, null where there is none."""
    latest = latest_versions(versions).withColumnRenamed("contract_id", "id")
    return contracts.join(latest, "id", "left").join(analyses.select("version_id", "overall_score"), "version_id", "left")


def contract_portfolio(contracts: DataFrame, versions: DataFrame, analyses: DataFrame) -> DataFrame:
    """Contracts with latest version, score and label; a value of zero shows as null."""
    value = F.when(F.col("contract_value") != 0, F.col("contract_value"))
    label = F.when(F.col("overall_score").isNotNull(), N.risk_label(F.col("overall_score")))
    return contract_scores(contracts, versions, analyses).select("id", "contract_code", "title", "status", value.alias("contract_value"), "created_at", "version_number", "overall_score", label.alias("risk_label"))


def contract_list(contracts: DataFrame, versions: DataFrame, analyses: DataFrame, company_id: int | None = None) -> DataFrame:
    """Contracts as a view shows them: dates as text, the value as a double and null for zero; of one company if it is given."""
    if company_id is not None:
        contracts = contracts.where(F.col("company_id") == company_id)
    value = F.when(F.col("contract_value") != 0, F.col("contract_value").cast("double"))
    return contract_scores(contracts, versions, analyses).select(
        "id", "contract_code", "title", "contract_type", N.iso_day(F.col("start_date")).alias("start_date"), N.iso_day(F.col("end_date")).alias("end_date"),
        value.alias("contract_value"), "status", F.col("overall_score").cast("int").alias("risk_score"), N.iso_moment(F.col("created_at")).alias("created_at"),
    )


def contract_search(contracts: DataFrame, text: str) -> DataFrame:
    """Contracts whose code, title or status holds the text, case aside; all for an empty text."""
    return contracts.where(N.contains_any(text, F.col("contract_code"), F.col("title"), F.col("status"))).select("id", "contract_code", "title", "status")


def admin_search(rows: DataFrame, terms: str, fields: tuple[str, ...], **filters) -> DataFrame:
    """Rows that hold every word of `terms` in some field and equal every filter."""
    found = rows.where(N.holds_all_terms(terms, *[F.col(c) for c in fields]))
    for column, value in filters.items():
        found = found.where(F.col(column) == value)
    return found


def contract_kpis(contracts: DataFrame, versions: DataFrame, analyses: DataFrame) -> DataFrame:
    """total, high_risk (score from 80), pending (status ANALYZED)."""
    scored = contract_scores(contracts, versions, analyses)
    return scored.agg(F.count("*").alias("total"), count_when(F.col("overall_score") >= 80).alias("high_risk"), count_when(F.col("status") == "ANALYZED").alias("pending"))


def analysis_history(analyses: DataFrame, versions: DataFrame, contracts: DataFrame, findings: DataFrame, rules: DataFrame, top: int = 3) -> DataFrame:
    """Analyses with contract, label, and the first `top` distinct risk names in order of their findings."""
    named = findings.join(rules.select(F.col("id").alias("rule_id"), "rule_name"), "rule_id").groupBy("version_id", "rule_name").agg(F.min("id").alias("first"))
    first = top_by(named, "version_id", "first", "rule_name", n=top, place="place").groupBy("version_id").agg(ordered_text(F.col("rule_name"), "; ", "place").alias("risk_names"))
    scored = with_contract(analyses, versions, contracts).withColumn("risk_label", N.risk_label(F.col("overall_score")))
    return scored.join(first, "version_id", "left").select("version_id", "contract_code", "findings", "overall_score", "risk_label", F.coalesce("risk_names", F.lit("")).alias("risk_names"))


def with_contract(analyses: DataFrame, versions: DataFrame, contracts: DataFrame) -> DataFrame:
    """Analyses with contract_id, contract_code, title and company_id, by way of their version."""
    v = versions.select(F.col("id").alias("version_id"), "contract_id")
    c = contracts.select(F.col("id").alias("contract_id"), "contract_code", "title", "company_id")
    return analyses.join(v, "version_id").join(c, "contract_id")


def history_search(analyses: DataFrame, versions: DataFrame, contracts: DataFrame, text: str = "", label: str = "ALL", company_id: int | None = None) -> DataFrame:
    """Analyses of a label (or ALL) whose contract's code or title holds the text, of one company if it is given."""
    rows = with_contract(analyses, versions, contracts).where(N.contains_any(text, F.col("contract_code"), F.col("title")))
    if label != "ALL":
        rows = rows.where(N.risk_label(F.col("overall_score")) == label)
    if company_id is not None:
        rows = rows.where(F.col("company_id") == company_id)
    return rows.orderBy(F.desc("overall_score"), "version_id").select("contract_code", "title", "overall_score")


#: How a history may be sorted; rows that tie keep the order newest first.
HISTORY_ORDERS = {
    "newest": (F.desc, "created_at", F.desc),
    "oldest": (F.asc, "created_at", F.desc),
    "score-desc": (F.desc, "overall_score", F.desc),
    "score-asc": (F.asc, "overall_score", F.desc),
}


def history_page(runs: DataFrame, mode: str = "newest", rows: int = 50) -> DataFrame:
    """The first rows of the analyses in one of four orders; no score counts as 0."""
    if mode not in HISTORY_ORDERS:
        raise ValueError(f"unknown order {mode!r}")
    way, column, then = HISTORY_ORDERS[mode]
    scored = runs.withColumn("overall_score", F.coalesce("overall_score", F.lit(0)))
    return scored.orderBy(way(column), then("created_at"), then("id")).limit(rows).select(F.lit(mode).alias("mode"), "id", "overall_score", "created_at")


def history_kpis(analyses: DataFrame) -> DataFrame:
    mean = rounded(F.coalesce(F.avg("overall_score"), F.lit(0.0)))
    return analyses.agg(F.count("*").alias("total"), count_when(F.col("overall_score") >= 80).alias("high_count"), mean.alias("mean_score"))


def global_counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table, under its name."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out


def contracts_with_rule(contracts: DataFrame, versions: DataFrame, findings: DataFrame, rules: DataFrame, word: str) -> DataFrame:
    """Contracts of which some version has a finding under a rule whose name holds the word."""
    hit = findings.join(rules.where(N.contains_any(word, F.col("rule_name"))).select(F.col("id").alias("rule_id")), "rule_id", "left_semi")
    ids = versions.select(F.col("id").alias("version_id"), "contract_id").join(hit, "version_id", "left_semi").select(F.col("contract_id").alias("id"))
    return contracts.join(ids, "id", "left_semi").select("id", "title", "contract_code")


def contracts_by_rule(contracts: DataFrame, versions: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_name, id, contract_code): the contracts in which each rule was found, each once."""
    named = findings.join(rules.select(F.col("id").alias("rule_id"), "rule_name"), "rule_id").select("version_id", "rule_name").distinct()
    pairs = named.join(versions.select(F.col("id").alias("version_id"), F.col("contract_id").alias("id")), "version_id").select("rule_name", "id").distinct()
    return pairs.join(contracts.select("id", "contract_code"), "id").select("rule_name", "id", "contract_code")


def company_directory(companies: DataFrame) -> DataFrame:
    """One company per tax code, or per name where it has none, case and blanks aside: first by name, newest id."""
    key = F.lower(F.trim(F.coalesce(F.nullif(F.col("tax_code"), F.lit("")), F.col("company_name"))))
    return top_by(companies.withColumn("_key", key), "_key", "company_name", F.desc("id")).select("id", "company_name", "tax_code")


def user_directory(staff: DataFrame, roles: DataFrame, companies: DataFrame) -> DataFrame:
    r, c = roles.select(F.col("id").alias("role_id"), "role_name"), companies.select(F.col("id").alias("company_id"), "company_name")
    joined = staff.join(r, "role_id", "left").join(c, "company_id", "left")
    return joined.select("id", "user_name", F.coalesce("role_name", F.lit("N/A")).alias("role_name"), F.coalesce("company_name", F.lit("N/A")).alias("company_name"))


def role_gate(staff: DataFrame, roles: DataFrame, allowed: tuple[str, ...] = MANAGING) -> DataFrame:
    """Staff whose role, in capitals, is one of the allowed."""
    r = roles.where(F.upper("role_name").isin(*allowed)).select(F.col("id").alias("role_id"))
    return staff.join(r, "role_id", "left_semi").select("id", "user_name")


def page_of(rows: DataFrame, page: int, *order: Column, size: int = 10) -> DataFrame:
    """Rows of a page, from 1, in an order, with the number of pages (1 if there are no rows)."""
    if page < 1:
        raise ValueError("pages count from 1")
    pages = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).join(F.broadcast(pages))


def audit_page(requests: DataFrame, staff: DataFrame, page: int = 1) -> DataFrame:
    """A page of the log, newest first, with user names."""
    paged = page_of(requests, page, F.desc("created_at"), F.desc("id"))
    return paged.join(staff.select(F.col("id").alias("user_id"), "user_name"), "user_id", "left").select("id", "path", F.coalesce("user_name", F.lit("System")).alias("user_name"), "pages")


#: The group of those who see every company, and of what belongs to none.
ALL = "all"


def brand_words(name: Column) -> Column:
    """The brand words that a company's name holds, as names of groups."""
    return F.array_compact(F.array(*[F.when(F.contains(F.lower(name), F.lit(b)), F.lit(f"brand:{b}")) for b in BRANDS]))


def staff_groups(staff: DataFrame, companies: DataFrame) -> DataFrame:
    """(user_id, access): the groups whose companies a user may see: all for superusers and users without a company,
    else the user's own company (with a row or not) and the brand words of its name."""
    named = staff.join(companies.select(F.col("id").alias("company_id"), "company_name"), "company_id", "left")
    own = F.concat(F.array(F.concat(F.lit("company:"), F.col("company_id").cast("string"))), F.coalesce(brand_words(F.col("company_name")), F.array()))
    groups = F.when(F.col("is_superuser") | F.col("company_id").isNull(), F.array(F.lit(ALL))).otherwise(own)
    return named.select(F.col("id").alias("user_id"), F.explode(groups).alias("access"))


def company_groups(companies: DataFrame) -> DataFrame:
    """(company_id, access): the groups that see a company: all, its own, and those of its brand words."""
    own = F.concat(F.lit("company:"), F.col("id").cast("string"))
    return companies.select(F.col("id").alias("company_id"), F.explode(F.concat(F.array(F.lit(ALL), own), brand_words(F.col("company_name")))).alias("access"))


def met_in_runs(users: DataFrame, companies: DataFrame, slices: int, *kinds: str, condition: Column | None = None) -> DataFrame:
    """(user_id, company_id): every row of users beside every row of companies where the condition on the kinds holds, in runs.

    Companies of equal kinds stand in arrays of at most RUN, cut from lists of some LIST companies by a hash of the id,
    so rows that repeat an id are in one list; a slice of the users meets one array at a time.
    """
    n = companies.count()
    # a few megabytes of companies make billions of pairs, so they are dealt over all cores, whatever file they come from
    tasks = max(4 * companies.sparkSession.sparkContext.defaultParallelism, n // TASK_COMPANIES)
    # collect_list leaves nulls out
    nulls = F.array_repeat(F.lit(None).cast(companies.schema["company_id"].dataType), (F.count("*") - F.count("company_id")).cast("int"))
    lists = companies.groupBy(F.pmod(F.xxhash64("company_id"), F.lit(n // LIST + 1)).alias("_list"), *kinds).agg(F.concat(F.collect_list("company_id"), nulls).alias("ids"))
    cut = F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(RUN)), lambda k: F.slice("ids", k, RUN))
    runs = lists.select(F.explode(cut).alias("ids"), *kinds).repartition(tasks)
    # what one row gives in a stage of compiled code is held until it is read; coalesce() moves nothing, but such a stage
    # ends there, so the next one holds the pairs of one run and one slice
    tiles = runs.withColumn("_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))).coalesce(tasks)
    users = broadcast_if_small(users.withColumn("_slice", F.pmod(F.xxhash64("user_id"), F.lit(slices))))
    met = F.col("_slice") == F.col("_tile")
    return tiles.join(users, met if condition is None else met & condition).select("user_id", F.explode("ids").alias("company_id"))


def visible_companies(staff: DataFrame, companies: DataFrame) -> DataFrame:
    """(user_id, company_id): every company that a user sees: all for superusers and users without a company, else the
    user's own (if it has a row) and those that share a brand word with it.

    Those who see everything meet all companies, which is every pair by its meaning; the rest are joined on their own
    company, and meet those that share a word with it.  An own company that shares one is met there, so each pair comes
    from one place and none has to be found again.  Users meet companies in runs: rows come with one user
    beside the same few companies, then the next user beside them, which columnar files store in a tenth of a byte
    a row, where a row for each user beside one company takes some four with 60,000 users.
    """
    words = companies.select(F.col("id").alias("company_id"), brand_words(F.col("company_name")).alias("words"))
    own_words = words.withColumnsRenamed({"company_id": "own", "words": "own_words"})
    people = staff.select(F.col("id").alias("user_id"), F.col("company_id").alias("own"), "is_superuser").join(own_words, "own", "left")
    sees_all = F.coalesce("is_superuser", F.lit(False)) | F.col("own").isNull()
    slices = staff.count() // SLICE + 1
    everything = met_in_runs(people.where(sees_all).select("user_id"), words.select("company_id"), slices)
    rest = people.where(~sees_all & F.col("own_words").isNotNull())
    shared = F.arrays_overlap("own_words", "words")
    own = rest.join(words, F.col("own") == F.col("company_id")).where(~shared).select("user_id", "company_id")
    branded = rest.where(F.size("own_words") > 0).select("user_id", "own_words")
    by_brand = met_in_runs(branded, words.where(F.size("words") > 0), slices, "words", condition=shared)
    return everything.unionByName(own).unionByName(by_brand)


def visible_contracts(contracts: DataFrame, companies: DataFrame, staff: DataFrame, user_id: int) -> DataFrame:
    """The contracts that one user may open: those of no company, and those whose company is in one of the user's groups.

    A user's groups are a handful and filter companies, and companies filter contracts: no pair of a user and a company
    is made.
    """
    groups = [r["access"] for r in staff_groups(staff.where(F.col("id") == user_id), companies).collect()]
    if ALL in groups or not groups:
        return contracts.where(F.lit(bool(groups)))
    seen = company_groups(companies).where(F.col("access").isin(groups)).select("company_id").distinct().withColumn("_seen", F.lit(True))
    # the own company counts with a row or without
    own = F.concat(F.lit("company:"), F.col("company_id").cast("string")).isin(groups)
    return contracts.join(seen, "company_id", "left").where(F.col("company_id").isNull() | own | F.col("_seen").isNotNull()).select(*contracts.columns)


def tenant_companies(staff: DataFrame) -> DataFrame:
    """(user_id, company_id): the company that a user's lists are limited to; null means all."""
    return staff.select(F.col("id").alias("user_id"), F.when(~F.col("is_superuser"), F.col("company_id")).alias("company_id"))


def access_counts(staff: DataFrame, companies: DataFrame, contracts: DataFrame) -> DataFrame:
    """(user_id, contracts): how many contracts each user may open.  A contract without a company is open to all.

    Contracts are counted by company, and by the set of brand words of their company, of which there are at most 16.
    A user sees the sum of the sets that share a word with the own company's, or the own company's count where it has
    no word, or all: users meet 16 sums and one count, never the companies.
    """
    words = companies.select(F.col("id").alias("company_id"), brand_words(F.col("company_name")).alias("words"))
    per_company = contracts.where("company_id is not null").groupBy("company_id").agg(F.count("*").alias("n"))
    per_set = per_company.join(words, "company_id").where(F.size("words") > 0).groupBy("words").agg(F.sum("n").alias("n"))
    sums = per_set.agg(F.collect_list(F.struct("words", "n")).alias("sets"))
    totals = contracts.agg(F.count("*").alias("every"), count_when(F.col("company_id").isNull()).alias("free"))
    rows = staff.select(F.col("id").alias("user_id"), "company_id", "is_superuser").join(words, "company_id", "left").join(per_company, "company_id", "left")
    rows = rows.join(F.broadcast(sums)).join(F.broadcast(totals))
    shared = F.aggregate(F.filter("sets", lambda s: F.arrays_overlap(s["words"], F.col("words"))), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    limited = F.when(F.size(F.coalesce("words", F.array())) > 0, shared).otherwise(F.coalesce("n", F.lit(0))) + F.col("free")
    return rows.select("user_id", F.when(F.col("is_superuser") | F.col("company_id").isNull(), F.col("every")).otherwise(limited).alias("contracts"))


def contract_info(workflows: DataFrame, versions: DataFrame, contracts: DataFrame) -> DataFrame:
    """Each workflow's contract code and version number by its version; '' and 1 where that leads nowhere."""
    v = versions.select(F.col("id").alias("version_id"), "contract_id", "version_number").join(contracts.select(F.col("id").alias("contract_id"), "contract_code"), "contract_id", "left")
    return workflows.join(v, "version_id", "left").select(F.col("id").alias("workflow_id"), F.coalesce("contract_code", F.lit("")).alias("contract_code"), F.coalesce("version_number", F.lit(1)).alias("version_number"))


def company_versions(versions: DataFrame, contracts: DataFrame, companies: DataFrame | list[int]) -> DataFrame:
    """Versions of the contracts of some companies: a list of ids, or a table with a column company_id."""
    ours = contracts.where(F.col("company_id").isin(*companies)) if isinstance(companies, list) else contracts.join(companies.select("company_id"), "company_id", "left_semi")
    return versions.join(ours.select(F.col("id").alias("contract_id")), "contract_id", "left_semi").select(F.col("id").alias("version_id"))


def version_ends(versions: DataFrame) -> DataFrame:
    """Latest and oldest version and the next number of each contract that has versions."""
    newest, oldest = F.struct("version_number", "id"), F.struct("id")
    return versions.groupBy("contract_id").agg(F.max(newest)["id"].alias("latest_version"), F.min(oldest)["id"].alias("oldest_version"), (F.max("version_number") + 1).alias("next_number"))


def next_versions(contracts: DataFrame, versions: DataFrame) -> DataFrame:
    """(contract_id, next_number) of every contract; 1 where there is no version yet."""
    top = versions.groupBy("contract_id").agg(F.max("version_number").alias("top"))
    return contracts.select(F.col("id").alias("contract_id")).join(top, "contract_id", "left").select("contract_id", (F.coalesce("top", F.lit(0)) + 1).alias("next_number"))


def previous_versions(versions: DataFrame) -> DataFrame:
    """Each version with that of the same contract and the number before; null across gaps."""
    before = versions.select("contract_id", (F.col("version_number") + 1).alias("version_number"), F.col("id").alias("previous_id"))
    return versions.join(before, ["contract_id", "version_number"], "left").select(F.col("id").alias("version_id"), "previous_id")


def contract_tree(contracts: DataFrame, versions: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """Contracts with an array of their versions, each with arrays of its files and analyses, all by id.

    Every level is grouped on its parent before it is joined, so no level multiplies another.
    """
    nest = lambda df, key, name, *cols: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    leaf = versions.withColumnRenamed("id", "version_id")
    leaf = leaf.join(nest(files, "version_id", "files", "id", "file_path"), "version_id", "left").join(nest(runs, "version_id", "analyses", "id", "overall_score"), "version_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array())
    leaf = leaf.withColumn("files", empty("files")).withColumn("analyses", empty("analyses"))
    tree = nest(leaf, "contract_id", "versions", "version_number", "version_id", "files", "analyses").withColumnRenamed("contract_id", "id")
    return contracts.select("id", "contract_code").join(tree, "id", "left").withColumn("versions", empty("versions"))


def certificate_serials(staff: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, serial) for staff with a company."""
    c = broadcast_if_small(companies.select(F.col("id").alias("company_id"), "company_name"))
    return staff.join(c, "company_id").select("id", N.certificate_serial(F.col("company_name"), F.col("id")).alias("serial"))
