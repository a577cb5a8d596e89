"""Approval workflows: progress, gates, folds of approvals, step building, dependencies and signing keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.functions import names as N
from pactum.functions.text import any_of
from pactum.operators.common import count_when, is_approved, replaced_by_key, rounded, top_by

# Words that mark kinds of steps, standard steps, and the roles of named steps.
INTAKE_WORDS = ("sơ bộ", "đầu tiên", "tổng quan", "tiếp nhận", "dự thảo", "đăng ký", "kiểm tra ban đầu")
CLOSING_WORDS = ("ký kết", "signing", "lưu trữ", "archive")
APPROVAL_WORDS = ("phê duyệt", "chủ trương", "quản lý", "giám đốc", "ban điều hành")
APPROVAL_ROLES = (5, 11)
INTAKE_STEP = ("Rà soát & Tiếp nhận Dự thảo Hợp đồng", 4)
INTAKE_TEXT = "Kiểm tra tính đầy đủ của hồ sơ dự thảo, tư cách pháp nhân các bên và hình thức hợp đồng."
APPROVAL_STEP = ("Phê duyệt Chủ trương & Phương án Thực hiện Cấp Quản lý", 5)
APPROVAL_TEXT = "Cấp quản lý trực tiếp xét duyệt phương án triển khai, chi phí và định hướng hợp đồng."
CLOSING_STEPS = (("Thực hiện Ký kết Hợp đồng Chính thức", 4), ("Bàn giao Bản cứng & Lưu trữ Kho Hồ sơ Hợp đồng", 4))
CLOSING_TEXTS = (
    "Đại diện có thẩm quyền của các bên thực hiện ký kết hợp đồng bằng chữ ký số.",
    "Lưu trữ bản hợp đồng chính thức và các tài liệu bàn giao liên quan vào hệ thống quản lý.",
)
DEFAULT_STEPS = (INTAKE_STEP, ("Phê duyệt Chủ trương Cấp Quản lý", 5), CLOSING_STEPS[0], ("Bàn giao & Lưu trữ Kho Hồ sơ Hợp đồng", 4))
STEP_ROLES = (
    ("Contract Negotiation", 4), ("Legal Review", 4), ("Technical Review", 7), ("Security Review", 8), ("Compliance Review", 9), ("Finance Review", 6),
    ("Procurement Review", 10), ("Manager Approval", 5), ("Director Approval", 11), ("Executive Approval", 11), ("Contract Signing", 4), ("Document Archive", 4),
)
BOARD_CLOSING, BOARD_MANAGER, BOARD_HANDOVER = ("ký kết hợp đồng", "lưu trữ kho hồ sơ"), ("phê duyệt cấp quản lý", "ban điều hành"), ("bàn giao bản cứng",)


def progress(workflows: DataFrame, steps: DataFrame) -> DataFrame:
    """Steps, approved ones and their share in percent of every workflow; 0 without steps."""
    counted = steps.groupBy("workflow_id").agg(F.count("*").alias("steps"), count_when(is_approved()).alias("approved")).withColumnRenamed("workflow_id", "id")
    out = workflows.select("id", "status").join(counted, "id", "left").fillna(0, ["steps", "approved"])
    return out.withColumn("progress", F.when(F.col("steps") == 0, 0).otherwise(rounded(100.0 * F.col("approved") / F.col("steps"))))


def kpis(workflows: DataFrame) -> DataFrame:
    return workflows.agg(F.count("*").alias("total"), *[count_when(F.col("status") == s).alias(s.lower()) for s in ("PENDING", "IN_PROGRESS", "COMPLETED")])


def unmet(dependencies: DataFrame, steps: DataFrame) -> DataFrame:
    """(prerequisite_id, dependent_id) where the prerequisite isn't approved."""
    open_steps = steps.where(~is_approved()).select(F.col("id").alias("prerequisite_id"))
    return dependencies.join(open_steps, "prerequisite_id", "left_semi").select("prerequisite_id", "dependent_id")


def blocked_steps(dependencies: DataFrame, steps: DataFrame) -> DataFrame:
    return unmet(dependencies, steps).groupBy(F.col("dependent_id").alias("step_id")).agg(F.count("*").alias("unmet"))


def approvable_steps(dependencies: DataFrame, steps: DataFrame) -> DataFrame:
    """Pending steps whose prerequisites are all approved."""
    blocked = unmet(dependencies, steps).select(F.col("dependent_id").alias("id"))
    return steps.where(F.col("status") == "PENDING").join(blocked, "id", "left_anti").select("id")


def reviewable_steps(steps: DataFrame, workflows: DataFrame) -> DataFrame:
    """(id, workflow_id, step_order, reviewable): whether the board offers a step for review.

    The first step is free; others wait for the first.  A manager's step waits
    for all middle steps but itself, closing and hand-over steps for all before
    them, all others run in parallel.
    """
    name = F.lower("step_name")
    by_order = Window.partitionBy("workflow_id").orderBy("step_order")
    done, pending = is_approved(), F.col("status") == "PENDING"
    w = workflows.select(F.col("id").alias("workflow_id"), F.col("status").alias("workflow_status"))
    rows = steps.join(w, "workflow_id").select(
        "*", any_of(name, BOARD_CLOSING).alias("closing"), (F.col("role_id").isin(*APPROVAL_ROLES) | any_of(name, BOARD_MANAGER)).alias("manager"),
        any_of(name, BOARD_HANDOVER).alias("handover"), done.alias("done"), F.row_number().over(by_order).alias("place"), F.first("status").over(by_order).alias("first_status"),
        F.coalesce(F.sum((~done).cast("int")).over(by_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("open_before"),
    )
    middle = ~F.col("done") & (F.col("place") > 1) & ~F.col("closing")
    open_middle = F.sum(middle.cast("int")).over(Window.partitionBy("workflow_id"))
    own = (~F.col("closing") & ~F.col("done")).cast("int")
    gate = F.when(F.col("manager"), F.col("open_middle") - own == 0).when(F.col("closing") | F.col("handover"), F.col("open_before") == 0).otherwise(True)
    live = pending & F.col("workflow_status").isin("PENDING", "IN_PROGRESS")
    free = (F.col("place") == 1) | (F.col("first_status") == "APPROVED") & gate
    return rows.withColumn("open_middle", open_middle).select("id", "workflow_id", "step_order", (live & free).alias("reviewable"))


def first_pending_steps(steps: DataFrame) -> DataFrame:
    return top_by(steps.where(F.col("status") == "PENDING"), "workflow_id", "step_order").select("workflow_id", F.col("id").alias("step_id"))


def renumbered(steps: DataFrame, at: int) -> DataFrame:
    """Step orders after a step is put in at a place, after the one there is taken out, and counted anew from 1."""
    o = F.col("step_order")
    anew = F.row_number().over(Window.partitionBy("workflow_id").orderBy("step_order"))
    return steps.select("id", "workflow_id", F.when(o >= at, o + 1).otherwise(o).alias("after_insert"), F.when(o > at, o - 1).otherwise(o).alias("after_delete"), anew.alias("reindexed"))


def dependency_checks(requests: DataFrame, steps: DataFrame, existing: DataFrame) -> DataFrame:
    """Each requested edge with its outcome: self, missing, other workflow, cycle of two, known, or created.  Longer cycles are let through."""
    s = steps.select("id", "workflow_id")
    a, b = s.toDF("prerequisite_id", "workflow_a"), s.toDF("dependent_id", "workflow_b")
    back = existing.select(F.col("dependent_id").alias("prerequisite_id"), F.col("prerequisite_id").alias("dependent_id")).distinct().withColumn("back", F.lit(True))
    have = existing.select("prerequisite_id", "dependent_id").distinct().withColumn("have", F.lit(True))
    edge = ["prerequisite_id", "dependent_id"]
    rows = requests.join(a, "prerequisite_id", "left").join(b, "dependent_id", "left").join(back, edge, "left").join(have, edge, "left")
    outcome = (
        F.when(F.col("prerequisite_id") == F.col("dependent_id"), "self").when(F.col("workflow_a").isNull() | F.col("workflow_b").isNull(), "missing")
        .when((F.col("workflow_a") != F.col("workflow_id")) | (F.col("workflow_b") != F.col("workflow_id")), "other workflow")
        .when(F.col("back").isNotNull(), "cycle").when(F.col("have").isNotNull(), "known").otherwise("created")
    )
    return rows.select(*edge, "workflow_id", outcome.alias("outcome"))


def step_signers(approvals: DataFrame, staff: DataFrame, roles: DataFrame) -> DataFrame:
    """(step_id, signers): each signer of a step once, as name or name (role), in order of the first approval."""
    people = staff.select(F.col("id").alias("user_id"), "user_name", "role_id").join(roles.select(F.col("id").alias("role_id"), "role_name"), "role_id", "left")
    label = F.concat(F.col("user_name"), F.when(F.col("role_name").isNotNull(), F.concat(F.lit(" ("), F.col("role_name"), F.lit(")"))).otherwise(""))
    signed = approvals.join(people.select("user_id", label.alias("label")), "user_id").groupBy("step_id", "label").agg(F.min("id").alias("first"))
    listed = F.sort_array(F.collect_list(F.struct("first", "label")))
    return signed.groupBy("step_id").agg(F.array_join(F.transform(listed, lambda x: x["label"]), ", ").alias("signers"))


def _step(name: str, role: int, description: str = "") -> Column:
    return F.struct(F.lit(name).alias("step_name"), F.lit(role).cast("int").alias("role_id"), F.lit(description).alias("description"))


def anchored(steps: Column) -> Column:
    """An array of recommended steps with the standing ones: intake first, an approval before the end, signing and archive last.

    Recommended signing and archive steps go, since the standing ones take their place.
    """
    low = lambda s: F.lower(F.coalesce(s["step_name"], F.lit("")))
    head = F.when(F.size(steps) > 0, any_of(low(steps[0]), INTAKE_WORDS)).otherwise(F.lit(False))
    begun = F.when(head, steps).otherwise(F.concat(F.array(_step(*INTAKE_STEP, INTAKE_TEXT)), steps))
    middle = F.filter(begun, lambda s: ~any_of(low(s), CLOSING_WORDS))
    approves = F.exists(middle, lambda s: F.coalesce(s["role_id"].isin(*APPROVAL_ROLES), F.lit(False)) | any_of(low(s), APPROVAL_WORDS))
    approved = F.when(approves, middle).otherwise(F.concat(middle, F.array(_step(*APPROVAL_STEP, APPROVAL_TEXT))))
    return F.concat(approved, F.array(*[_step(*s, text) for s, text in zip(CLOSING_STEPS, CLOSING_TEXTS, strict=True)]))


def anchor_steps(steps: DataFrame) -> DataFrame:
    """(workflow_id, step_order, step_name, role_id, description): each workflow's recommended steps, anchored and numbered from 1."""
    kinds = F.sort_array(F.collect_list(F.struct("step_order", "id", "step_name", F.col("role_id").cast("int").alias("role_id"), F.coalesce("description", F.lit("")).alias("description"))))
    listed = steps.groupBy("workflow_id").agg(F.transform(kinds, lambda s: F.struct(s["step_name"].alias("step_name"), s["role_id"].alias("role_id"), s["description"].alias("description"))).alias("steps"))
    numbered = listed.select("workflow_id", F.posexplode(anchored(F.col("steps"))).alias("k", "s"))
    return numbered.select("workflow_id", (F.col("k") + 1).alias("step_order"), "s.step_name", "s.role_id", "s.description")


def default_workflows(workflows: DataFrame) -> DataFrame:
    """The standard steps for every workflow, with its type and name."""
    steps = F.array(*[F.struct(F.lit(k).alias("step_order"), F.lit(n).alias("step_name"), F.lit(r).alias("role_id")) for k, (n, r) in enumerate(DEFAULT_STEPS, 1)])
    kind = N.workflow_type(F.col("workflow_type"))
    return workflows.select("id", kind.alias("workflow_type"), N.workflow_name(kind).alias("workflow_name"), F.explode(steps).alias("s")).select("id", "workflow_type", "workflow_name", "s.*")


def role_of(step_name: Column, default: int = 4) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STEP_ROLES for x in pair])
    return F.coalesce(F.try_element_at(known, step_name), F.lit(default))


def step_roles(steps: DataFrame) -> DataFrame:
    return steps.groupBy("step_name").agg(F.count("*").alias("steps")).select("step_name", role_of(F.col("step_name")).alias("role_id"), "steps")


def latest_workflows(runs: DataFrame) -> DataFrame:
    """The workflow of each version with the highest id."""
    return top_by(runs, "version_id", F.desc("id"))


def replaced_workflows(existing: DataFrame, incoming: DataFrame, signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Workflows and signatures after new workflows: of a version with a new one the old go, and signatures with them."""
    kept = replaced_by_key(existing, incoming, "version_id")
    return kept, signatures.join(kept.select(F.col("id").alias("workflow_id")), "workflow_id", "left_semi")


def active_keys(keys: DataFrame) -> DataFrame:
    """(company_id, key_id, borrowed): each company's active key of the highest version, else the highest of all."""
    active = keys.where(F.col("status") == "ACTIVE")
    own = active.groupBy("company_id").agg(F.max(F.struct("key_version", "id"))["id"].alias("own"))
    spare = active.agg(F.max(F.struct("key_version", "id"))["id"].alias("spare"))
    joined = keys.select("company_id").distinct().join(own, "company_id", "left").join(F.broadcast(spare))
    return joined.select("company_id", F.coalesce("own", "spare").alias("key_id"), F.col("own").isNull().alias("borrowed"))


def key_requests(requests: DataFrame) -> DataFrame:
    """(id, error): what a request for a key lacks; '' for nothing."""
    lacking = N.missing_fields("company_id", "key_alias", "key_provider", "key_reference", "algorithm")
    return requests.select("id", F.when(lacking != "", F.concat(F.lit("Missing: "), lacking)).otherwise("").alias("error"))
