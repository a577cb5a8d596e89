"""Approvals of workflow steps as an ordered state machine, over a table or over a stream.

A workflow's events are taken in order of id.  An approval, plain or forced, is refused while a prerequisite of its step
isn't APPROVED.  A plain one is recorded and signed and changes no state.  A forced one makes the step APPROVED and the
workflow COMPLETED if all steps are APPROVED then, else IN_PROGRESS.  A rejection, never refused, makes both REJECTED;
a later forced approval opens them again.  So the last effective event counts, whatever came before.

Spark deals rows by workflow and sorts them by id; each task walks its rows once and holds one workflow's steps at a
time, never its events.  The order within one workflow is the rule itself, so one task has all events of a workflow.
The same walk runs per workflow over a stream, with the steps' states kept by Spark between batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.operators.common import is_approved

ACTIONS = ("APPROVED", "REJECTED", "FORCE_COMPLETE")
OUTCOMES = "id long, workflow_id long, step_id long, user_id long, comment string, outcome string, step_status string, workflow_status string"
# Fixed value: the comment of a forced approval that has none.
FORCED_COMMENT = "Accepted & Completed by Manager"


class Board:
    """One workflow's states: step -> status, step -> prerequisites, and its own status."""

    def __init__(self, steps: Iterable[tuple[int, str | None]], needs: Iterable[tuple[int, int]], status: str | None):
        self.status, self.steps, self.needs = status, dict(steps), {}
        self.approved = sum(s == "APPROVED" for s in self.steps.values())
        for before, step in needs:
            self.needs.setdefault(step, set()).add(before)

    def put(self, step: int, status: str) -> None:
        self.approved += (status == "APPROVED") - (self.steps[step] == "APPROVED")
        self.steps[step] = status

    def take(self, step: int, action: str | None) -> str:
        """What the event comes to: missing, invalid, blocked, signed, completed or rejected."""
        if step not in self.steps:
            return "missing"
        if action not in ACTIONS:
            return "invalid"
        if action == "REJECTED":
            self.put(step, "REJECTED")
            self.status = "REJECTED"
            return "rejected"
        if any(self.steps.get(s) != "APPROVED" for s in self.needs.get(step, ())):
            return "blocked"
        if action == "APPROVED":
            return "signed"
        self.put(step, "APPROVED")
        self.status = "COMPLETED" if self.approved == len(self.steps) else "IN_PROGRESS"
        return "completed"

    def told(self, e) -> tuple:
        outcome = self.take(e.step_id, e.action)
        comment = e.comment or FORCED_COMMENT if outcome == "completed" else e.comment
        return e.id, e.workflow_id, e.step_id, e.user_id, comment, outcome, self.steps.get(e.step_id), self.status


def boards(workflows: DataFrame, steps: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(workflow_id, workflow_status, steps, needs): every workflow as it starts, its steps and dependencies as arrays."""
    own = steps.groupBy("workflow_id").agg(F.collect_list(F.struct("id", "status")).alias("steps"))
    edges = dependencies.groupBy("workflow_id").agg(F.collect_list(F.struct("prerequisite_id", "dependent_id")).alias("needs"))
    w = workflows.select(F.col("id").alias("workflow_id"), F.col("status").alias("workflow_status"))
    return w.join(own, "workflow_id", "left").join(edges, "workflow_id", "left")


def _frame(rows: list[tuple]):
    import pandas as pd

    names = [c.split()[0] for c in OUTCOMES.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype(dict.fromkeys(names[:4], "Int64"))


def approval_outcomes(events: DataFrame, workflows: DataFrame, steps: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Each event (id, workflow_id, step_id, user_id, action, comment) with its outcome and the states after it.

    An event of an unknown workflow is missing.  One row starts a workflow and its events follow, so a workflow's steps
    travel once, not with every event.
    """
    start = boards(workflows, steps, dependencies).withColumn("id", F.lit(None).cast("long"))
    rows = start.unionByName(events.select("id", "workflow_id", "step_id", "user_id", "action", "comment"), allowMissingColumns=True)

    def walk(batches) -> Iterator:
        at, board = None, None
        for batch in batches:
            out = []
            batch = batch.astype({c: "object" for c in ("id", "workflow_id", "step_id", "user_id")}).where(batch.notna(), None)
            for e in batch.itertuples(index=False):
                if e.id is None:
                    pairs = lambda found, a, b: [(x[a], x[b]) for x in (() if found is None else found)]
                    at, board = e.workflow_id, Board(pairs(e.steps, "id", "status"), pairs(e.needs, "prerequisite_id", "dependent_id"), e.workflow_status)
                    continue
                if e.workflow_id != at or board is None:
                    at, board = e.workflow_id, Board((), (), None)
                out.append(board.told(e))
            yield _frame(out)

    dealt = rows.repartition("workflow_id").sortWithinPartitions(F.col("workflow_id").asc(), F.col("id").asc_nulls_first())
    return dealt.mapInPandas(walk, OUTCOMES)


def approval_stream(events: DataFrame, starts: DataFrame) -> DataFrame:
    """The outcomes of a stream of events, by the same rule; starts: a table as boards() gives it, joined to the events.

    States outlive a batch: a workflow's steps are read from its start the first time and kept from then on.  Within a
    batch events are taken in order of id; one that comes in a later batch than a later id is taken when it comes.
    """
    joined = events.select("id", "workflow_id", "step_id", "user_id", "action", "comment").join(starts, "workflow_id", "left")

    def advance(key, batches, state):
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values("id")
        rows = rows.astype({c: "object" for c in ("id", "workflow_id", "step_id", "user_id")}).where(rows.notna(), None)
        first = rows.iloc[0]
        needs = [(x["prerequisite_id"], x["dependent_id"]) for x in (() if first["needs"] is None else first["needs"])]
        if state.exists:
            ids, statuses, status = state.get
            board = Board(zip(ids, statuses, strict=True), needs, status)
        else:
            board = Board([(x["id"], x["status"]) for x in (() if first["steps"] is None else first["steps"])], needs, first["workflow_status"])
        out = [board.told(e) for e in rows.itertuples(index=False)]
        state.update((list(board.steps), list(board.steps.values()), board.status))
        yield _frame(out)

    return joined.groupBy("workflow_id").applyInPandasWithState(advance, OUTCOMES, "ids array<long>, statuses array<string>, status string", "append", "NoTimeout")


RECORDED = ("signed", "completed", "rejected")


def step_results(outcomes: DataFrame, steps: DataFrame) -> DataFrame:
    """(step_id, step_status, approvals, last_comment) of every step: its status after all events, recorded approvals and the comment of the last."""
    kept = outcomes.where(F.col("outcome").isin(*RECORDED))
    changing = F.col("outcome") != "signed"
    folded = kept.groupBy(F.col("step_id").alias("id")).agg(
        F.max_by(F.when(changing, F.col("step_status")), F.when(changing, F.col("id"))).alias("changed"), F.count("*").alias("approvals"), F.max_by("comment", "id").alias("last_comment")
    )
    rows = steps.select("id", "status").join(folded, "id", "left")
    return rows.select(F.col("id").alias("step_id"), F.coalesce("changed", "status").alias("step_status"), F.coalesce("approvals", F.lit(0)).alias("approvals"), "last_comment")


def workflow_results(outcomes: DataFrame, workflows: DataFrame) -> DataFrame:
    """(workflow_id, status, refused): every workflow's status after all events, and how many events were blocked."""
    changing = F.col("outcome").isin("completed", "rejected")
    folded = outcomes.groupBy(F.col("workflow_id").alias("id")).agg(
        F.max_by(F.when(changing, F.col("workflow_status")), F.when(changing, F.col("id"))).alias("changed"), F.count_if(F.col("outcome") == "blocked").alias("refused")
    )
    rows = workflows.select("id", "status").join(folded, "id", "left")
    return rows.select(F.col("id").alias("workflow_id"), F.coalesce("changed", "status").alias("status"), F.coalesce("refused", F.lit(0)).alias("refused"))


def completion(steps: DataFrame) -> DataFrame:
    """COMPLETED when all steps of a workflow are approved, else IN_PROGRESS: what a forced approval makes of a workflow."""
    folded = steps.groupBy("workflow_id").agg(F.bool_and(is_approved()).alias("all"))
    return folded.select("workflow_id", F.when(F.col("all"), "COMPLETED").otherwise("IN_PROGRESS").alias("status"))
