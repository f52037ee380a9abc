"""Reviews, audit and provenance over append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: action -> state after it.
STATES = {"APPROVE": "APPROVED", "REJECT": "REJECTED", "RESURVEY": "RESURVEY_REQUESTED", "EXPECT": "EXPECTED", "CLOSE": "CLOSED", "REOPEN": "IN_REVIEW", "ASSIGN": "IN_REVIEW"}
OPEN = ["PENDING", "IN_REVIEW"]


def step(state: Column, action: Column) -> Column:
    """The review state machine: decisions and assignments act on open cases, reopening on decided ones,
    closing on any; other actions change nothing."""
    is_open = state.isin(*OPEN)
    out = F.when(action == "CLOSE", "CLOSED").when((action == "REOPEN") & ~is_open, "IN_REVIEW").when((action == "ASSIGN") & is_open, "IN_REVIEW")
    for a in ("APPROVE", "REJECT", "RESURVEY", "EXPECT"):
        out = out.when((action == a) & is_open, STATES[a])
    return out.otherwise(state)


def fold_cases(log: DataFrame) -> DataFrame:
    """Final state of each case and how many decisions it took: its actions in (ts, id) order."""
    acts = log.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "action"))), lambda x: x["action"]).alias("acts"))
    start = F.struct(F.lit("PENDING").alias("state"), F.lit(0).cast("long").alias("decisions"))
    decided = lambda s, a: s["state"].isin(*OPEN) & a.isin("APPROVE", "REJECT", "RESURVEY", "EXPECT")
    end = F.aggregate("acts", start, lambda s, a: F.struct(step(s["state"], a).alias("state"), (s["decisions"] + F.when(decided(s, a), 1).otherwise(0)).alias("decisions")))
    return acts.select("case_id", end.alias("e")).select("case_id", "e.state", "e.decisions")


def severity_rank(c: Column) -> Column:
    return F.when(c == "CRITICAL", 0).when(c == "WARNING", 1).when(c == "INFO", 2).otherwise(3)


def queue(cases: DataFrame, n: int | None = None) -> DataFrame:
    """Worst first, unassigned before assigned, oldest first."""
    out = cases.orderBy(severity_rank(F.col("severity")), F.col("assigned").isNotNull(), "created_at", "case_id")
    return out if n is None else out.limit(n)


def restore(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """Findings of a new run with the states of their cases."""
    return findings.join(cases.select("issue_id", "state"), "issue_id", "left").withColumn("status", F.coalesce("state", F.lit("OPEN"))).drop("state")


def open_cases(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases for findings that have none."""
    new = findings.select("issue_id").distinct().join(cases, "issue_id", "left_anti").select("issue_id", F.concat(F.lit("RC-"), F.upper(F.substring(F.sha2("issue_id", 256), 1, 12))).alias("case_id"), F.lit("PENDING").alias("state"))
    return cases.unionByName(new, allowMissingColumns=True)


def recent(log: DataFrame, n: int, action: str | None = None, actor: str | None = None) -> DataFrame:
    """Newest first in the total order (ts, id)."""
    for c, v in (("action", action), ("actor", actor)):
        if v is not None:
            log = log.where(F.col(c) == v)
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(max(1, n))


def of_case(log: DataFrame, case_id: str) -> DataFrame:
    return log.where(F.col("case_id") == case_id).orderBy("ts", "id")


# --- provenance --------------------------------------------------------------------------------


def walk(links: DataFrame, seeds: DataFrame, up: bool) -> DataFrame:
    """(seed, object_id, depth): everything reached from the seeds, the shortest way first. Each round joins
    only the newest rows; a cycle ends when a round brings nothing new."""
    here, there = ("object_id", "parent_id") if up else ("parent_id", "object_id")
    edge = written(links.where("parent_id is not null").select(F.col(here).alias("h"), F.col(there).alias("t")))  # read in every round
    return _reached(edge, seeds)


def _reached(edge: DataFrame, seeds: DataFrame) -> DataFrame:
    """``walk`` over edges (h, t) that may repeat. A round is written as a table, in one pass; a checkpoint would compute it twice."""
    new = seeds.select(F.col("object_id").alias("seed"), "object_id", F.lit(0).alias("depth"))
    seen = new
    d = 0
    while True:
        d += 1
        new = new.join(edge, F.col("object_id") == F.col("h")).select("seed", F.col("t").alias("object_id")).distinct()  # dealt as the next join wants it
        new = written(new.join(seen.select("seed", "object_id"), ["seed", "object_id"], "left_anti").withColumn("depth", F.lit(d)))
        if new.isEmpty():
            break
        seen = seen.unionAll(new)
    return seen


def lineage(links: DataFrame, seeds: DataFrame, stages: list[str]) -> DataFrame:
    """Ancestors' stages of each seed: what is there, what is missing, and whether it starts at the source."""
    links = written(links.select("object_id", "parent_id", "stage"))  # for the walk and for the stages
    # an object's stages as bits, so that a seed adds up numbers
    bit = F.coalesce(*(F.when(F.col("stage") == s, 1 << k) for k, s in enumerate(stages)), F.lit(0)).cast("long")
    of = links.groupBy("object_id").agg(F.bit_or(bit).alias("bits"))
    edge = links.where("parent_id is not null").select(F.col("object_id").alias("h"), F.col("parent_id").alias("t"))
    got = _reached(edge, seeds).join(of, "object_id").groupBy("seed").agg(F.bit_or("bits").alias("bits"), F.max("depth").alias("depth"))
    has = [F.col("bits").bitwiseAND(1 << k) != 0 for k in range(len(stages))]
    named = lambda there: F.concat_ws(",", *(F.when(h if there else ~h, s) for h, s in zip(has, stages)))
    return got.select("seed", "depth", named(True).alias("present"), named(False).alias("missing"), has[0].alias("complete"))


def derived_by_stage(links: DataFrame) -> DataFrame:
    return links.groupBy("stage").agg(F.count_distinct("object_id").alias("objects"), F.count_distinct("parent_id").alias("parents"))


#: Methods that are arithmetic; a link by one of them names no model.
ALGORITHMIC = ["ALGORITHM", "MANUAL"]


def record_links(links: DataFrame, new: DataFrame, stages: list[str]) -> DataFrame:
    """links and those of new with a known stage that don't claim a model for an algorithmic method; a link
    (object, parent, stage) that is there already is not added again."""
    good = new.where(F.col("stage").isin(*stages) & ~(F.col("method").isin(*ALGORITHMIC) & F.col("model_name").isNotNull()))
    keys = ["object_id", "parent_id", "stage"]
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    return links.unionByName(good.dropDuplicates(keys).alias("n").join(links.alias("l"), same, "left_anti"), allowMissingColumns=True)


def sources_behind(links: DataFrame, seeds: DataFrame, sources: DataFrame) -> DataFrame:
    """Of each seed the sources (object_id, source_id) of itself and its descendants, in order."""
    down = walk(links, seeds, False).join(sources, "object_id")
    return down.groupBy("seed").agg(F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"))


def processing_history(links: DataFrame, seeds: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs (object_id, job_id) of each seed and its ancestors, nearest first."""
    return walk(links, seeds, True).join(jobs, "object_id").groupBy("seed", "job_id").agg(F.min("depth").alias("depth"))


def append_audit(log: DataFrame, rows: DataFrame, actions: list[str]) -> DataFrame:
    """log and the rows with a known action."""
    return log.unionByName(rows.where(F.col("action").isin(*actions)), allowMissingColumns=True)


def quality_summary(df: DataFrame, by: str, quality, size) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(quality).alias("least"), F.max(quality).alias("most"), F.sum(size).alias("total"))
