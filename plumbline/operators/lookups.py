"""Lookups, filters, projections, roll-ups and orders over the stored collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import crs as C

from .spatial_join import keyed, levels_in, sides
from .store import tagged


def resolve_object(collections: dict[str, DataFrame], wanted: str, fields: tuple[str, ...] = ("id", "parcel_id", "ulpin")) -> DataFrame:
    """The record that is named exactly: by id before other names, then by the order of the collections."""

    def hits(df: DataFrame) -> DataFrame:
        rank = F.coalesce(*(F.when(F.col(f) == wanted, k) for k, f in enumerate(fields) if f in df.columns))
        return df.withColumn("rank_", rank).where("rank_ is not null")

    return tagged({k: hits(v) for k, v in collections.items()}).orderBy("rank_", "priority_").limit(1).drop("rank_")


def version(versions: DataFrame, object_id: str, number: int) -> DataFrame:
    return versions.where((F.col("object_id") == object_id) & (F.col("version") == number))


def available_versions(versions: DataFrame, object_id: str) -> DataFrame:
    return versions.where(F.col("object_id") == object_id).select("version").orderBy("version")


def matching(df: DataFrame, **wanted) -> DataFrame:
    """The records with these values; None asks for nothing. Serves changes, jobs, extracted buildings, storeys and volumes."""
    return reduce(lambda d, kv: d if kv[1] is None else d.where(F.col(kv[0]) == kv[1]), wanted.items(), df)


CHANGE_TYPES = ["FOOTPRINT", "HEIGHT", "VOLUME", "NEW_FLOOR", "REMOVED_FLOOR"]


def changes_of(changes: DataFrame, source_id: str | None = None, change_type: str | None = None, object_id: str | None = None) -> DataFrame:
    if change_type is not None and change_type not in CHANGE_TYPES:
        raise ValueError(f"change_type must be one of {', '.join(CHANGE_TYPES)}")
    return matching(changes, source_id=source_id, change_type=change_type, object_id=object_id)


def point_cloud_sources(sources: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Sources whose metadata (JSON text) marks them as point clouds."""
    return sources.where(F.get_json_object(metadata, "$.point_cloud") == "true")


def lifted(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Fields of a JSON column as columns of their own: name -> path below the root."""
    return df.withColumns({k: F.get_json_object(column, f"$.{p}") for k, p in fields.items()}).drop(column)


SUMMARY = {"format": "format", "compressed": "compressed", "crs_declared": "crs_declared_in_payload", "point_count": "point_count", "density_points_per_m2": "density_points_per_m2", "bounds": "display_bounds", "source_bounds": "source_bounds", "acquisition": "acquisition", "sha256": "sha256", "file_size_bytes": "file_size_bytes", "validation": "validation"}


def point_cloud_summary(sources: DataFrame, status: DataFrame) -> DataFrame:
    """One flat row for each point-cloud source, with the status that its jobs add up to. status: source_id, status."""
    flat = lifted(point_cloud_sources(sources).withColumnRenamed("id", "source_id"), "metadata", SUMMARY)
    out = flat.join(status, "source_id", "left")
    return out.select("source_id", "filename", F.col("source_type").alias("type"), F.coalesce(C.resolve(F.col("crs")), F.lit(C.UNKNOWN)).alias("crs"), *SUMMARY, F.coalesce("status", F.lit("PENDING")).alias("status"))


def footprint(*candidates: Column) -> Column:
    """The first geometry that has points: the volume's, the record's, the footprint field."""
    return F.coalesce(*(F.when(F.size(c) > 0, c) for c in candidates))


def has_footprint(*candidates: Column) -> Column:
    return footprint(*candidates).isNotNull()


def points_in(points: DataFrame, boxes: DataFrame, margin: float = 1.0, cell: float = 100.0) -> DataFrame:
    """(point columns, box_id) of the points in each box widened by the margin: an equi-join on the cells of the boxes' own grid levels."""
    b = keyed(boxes.select(F.col("id").alias("box_id"), "x0", "y0", "x1", "y1"), cell, F.array().cast("array<int>"), margin).drop("gl")
    w, h = sides(cell, F.col("gk"))
    p = points.withColumn("gk", F.explode(levels_in(boxes, cell, margin))).withColumns({"gx": F.floor(F.col("x") / w), "gy": F.floor(F.col("y") / h)})
    inside = F.col("x").between(F.col("x0") - margin, F.col("x1") + margin) & F.col("y").between(F.col("y0") - margin, F.col("y1") + margin)
    return p.join(b, ["gk", "gx", "gy"]).where(inside).drop("gk", "gx", "gy", "x0", "y0", "x1", "y1")


def counts(collections: dict[str, DataFrame]) -> DataFrame:
    """(collection, n), one row for each collection, empty ones too."""
    return reduce(DataFrame.unionAll, (df.agg(F.lit(k).alias("collection"), F.count(F.lit(1)).alias("n")) for k, df in collections.items()))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Counts of stored findings by severity, category and rule, and the total; a missing category or rule has no row of its own."""
    cols = [F.col(c) for c in ("severity", "category", "rule_id")]
    level = F.grouping_id()
    g = issues.groupingSets([[c] for c in cols] + [[]], *cols).agg(level.alias("g"), F.count(F.lit(1)).alias("n"))
    what = F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "category").when(F.col("g") == 6, "rule_id").otherwise("total")
    return g.select(what.alias("by"), F.coalesce("severity", "category", "rule_id").alias("value"), "n").where("by = 'total' or value is not null")


def extraction_stage(jobs: DataFrame) -> DataFrame:
    """How far each source has come by the jobs of its building extraction; failure first, then what runs, then what is done."""
    any_ = lambda kind, status: F.bool_or((F.col("job_type") == kind) & (F.col("status") == status))
    e = "BUILDING_EXTRACTION"
    stage = F.when(any_(e, "FAILED"), "EXTRACTION_FAILED").when(any_(e, "RUNNING"), "EXTRACTING").when(any_(e, "DONE"), "EXTRACTED").when(any_(e, "PENDING") | any_("METADATA_EXTRACTION", "DONE"), "METADATA_ONLY").otherwise("UNKNOWN")
    return jobs.groupBy("source_id").agg(stage.alias("stage"))


def listed_changes(changes: DataFrame, limit: int = 500) -> DataFrame:
    """The report's list, oldest first, at most ``limit`` and at least one: its bound is the feature."""
    return changes.orderBy("detected_at", "id").limit(max(1, limit))


def by_stage(links: DataFrame, stages: list[str], time: str = "created_at") -> DataFrame:
    """Links by the rank of their stage, then by time; unknown stages last."""
    return links.withColumn("stage_rank", stage_rank(F.col("stage"), stages)).orderBy("stage_rank", time, "object_id")


def stage_rank(stage: Column, stages: list[str]) -> Column:
    at = F.array_position(F.array(*map(F.lit, stages)), stage)
    return F.when(at > 0, at - 1).otherwise(len(stages)).cast("int")


def in_floor_order(floors: DataFrame) -> DataFrame:
    return floors.orderBy("building_id", "floor_number")


def faces_in_order(faces: Column) -> Column:
    """Faces (STRUCT with area, x0, y0, x1, y1) by decreasing area, then by their bounds."""
    return F.transform(F.array_sort(F.transform(faces, lambda f: F.struct((-f["area"]).alias("k"), f["x0"].alias("a"), f["y0"].alias("b"), f["x1"].alias("c"), f["y1"].alias("d"), f.alias("f")))), lambda s: s["f"])


def identified(parcels: DataFrame, properties: DataFrame) -> DataFrame:
    """Everything that carries an identifier: parcels first, then property volumes."""
    return parcels.unionByName(properties, allowMissingColumns=True)


def warnings(texts: Column) -> Column:
    """Each warning once, in order."""
    return F.array_sort(F.array_distinct(F.filter(texts, lambda x: x.isNotNull())))


def job_links(links: DataFrame, jobs: DataFrame) -> DataFrame:
    """links and one from each job to the source it read; a job linked already, or without a source, gets none."""
    new = jobs.where("source_id is not null and source_id <> ''").groupBy(F.col("id").alias("object_id")).agg(F.min("source_id").alias("parent_id"))
    have = links.where("stage = 'PROCESSING_JOB'").select("object_id").distinct()
    return links.unionByName(new.join(have, "object_id", "left_anti").withColumn("stage", F.lit("PROCESSING_JOB")), allowMissingColumns=True)


def pipeline_links(links: DataFrame, jobs: DataFrame, objects: DataFrame, stage: str) -> DataFrame:
    """Job links, and a link from each object (id, job_id) to the job that made it."""
    made = objects.where("job_id is not null").select(F.col("id").alias("object_id"), F.col("job_id").alias("parent_id"), F.lit(stage).alias("stage")).distinct()
    return job_links(links, jobs).unionByName(made.join(links.select("object_id", "parent_id", "stage"), ["object_id", "parent_id", "stage"], "left_anti"), allowMissingColumns=True)


def step_words(state: Column) -> Column:
    """The words that a step's state is shown by."""
    words = {"ready": "complete", "running": "in progress", "attention": "needs review", "error": "failed", "blocked": "waiting", "empty": "not started"}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), state), F.lit("not started"))


#: State of a review case -> what a change is called.
DECIDED = {"APPROVED": "APPROVED", "REJECTED": "REJECTED", "RESURVEY_REQUESTED": "RESURVEY REQUESTED", "EXPECTED": "ACCEPTED AS EXPECTED", "PENDING": "REQUIRES REVIEW", "IN_REVIEW": "REQUIRES REVIEW"}


def neutral_status(change: Column, case_state: Column) -> Column:
    """What is said of an object: what a reviewer has decided or is to decide, else whether there is a change (not null) at all."""
    said = F.create_map(*(F.lit(x) for kv in DECIDED.items() for x in kv))
    return F.coalesce(F.element_at(said, case_state), F.when(change.isNotNull(), "CHANGE DETECTED").otherwise("NO CHANGE"))


def change_statuses(objects: DataFrame, changes: DataFrame, cases: DataFrame) -> DataFrame:
    """(id, change_type, status) of every object (id): a row for each of its changes (id, object_id, change_type), with the state of the change's review case
    (issue_id, state); one row where there is none."""
    ch = changes.select(F.col("id").alias("change_id"), F.col("object_id").alias("id"), "change_type")
    j = objects.select("id").join(ch, "id", "left").join(cases.select(F.col("issue_id").alias("change_id"), "state"), "change_id", "left")
    return j.select("id", "change_type", neutral_status(F.col("change_id"), F.col("state")).alias("status"))


PIPELINE = [("extraction", "BUILDING_EXTRACTION", "extracted"), ("floors", "FLOOR_SEGMENTATION", "storeys"), ("volumes", "PROPERTY_VOLUME", "volumes")]


def workflow(collections: dict[str, DataFrame]) -> DataFrame:
    """The nine steps (idx, step, n, state). collections: sources, parcels, jobs (job_type, status), extracted, storeys, volumes (each with
    flagged), identified (ulpin), issues (severity, status), cases (state)."""
    one = lambda name, *aggs: collections[name].agg(*aggs)
    n = F.count(F.lit(1))
    row = one("sources", n.alias("sources")).crossJoin(one("parcels", n.alias("parcels")))
    row = row.crossJoin(one("jobs", *(F.count_if((F.col("job_type") == job) & (F.col("status") == st)).alias(f"{step}_{st}") for step, job, _ in PIPELINE for st in ("RUNNING", "FAILED")), F.count_if((F.col("job_type") == "BUILDING_EXTRACTION") & (F.col("status") == "DONE")).alias("extracted_jobs")))
    for step, _, table in PIPELINE:
        row = row.crossJoin(one(table, n.alias(f"{step}_n"), F.count_if("flagged").alias(f"{step}_flagged")))
    row = row.crossJoin(one("identified", n.alias("of"), F.count("ulpin").alias("issued")))
    row = row.crossJoin(one("issues", n.alias("findings"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("status") == "APPROVED").alias("approved"), F.count_if(F.col("status") != "OPEN").alias("settled")))
    row = row.crossJoin(one("cases", F.count_if(F.col("state").isin("PENDING", "IN_REVIEW")).alias("pending"), F.count_if(~F.col("state").isin("PENDING", "IN_REVIEW")).alias("decided")))
    c, has = F.col, lambda name: F.col(name) > 0
    steps = [("sources", c("sources"), F.when(has("sources"), "ready").otherwise("empty")), ("parcel", c("parcels"), F.when(has("parcels"), "ready").otherwise("empty"))]
    for step, *_ in PIPELINE:
        state = F.when(has(f"{step}_RUNNING"), "running").when(has(f"{step}_FAILED"), "error").when(has(f"{step}_flagged"), "attention").when(has(f"{step}_n"), "ready").when(has("sources") & ~has("extracted_jobs"), "blocked").otherwise("empty")
        steps.append((step, c(f"{step}_n"), state))
    steps += [
        ("ulpin", c("issued"), F.when(~has("of"), "blocked").when(c("issued") == c("of"), "ready").otherwise("attention")),
        ("validation", c("findings"), F.when(has("findings"), F.when(has("critical"), "attention").otherwise("ready")).when(has("sources"), "empty").otherwise("blocked")),
        ("review", c("pending"), F.when(has("pending"), "attention").when(has("decided"), "ready").when(has("findings"), "empty").otherwise("blocked")),
        ("approved", c("approved"), F.when(has("approved"), "ready").when(has("settled"), "empty").otherwise("blocked")),
    ]
    each = F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(k).alias("step"), m.cast("long").alias("n"), s.alias("state")) for i, (k, m, s) in enumerate(steps, 1)))
    return row.select(F.inline(each))
