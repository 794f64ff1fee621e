"""Changes to tables without a table format: every operator gives the table's next state as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def classify(incoming: DataFrame, current: DataFrame, keys: list[str], digest: str = "content_hash") -> DataFrame:
    """Incoming rows with status new, updated or unchanged by the digest of the row that is there."""
    old = current.select(*keys, F.col(digest).alias("_old"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "new").when(F.col(digest).eqNullSafe(F.col("_old")), "unchanged").otherwise("updated")
    return incoming.join(old, keys, "left").withColumn("status", status).drop("_old", "_there")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows in place of those with their keys."""
    return current.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def replace_children(children: DataFrame, parents: DataFrame, parent: str, new: DataFrame) -> DataFrame:
    """Without the children of the parents given, with the new ones: also where a parent has no new children."""
    return children.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(new)


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table and those rows whose keys it does not have; of rows with equal keys one."""
    return table.unionByName(rows.dropDuplicates(keys).join(table, keys, "left_anti").select(*table.columns))


def patch(table: DataFrame, patches: DataFrame, key: str, columns: list[str], updated_at: Column | None = None) -> DataFrame:
    """Columns take the patch's value where it is not null; ``updated_at`` is set on rows that have a patch."""
    new = patches.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    both = table.join(new, F.col(key) == F.col("_key"), "left")
    out = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}
    if updated_at is not None:
        out["updated_at"] = F.when(F.col("_key").isNotNull(), updated_at).otherwise(F.col("updated_at"))
    return both.withColumns(out).select(*table.columns)


def set_where(table: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    """A soft delete, or any other update of one column by a condition."""
    return table.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def number_versions(log: DataFrame, document: str, order: list[str], digest: str) -> DataFrame:
    """Versions numbered from 1 in each document, and whether the digest differs from the one before."""
    w = Window.partitionBy(document).orderBy(*order)
    before = F.lag(digest).over(w)
    return log.withColumns({"version_number": F.row_number().over(w).cast("long"), "changed": before.isNull() | (before != F.col(digest))})


def append_versions(versions: DataFrame, changed: DataFrame, document: str, columns: list[str]) -> DataFrame:
    """Rows of ``changed`` as the next version of their document; one row a document and run."""
    last = versions.groupBy(document).agg(F.max("version_number").alias("_last"))
    new = changed.join(last, document, "left").withColumn("version_number", (F.coalesce("_last", F.lit(0)) + 1).cast("long"))
    return versions.unionByName(new.select(document, "version_number", *columns))


def in_force(log: DataFrame, document: str, at: Column, time: str, order: list[str]) -> DataFrame:
    """Of each document the last version not after a time."""
    latest = F.struct(*order)
    others = [c for c in log.columns if c != document]
    return log.where(F.col(time) <= at).groupBy(document).agg(F.max_by(F.struct(*others), latest).alias("_x")).select(document, "_x.*")


def survivors(gone: DataFrame, tables: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """A delete that cascades: tables (frame, own key, key of the parent) from parent to child; ``gone`` has the
    keys deleted at the top. Rows whose parent goes, go."""
    out, dead = [], gone.toDF("_dead")
    for frame, own, parent in tables:
        out.append(frame.join(dead, frame[parent] == dead["_dead"], "left_anti"))
        dead = frame.join(dead, frame[parent] == dead["_dead"], "left_semi").select(F.col(own).alias("_dead"))
    return out


def run_totals(classified: DataFrame, source: str) -> DataFrame:
    """Counters of a crawl for each source and, with source null, for all."""
    count = {"discovered": F.count(F.lit(1))} | {name: F.count_if(F.col("status") == status) for name, status in (("n_new", "new"), ("n_updated", "updated"), ("n_unchanged", "unchanged"))}
    return classified.rollup(source).agg(*(c.alias(k) for k, c in count.items()))


def written_run(classified: DataFrame, path: str) -> dict[str, int]:
    """Write the rows of a crawl and count them in the same pass: the counters of ``run_totals`` for all sources, and no second job."""
    seen = Observation()
    status = {"n_new": "new", "n_updated": "updated", "n_unchanged": "unchanged"}
    counts = [F.count(F.lit(1)).alias("discovered"), *(F.count_if(F.col("status") == s).alias(name) for name, s in status.items())]
    classified.observe(seen, *counts).write.mode("overwrite").parquet(path)
    return seen.get


def inserted(table: DataFrame, **values) -> tuple[DataFrame, DataFrame]:
    """The table with one row more, and that row; columns not given are null."""
    row = table.sparkSession.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in table.schema))
    return table.unionByName(row), row


def started(runs: DataFrame, run: str, source: str, now: Column) -> DataFrame:
    """The run log with a run that began."""
    row = runs.sparkSession.range(1).select(
        *({"id": F.lit(run), "source_id": F.lit(source), "started_at": now, "status": F.lit("running")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in runs.schema)
    )
    return runs.unionByName(row)


def finished(runs: DataFrame, run: str, totals: DataFrame, now: Column, error: str | None = None) -> DataFrame:
    """The run log with a run's end: completed with the counters of ``totals`` (one row), or failed."""
    pairs = {"docs_discovered": "discovered", "docs_new": "n_new", "docs_updated": "n_updated", "docs_unchanged": "n_unchanged"}
    one = totals.select(F.lit(run).alias("_run"), *(F.col(b).alias(f"_{a}") for a, b in pairs.items()))
    mine = F.col("id") == run
    out = {a: F.when(mine, F.col(f"_{a}").cast("int")).otherwise(F.col(a)) for a in pairs}
    out |= {"completed_at": F.when(mine, now).otherwise(F.col("completed_at")), "status": F.when(mine, F.lit("failed" if error else "completed")).otherwise(F.col("status"))}
    out |= {"error_message": F.when(mine, F.lit(error)).otherwise(F.col("error_message"))}
    return runs.join(one, runs["id"] == one["_run"], "left").withColumns(out).select(*runs.columns)


def accepted(uploads: DataFrame, mime: str = "application/pdf", most: int = 50 * 1024 * 1024) -> DataFrame:
    """Uploads (mime_type, content) with a status: accepted, unsupported, empty or too large."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    status = F.when(~F.coalesce(F.col("mime_type"), F.lit("")).startswith(mime), "unsupported").when(size == 0, "empty").when(size > most, "too large").otherwise("accepted")
    return uploads.withColumn("status", status)


def violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once: empty if the table is as it should be."""
    return table.groupBy(*keys).count().where("count > 1")


def orphans(children: DataFrame, key: str, parents: DataFrame, parent: str) -> DataFrame:
    return children.join(parents.select(F.col(parent).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")
