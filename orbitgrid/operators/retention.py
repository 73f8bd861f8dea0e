"""What retention would remove: a plan, nothing is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitgrid.operators.asset_rules import true

c = F.col
#: Names and suffixes whose presence keeps a folder.
PROTECTED_NAMES = (
    "coverage_report.json",
    "cleanup_stats.json",
    "export_metrics.json",
    "guidance_report.json",
    "guidance_summary.md",
    "manifest.json",
    "normalized_metadata.json",
    "validation_report.json",
)
PROTECTED_SUFFIXES = (".json", ".log")
#: Days by session status and for job folders, hours for scratch and orphans; the longer limit for job folders.
POLICY = {"published": 3, "draft": 7, "failed": 14, "recapture_required": 14, "job": 14, "scratch_hours": 48, "orphan_hours": 24}
LENIENT = POLICY | {"job": 30}


def protected(name: Column) -> Column:
    return name.isin(*PROTECTED_NAMES) | F.array_contains(F.array(*map(F.lit, PROTECTED_SUFFIXES)), F.regexp_extract(name, r"(\.[^.]*)$", 1))


def retention_plan(files: DataFrame, sessions: DataFrame, now: Column, policy: dict = POLICY) -> DataFrame:
    """One row for each folder with its action and reason.

    files: (folder, kind raw, scratch or job, owner, name, mtime); sessions: (owner, status,
    publish_state, last_progress). Raw folders go by their session's status and age, active
    sessions never; scratch folders by age, without an owner by the orphan limit; a protected file vetoes both.
    Job folders go by their age alone (14 days, or 30 by the `LENIENT` policy), whatever they hold.
    """
    folders = files.groupBy("folder", "kind", "owner").agg(F.max("mtime").alias("mtime"), F.bool_or(protected(c("name"))).alias("protected"))
    rows = folders.join(sessions, "owner", "left")
    hours = lambda at: (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 3.6e9
    s = c("status")
    days = (
        F.when(s == "published", policy["published"]).when((s == "validated") & true(c("publish_state") == "draft"), policy["draft"]).when(s == "failed", policy["failed"]).when(s == "recapture_required", policy["recapture_required"])
    )
    raw, job = c("kind") == "raw", c("kind") == "job"
    limit = F.when(raw, days * 24.0).when(job, float(policy["job"] * 24)).otherwise(F.when(s.isNull(), float(policy["orphan_hours"])).otherwise(float(policy["scratch_hours"])))
    rows = rows.withColumns({"age_hours": hours(F.when(raw, F.coalesce("last_progress", "mtime")).otherwise(c("mtime"))), "limit_hours": limit})
    old = true(c("age_hours") > c("limit_hours"))
    reason = F.when(raw & c("limit_hours").isNull(), "active_session").when(~old, "recent").when(job, "old_job").when(c("protected"), "protected_files").when(raw, F.concat(F.lit("status="), s)).when(s.isNull(), "orphan").otherwise("old_scratch")
    return rows.select("folder", F.when(old & (job | ~c("protected")), "prune").otherwise("keep").alias("action"), reason.alias("reason"), "age_hours", "limit_hours")
