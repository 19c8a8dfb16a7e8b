"""Health of page runs: totals, red flags, reasons and the promotion gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayside.functions.text import truthy

RED = ("fetch_failed", "blocked_robots", "blocked_policy")
GREEN = ("fetched", "not_modified")
# fixed values: issue codes that block a promotion
BLOCKING_DRY_RUN = (
    "parse_failed", "parsed_zero_rows", "no_events_found", "missing_school_id",
    "partial_import_skips_stale_deactivation", "missing_school_skips_stale_deactivation",
)


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` runs of each manifest, newest first."""
    order = W.partitionBy("manifest").orderBy(F.col("id").desc())
    return runs.withColumn("run_index", F.row_number().over(order) - 1).where(F.col("run_index") < n)


def run_health(runs: DataFrame, logs: DataFrame, reports: DataFrame, n: int) -> DataFrame:
    """Per run: status, counts by fetch status and by parse level, latest error."""
    shown = recent_runs(runs, n).withColumnRenamed("id", "crawl_run_id")
    ids = shown.select("crawl_run_id")

    def counts(df: DataFrame, key: str, out: str) -> DataFrame:
        per = df.join(ids, "crawl_run_id", "left_semi").groupBy("crawl_run_id", key).agg(F.count(F.lit(1)).alias("n"))
        return per.groupBy("crawl_run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(out))

    errors = reports.where(F.col("level") == "error").join(ids, "crawl_run_id", "left_semi")
    last = errors.groupBy("crawl_run_id").agg(F.max_by(F.struct("code", "message"), "id").alias("latest_error"))
    return (
        shown.join(counts(logs, "fetch_status", "fetch_status_counts"), "crawl_run_id", "left")
        .join(counts(reports, "level", "parse_level_counts"), "crawl_run_id", "left")
        .join(last, "crawl_run_id", "left")
    )


def fetch_summary() -> Column:
    """One status for all fetches of a target in a run (an aggregate)."""
    s = F.col("fetch_status")
    out = F.when(F.bool_and(s == "not_modified"), F.lit("not_modified")).when(F.bool_or(s == "fetched"), F.lit("fetched"))
    out = out.otherwise(F.min_by(s, "id"))
    for status in reversed(("fetch_failed", "blocked_robots", "blocked_policy")):
        out = F.when(F.bool_or(s == status), F.lit(status)).otherwise(out)
    return out


def red_flags(targets: DataFrame, runs: DataFrame, logs: DataFrame, reports: DataFrame, n: int) -> DataFrame:
    """Targets with trouble in the recent runs of their manifest.

    Signals are aggregated per (run, target) first; the join of targets with
    at most ``n`` runs of the same manifest is bounded by ``n`` per target.
    """
    c = F.col
    shown = recent_runs(runs, n).select("manifest", c("id").alias("crawl_run_id"), "run_index")
    key = ["crawl_run_id", "logical_name"]
    fetch = logs.groupBy(*key).agg(fetch_summary().alias("fetch"))
    errors = reports.where((c("level") == "error") & c("logical_name").isNotNull())
    parse = errors.groupBy(*key).agg(F.max_by("code", "id").alias("parse_error"))
    signals = fetch.join(parse, key, "full").withColumn("_observed", F.lit(True))
    grid = targets.select("manifest", "logical_name").distinct().join(shown, "manifest", "left").join(signals, key, "left")
    seen = truthy(c("_observed"))
    bad = truthy(c("fetch").isin(*RED)) | c("parse_error").isNotNull()
    red = c("crawl_run_id").isNotNull() & (~seen | bad)
    green = truthy(c("fetch").isin(*GREEN)) & c("parse_error").isNull()
    newest = c("run_index") == 0
    out = grid.groupBy("manifest", "logical_name").agg(
        F.count("crawl_run_id").alias("_runs"),
        F.count_if(seen).alias("observed_runs"),
        F.count_if(green).alias("successful_runs"),
        F.count_if(red).alias("red_runs"),
        # leading reds: the index of the first run that is not red
        F.coalesce(F.min(F.when(~red & c("crawl_run_id").isNotNull(), c("run_index"))), F.count("crawl_run_id")).cast("long").alias("consecutive_red_runs"),
        F.bool_or(newest & ~seen).alias("_missing"),
        F.max(F.when(newest, c("fetch"))).alias("latest_fetch_status"),
        F.max(F.when(newest, c("parse_error"))).alias("latest_error"),
    )
    none = (c("_runs") == 0) | (c("observed_runs") == 0)
    latest = c("latest_fetch_status")
    reasons = F.when(none, F.array(F.lit("no_recent_data"))).otherwise(
        F.array_compact(
            F.array(
                F.when(c("_missing"), F.lit("missing_from_latest_run")),
                F.when(latest.isin(*RED), F.concat(F.lit("latest_"), latest)),
                F.when(c("latest_error").isNotNull(), F.concat(F.lit("latest_parse_error:"), c("latest_error"))),
                F.when(c("successful_runs") == 0, F.lit("no_successful_recent_runs")),
                F.when(c("red_runs") >= 2, F.lit("repeated_recent_failures")),
            )
        )
    )
    flagged = out.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    return flagged.drop("_runs", "_missing")


def red_flag_order() -> list[Column]:
    return [F.col("consecutive_red_runs").desc(), F.col("red_runs").desc(), F.col("logical_name")]


def reason_trend(runs: DataFrame, logs: DataFrame, reports: DataFrame, n: int) -> DataFrame:
    """Failure reasons per recent run."""
    shown = recent_runs(runs, n).select("manifest", F.col("id").alias("crawl_run_id"), "status")
    fetch = logs.where(F.col("fetch_status").isin(*RED)).select("crawl_run_id", F.col("fetch_status").alias("reason"))
    parse = reports.where((F.col("level") == "error") & F.col("logical_name").isNotNull()).select(
        "crawl_run_id", F.concat(F.lit("parse_error:"), "code").alias("reason")
    )
    return fetch.unionByName(parse).join(shown, "crawl_run_id").groupBy("manifest", "crawl_run_id", "status", "reason").agg(F.count(F.lit(1)).alias("n"))


def reason_totals(flags: DataFrame) -> DataFrame:
    """Reasons over all flagged targets, by their normal names."""
    rows = flags.select("manifest", F.explode("reasons").alias("raw"))
    reason = (
        F.when(F.col("raw").isin(*[f"latest_{r}" for r in RED]), F.regexp_replace("raw", "^latest_", ""))
        .when(F.col("raw").isin("missing_from_latest_run", "no_recent_data") | F.col("raw").startswith("latest_parse_error:"), F.col("raw"))
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("manifest", "reason").agg(F.count(F.lit(1)).alias("n"))


def promotion_gate(sources: DataFrame, impact: DataFrame, runs: DataFrame, flags: DataFrame, n: int) -> DataFrame:
    """Blockers and points to review per source, from a dry run and run health.

    ``sources``: manifest, source_maturity.  ``impact``: manifest, ready_targets,
    parsed_rows, imported_rows, missing_school_rows, issues array<string>.
    """
    c = F.col
    health = recent_runs(runs, n).groupBy("manifest").agg(
        F.count(F.lit(1)).alias("shown"),
        F.count_if(c("status") == "succeeded").alias("succeeded"),
        F.count_if(c("status") == "failed").alias("failed"),
        F.count_if(~c("status").isin("succeeded", "failed")).alias("active"),
    )
    flagged = flags.select("manifest").distinct().withColumn("_flagged", F.lit(True))
    reasons = reason_totals(flags).groupBy("manifest").agg(F.collect_set("reason").alias("_reasons"))
    rows = sources.join(impact, "manifest", "left").join(health, "manifest", "left").join(flagged, "manifest", "left").join(reasons, "manifest", "left")
    none = F.array().cast("array<string>")
    zero = {n_: F.coalesce(n_, F.lit(0)) for n_ in ("ready_targets", "parsed_rows", "imported_rows", "missing_school_rows", "shown", "succeeded", "failed", "active")}
    rows = rows.withColumns({**zero, "issues": F.coalesce("issues", none), "_reasons": F.coalesce("_reasons", none)})
    blocking = F.filter("issues", lambda i: i.isin(*BLOCKING_DRY_RUN))
    blockers = F.array_compact(
        F.array(
            F.when(F.coalesce("source_maturity", F.lit("")) != "live_ready", F.lit("source_maturity_not_live_ready")),
            F.when(c("ready_targets") == 0, F.lit("no_ready_targets")),
            F.when(c("parsed_rows") == 0, F.lit("parsed_zero_rows")),
            F.when(c("imported_rows") == 0, F.lit("imported_zero_rows")),
            F.when(c("missing_school_rows") > 0, F.lit("missing_school_id")),
            F.when(c("shown") == 0, F.lit("no_recent_runs")),
            F.when(c("succeeded") == 0, F.lit("no_succeeded_runs")),
            F.when(c("failed") > 0, F.lit("recent_failed_runs")),
            F.when(c("_flagged"), F.lit("logical_name_red_flags")),
        )
    )
    blockers = F.array_sort(F.array_union(F.array_union(blockers, blocking), F.transform("_reasons", lambda r: F.concat(F.lit("reason:"), r))))
    review = F.array_sort(F.array_union(F.array_except("issues", blocking), F.array_compact(F.array(F.when(c("active") > 0, F.lit("active_runs"))))))
    gate = rows.select("manifest", blockers.alias("blockers"), review.alias("review"))
    status = F.when(F.size("blockers") > 0, "blocked").when(F.size("review") > 0, "review").otherwise("ready")
    return gate.withColumn("status", status)
