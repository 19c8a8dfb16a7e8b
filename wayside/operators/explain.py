"""Reason catalog and explanation texts.  All texts are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.config import CORE_REASONS, DEFAULT_LABEL, KIND_LABELS, PLACEMENT_LABELS, STAGE_ITEM_TEXT
from wayside.functions.text import non_blank

STAGE_RESULT_TEXT = {
    "strict_station": "{station} 直結の候補群",
    "same_line": "{line} 沿線の候補群",
    "same_city": "同一市区町村の候補群",
    "same_prefecture": "同一都道府県の候補群",
    "neighbor_area": "{station} 近傍まで広げた候補群",
    "safe_global_popular": "広域人気を距離で抑制した候補群",
}


def fill(template: str, **values: Column) -> Column:
    """A text with ``{name}`` places filled from columns."""
    parts, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(head), values[name]] if head else [values[name]]
    return F.concat(*parts, F.lit(rest)) if parts else F.lit(rest)


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    """A small constant table as a CASE over its keys."""
    out = default
    for name, value in table.items():
        branch = value if isinstance(value, Column) else F.lit(value)
        out = F.when(key == name, branch) if out is None else out.when(key == name, branch)
    return out


def core_catalog(spark: SparkSession) -> DataFrame:
    rows = [(f, code, label) for f, (code, label) in CORE_REASONS.items()]
    return spark.createDataFrame(rows, "feature string, reason_code string, label string")


def merge_catalog(core: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Core reasons with profile labels laid over them, and the rejected rows.

    A profile row may rename a label or add a feature, but not move a core
    feature to another code, repeat a feature or reuse a taken code.
    """
    c = F.col
    sized = profile.groupBy("feature").agg(F.count(F.lit(1)).alias("_copies"))
    joined = profile.join(sized, "feature").join(core.select("feature", c("reason_code").alias("_core")), "feature", "left")
    reason = F.coalesce(
        *[F.when(non_blank(n).isNull(), F.lit(f"empty {n}")) for n in ("feature", "reason_code", "label")],
        F.when(c("_copies") > 1, F.lit("duplicate feature")),
        F.when(c("_core").isNotNull() & (c("_core") != c("reason_code")), F.lit("stable reason_code changed")),
    )
    checked = joined.withColumn("reason", reason)
    sound = checked.where(c("reason").isNull()).select("feature", "reason_code", "label")
    merged = core.join(sound.select("feature"), "feature", "left_anti").select("feature", "reason_code", "label").unionByName(sound)
    taken = merged.groupBy("reason_code").agg(F.count(F.lit(1)).alias("_n"), F.min("feature").alias("_first"))
    clash = merged.join(taken.where("_n > 1"), "reason_code")
    late = clash.join(core.select("feature"), "feature", "left_anti")
    rejected = checked.where(c("reason").isNotNull()).select("feature", "reason_code", "label", "reason").unionByName(
        late.select("feature", "reason_code", "label", F.lit("duplicate reason_code").alias("reason"))
    )
    return merged.join(late.select("feature"), "feature", "left_anti"), rejected


def label_of(feature: Column, labels: dict[str, str] | None = None) -> Column:
    table = {f: label for f, (_, label) in CORE_REASONS.items()} | (labels or {})
    return F.coalesce(lookup(table, feature), F.lit(DEFAULT_LABEL))


def top_labels(components: Column, labels: dict[str, str] | None = None) -> Column:
    """Up to two distinct labels of the largest positive components."""
    positive = F.filter(components, lambda x: x["value"] > 0)
    ordered = F.array_sort(F.transform(positive, lambda x: F.struct((-x["value"]).alias("v"), x["feature"].alias("f"))))
    names = F.array_distinct(F.transform(ordered, lambda x: label_of(x["f"], labels)))
    return F.when(F.size(names) == 0, F.array(F.lit(DEFAULT_LABEL))).otherwise(F.slice(names, 1, 2))


def join_labels(labels: Column) -> Column:
    return F.when(F.size(labels) > 2, F.array_join(labels, "、")).otherwise(F.array_join(labels, " と "))


def item_explanation(kind: Column, stage: Column, labels: Column) -> Column:
    return F.concat(
        join_labels(labels), F.lit(" が効き、"), lookup(STAGE_ITEM_TEXT, stage), F.lit("の"), lookup(KIND_LABELS, kind), F.lit("として上位になりました。")
    )


def diversity_sentence(selected: Column, school: Column, group: Column, kind_school: Column, kind_event: Column) -> Column:
    """What the diversity caps held back; empty when nothing was."""

    def part(label: str, n: Column) -> Column:
        return F.when(n > 0, F.concat(F.lit(label), n.cast("string"), F.lit("件")))

    parts = F.array_compact(
        F.array(
            part("同一学校", school),
            part("同一グループ", group),
            part(KIND_LABELS["school"], kind_school),
            part(KIND_LABELS["event"], kind_event),
        )
    )
    text = F.concat(
        F.lit(" 多様性上限で"), join_labels(parts), F.lit("を抑制し、"), selected.cast("string"), F.lit("件の表示枠に整えています。")
    )
    return F.when(F.size(parts) > 0, text).otherwise(F.lit(""))


def result_explanation(placement: Column, stage: Column, station: Column, line: Column, labels: Column, sentence: Column) -> Column:
    pool = lookup({s: fill(t, station=station, line=line) for s, t in STAGE_RESULT_TEXT.items()}, stage)
    return F.concat(
        lookup(PLACEMENT_LABELS, placement), F.lit("では "), pool, F.lit(" を母集団にし、"), join_labels(labels),
        F.lit(" を効かせて決定論的に順位付けしました。"), sentence,
    )
