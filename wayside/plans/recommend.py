"""The recommendation batch: requests in; items, headers and errors out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.config import DEFAULT_CONFIG, RankingConfig
from wayside.operators import context, ranking, retrieval
from wayside.session import settle


@dataclass
class Tables:
    """Inputs of a batch; every field is a table of the data model."""

    schools: DataFrame
    stations: DataFrame
    lines: DataFrame
    areas: DataFrame
    links: DataFrame
    line_adjacencies: DataFrame
    area_adjacencies: DataFrame
    events: DataFrame
    user_events: DataFrame
    profiles: DataFrame
    popularity: DataFrame
    area_affinity: DataFrame
    user_affinity: DataFrame


class Recommendation:
    """All steps of one batch; each is built once and only when asked for.

    Lineage is cut where several branches read one result: the resolved
    requests, their signatures, the enriched links, the candidates per
    signature, the columns of places, the scored links and the picks.
    """

    def __init__(self, requests: DataFrame, tables: Tables, as_of: Column, cfg: RankingConfig = DEFAULT_CONFIG, use_recent: bool = True):
        self.requests, self.t, self.as_of, self.cfg, self.use_recent = requests, tables, as_of, cfg, use_recent

    @cached_property
    def context(self) -> DataFrame:
        t = self.t
        return settle(
            context.resolve_context(
                self.requests, t.stations, t.lines, t.areas, t.links, t.schools, t.user_events, t.profiles, self.as_of, self.use_recent
            )
        )

    @cached_property
    def targets(self) -> DataFrame:
        t = self.t
        return context.station_for_context(self.context, t.stations, t.links, t.schools, t.areas)

    @cached_property
    def rows(self) -> DataFrame:
        """Requests with target station, graph origins and signature."""
        return settle(retrieval.with_signature(self.targets, self.t.areas, self.cfg))

    @cached_property
    def signatures(self) -> DataFrame:
        return settle(retrieval.distinct_signatures(self.rows, self.t.line_adjacencies, self.t.area_adjacencies))

    @cached_property
    def enriched(self) -> DataFrame:
        t = self.t
        return settle(retrieval.enrich_links(t.links, t.stations, t.schools, t.areas))

    @cached_property
    def lists(self) -> retrieval.Candidates:
        return retrieval.candidate_lists(self.signatures, self.enriched, self.cfg)

    @cached_property
    def candidates(self) -> DataFrame:
        return retrieval.candidate_rows(self.lists)

    @cached_property
    def dims(self) -> DataFrame:
        """School and station columns, looked up once per school and station instead of once per candidate."""
        return settle(ranking.attach_dims(self.enriched.select("school_id", "station_id").distinct(), self.t.schools, self.t.stations))

    @cached_property
    def places(self) -> DataFrame:
        """``dims`` with the snapshot columns."""
        return settle(ranking.attach_snapshots(self.dims, self.t.popularity, self.t.area_affinity))

    @cached_property
    def planned(self) -> tuple[DataFrame, DataFrame]:
        cands = retrieval.placed_links(self.lists, self.signatures, self.places)
        return ranking.plan_candidates(self.signatures, cands, self.cfg)

    @cached_property
    def classes(self) -> tuple[DataFrame, DataFrame]:
        usable = self.rows.where(F.col("target_latitude").isNotNull())
        return ranking.request_classes(usable, self.t.user_affinity, self.cfg)

    @cached_property
    def scored(self) -> DataFrame:
        """``base`` as it streams, for who reads it once."""
        _, selected = self.planned
        _, classes = self.classes
        return ranking.base_scores(selected, classes, self.t.user_affinity, self.cfg)

    @cached_property
    def base(self) -> DataFrame:
        return settle(self.scored)

    @cached_property
    def visible(self) -> DataFrame:
        return ranking.visible_events(self.t.events, self.cfg)

    @cached_property
    def picks(self) -> DataFrame:
        _, classes = self.classes
        return settle(ranking.pick_items(self.base, classes, self.visible, self.cfg))

    @cached_property
    def shown(self) -> DataFrame:
        """The picked links with all their evidence."""
        plans, _ = self.planned
        _, classes = self.classes
        links = retrieval.named_links(self.lists, self.signatures, ranking.picked_keys(self.picks, classes))
        return ranking.picked_links(links.join(self.places, ["school_id", "station_id"]), plans, self.cfg)

    @cached_property
    def class_items(self) -> DataFrame:
        _, classes = self.classes
        return ranking.describe_items(self.picks, self.shown, classes, self.t.user_affinity, self.t.events, self.cfg)

    def items(self) -> DataFrame:
        """One row per request and position."""
        mapping, _ = self.classes
        return mapping.select("request_id", "class_id").join(self.class_items, "class_id").drop("class_id", "labels")

    @cached_property
    def class_headers(self) -> DataFrame:
        _, classes = self.classes
        plans, _ = self.planned
        return ranking.describe_results(self.picks, self.class_items, self.base, self.visible, classes, plans, self.cfg)

    def headers(self) -> DataFrame:
        """One row per answered request."""
        mapping, _ = self.classes
        return mapping.select("request_id", "class_id").join(self.class_headers, "class_id").drop("class_id")

    def errors(self) -> DataFrame:
        """Requests without an answer, with the reason."""
        c = F.col
        mapping, _ = self.classes
        answered = mapping.join(self.picks.select("class_id"), "class_id", "left_semi").select("request_id")
        bad = self.rows.join(answered, "request_id", "left_anti")
        why = (
            F.when(c("error").isNotNull(), c("error"))
            .when(c("target_latitude").isNull(), F.concat(F.lit("unknown station: "), F.coalesce("target_station_id", F.lit(""))))
            .otherwise(F.concat(F.lit("no candidates available for station: "), "target_station_id"))
        )
        return bad.select("request_id", why.alias("error"))


def recommend(requests: DataFrame, tables: Tables, as_of: Column, cfg: RankingConfig = DEFAULT_CONFIG, use_recent: bool = True):
    """Items, headers and errors of a batch of requests."""
    batch = Recommendation(requests, tables, as_of, cfg, use_recent)
    return batch.items(), batch.headers(), batch.errors()
