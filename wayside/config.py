"""Ranking configuration.

The numbers, code lists and labels below are fixed values: results depend on
them and they must not be changed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

PLACEMENTS = ("home", "search", "detail", "mypage")
EVENT_KINDS = ("school_view", "school_save", "event_view", "apply_click", "share", "search_execute")
AREA_CONFLICT = "station_area_conflict"

# stage name -> priority, in ladder order
STAGES = (
    "strict_station",
    "same_line",
    "same_city",
    "same_prefecture",
    "neighbor_area",
    "safe_global_popular",
)

# feature -> (reason code, label)
CORE_REASONS = {
    "direct_station_bonus": ("geo.direct_station", "直結条件"),
    "line_match_bonus": ("geo.line_match", "沿線一致"),
    "school_station_distance": ("geo.station_distance", "駅からの近さ"),
    "walking_minutes": ("geo.walking_minutes", "徒歩分数"),
    "neighbor_station_proximity": ("geo.neighbor_station_proximity", "近傍駅との距離"),
    "open_day_bonus": ("event.open_day", "公開イベント"),
    "featured_event_bonus": ("event.featured", "注目イベント"),
    "event_priority_boost": ("event.priority", "運用優先度"),
    "popularity_snapshot_bonus": ("behavior.popularity", "最近の人気"),
    "area_affinity_bonus": ("behavior.area_affinity", "エリア需要"),
    "user_affinity_bonus": ("behavior.user_affinity", "ユーザー反応"),
    "content_kind_boost": ("placement.content_kind_boost", "配置調整"),
    "neighbor_area_penalty": ("fallback.neighbor_area_penalty", "近隣エリア調整"),
    "safe_global_distance_penalty": ("fallback.safe_global_distance_penalty", "遠距離抑制"),
}
DEFAULT_LABEL = "固定重み"

PLACEMENT_LABELS = {"home": "ホーム", "search": "検索", "detail": "詳細", "mypage": "マイページ"}
STAGE_ITEM_TEXT = {
    "strict_station": "指定駅直結",
    "same_line": "同一路線",
    "same_city": "同一市区町村",
    "same_prefecture": "同一都道府県",
    "neighbor_area": "近隣エリア",
    "safe_global_popular": "安全な広域fallback",
}
KIND_LABELS = {"school": "学校候補", "event": "イベント候補"}

# behaviour weights per log kind
EVENT_WEIGHTS = {
    "school_view": 1.0,
    "event_view": 0.75,
    "school_save": 2.0,
    "apply_click": 2.5,
    "share": 1.5,
}


@dataclass(frozen=True)
class Placement:
    name: str
    neighbor_max_hops: int
    same_line_bonus: float
    school_boost: float
    event_boost: float
    featured_bonus: float
    priority_weight: float
    school_ratio: float | None
    event_ratio: float | None
    same_school_cap: int = 1
    same_group_cap: int = 2
    kinds: tuple[str, ...] = ("school", "event")


PLACEMENT_DEFAULTS = (
    Placement("home", 3, 0.9, 0.0, 0.95, 0.45, 0.9, 0.67, 0.67),
    Placement("search", 3, 0.95, 0.35, 0.1, 0.2, 0.6, 0.8, 0.5),
    Placement("detail", 2, 0.8, 0.15, 0.75, 0.35, 1.0, 0.67, 0.67),
    Placement("mypage", 3, 0.9, 0.25, 0.55, 0.3, 0.85, 0.67, 0.67),
)


@dataclass(frozen=True)
class RankingConfig:
    limit_default: int = 3
    limit_max: int = 20
    strict_min_candidates: int = 2
    direct_station_bonus: float = 3.0
    line_match_bonus: float = 1.25
    distance_scale_meters: float = 1600.0
    walking_scale_minutes: float = 20.0
    min_results: int = 2
    neighbor_penalty: float = 0.8
    neighbor_cap_meters: float = 2500.0
    open_day_bonus: float = 0.6
    popularity_weight: float = 0.75
    user_affinity_weight: float = 0.9
    area_affinity_weight: float = 0.35
    search_school_weight: float = 0.4
    search_area_weight: float = 0.2
    retrieval_limit: int = 256
    retrieval_limit_max: int = 10_000
    interchange_meters: float = 250.0
    walkable_meters: float = 1000.0
    ladder: tuple[str, ...] = STAGES
    placements: tuple[Placement, ...] = PLACEMENT_DEFAULTS
    profile_version: str = "default"
    algorithm_version: str = "1"

    @property
    def minimum_candidates(self) -> int:
        return max(self.strict_min_candidates, self.min_results)

    @property
    def candidate_limit(self) -> int:
        if not 1 <= self.retrieval_limit <= self.retrieval_limit_max:
            raise ValueError(f"retrieval_limit must lie between 1 and {self.retrieval_limit_max}")
        return self.retrieval_limit


DEFAULT_CONFIG = RankingConfig()
