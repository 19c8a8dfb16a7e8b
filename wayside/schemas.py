"""Explicit schemas of the files that are read; nothing is inferred."""

EVENT_FEED = (
    "event_id string, school_id string, title string, event_category string, is_open_day string, is_featured string, "
    "priority_weight string, starts_at string, placement_tags string"
)
RAIL = "station_code string, station_name string, line_name string, prefecture_name string, latitude double, longitude double"
POSTAL = "postal_code string, prefecture_name string, city_name string, town_name string"
SCHOOL_CODES = "school_code string, name string, prefecture_name string, city_name string, school_type string"
SCHOOL_GEODATA = SCHOOL_CODES + ", address string, latitude double, longitude double"
STATIONS = "station_id string, name string, line_name string, latitude double, longitude double"
SCHOOLS = "school_id string, name string, area string, prefecture_name string, school_type string, group_id string"
LINKS = "school_id string, station_id string, walking_minutes short, distance_meters int, hop_distance short, line_name string"
LOG = (
    "user_id string, school_id string, event_kind string, event_id string, target_station_id string, occurred_at string, payload string"
)
PAGES = "url string, html string, content_type string, logical_name string"
JSON_FEED_ROW = (
    "struct<pageTitle:string,title:string,eventStartDate:string,eventEndDate:string,eventType:string,eventTarget:string,"
    "eventArea:string,eventApp:string,busho:string,url:string>"
)
EVENT = (
    "event_id string, school_id string, title string, event_category string, is_open_day boolean, is_featured boolean, "
    "priority_weight double, starts_at string, placement_tags string, details string"
)
