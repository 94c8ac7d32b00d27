"""Explicit schemas; nothing is ever inferred."""

TRAILS = "trail_id string, name string, aka array<string>, corridor string, current_status string, notes string"
ALIGNMENTS = "alignment_id string, trail_id string, earliest_known_open string, latest_known_open string, earliest_known_closed string, latest_known_closed string, superseded_by string"
OBSERVATIONS = "observation_id string, date_start string, date_end string, sensitivity string"
SUPPORT = "alignment_id string, observation_id string, role string, confidence string, note string"
# Columns of the source index, in file order.
INDEX_COLUMNS = [
    "topo_id", "map_name", "scale", "extent", "date_on_map", "content_year", "imprint_year", "aerial_photo_year", "photo_revision_year",
    "field_check_year", "edit_year", "photo_inspection_year", "survey_year", "woodland_tint", "scanner_resolution", "datum", "projection",
    "west", "south", "east", "north", "in_tier1", "size_bytes", "rights", "geotiff_url", "metadata_url", "sciencebase_url", "source_id",
]
INDEX = ", ".join(f"{c} string" for c in INDEX_COLUMNS)
FEATURES = "type string, crs struct<properties:struct<name:string>>, features array<string>"
RECEIPT = "version int, kind string, source string, topo_id string, source_id string, indexed_url string, retrieval_url string, metadata_url string, rights string, sha256 string, byte_count long, raw_path string, retrieved_at string, recorded_at string, basis string"
EVENTS = "session string, seq long, type string, edition_id string, source_id string, message string, source_loaded boolean, generation long, viewport_token long"
