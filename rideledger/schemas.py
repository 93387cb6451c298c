"""Fixed schemas. Identifiers are text and stay as they came: "007" is not "7"."""

RIDE_BODY = "liftID int, time int, _corrupt_record string"
RIDE_EVENT = "ingest_seq bigint, resortID string, seasonID string, dayID string, skierID string, liftID int, time int"
LATENCY_RECORD = "start_time bigint, request_type string, latency_ms bigint, response_code int"

RESORT_DAY = ["resortID", "seasonID", "dayID"]
SKIER_DAY = [*RESORT_DAY, "skierID"]
#: A ride is one person, place and minute; a later ride with the same key replaces the earlier one.
RIDE_KEY = [*SKIER_DAY, "time"]
