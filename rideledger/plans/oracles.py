"""DuckDB SQL with the same rows as the queries of the same names."""

from rideledger.functions.keys import RIDE_KEYS
from rideledger.operators.rides import BAD_BODY, BAD_IDS
from rideledger.plans.queries import POINT, PREFIX, SEASON, SKIER, STEPS, TICK_MS
from rideledger.rules import UNREADABLE


def _is_int(c: str) -> str:
    return f"(regexp_full_match({c}, '[+-]?[0-9]+') AND TRY_CAST({c} AS INT) IS NOT NULL)"


RAW = """raw AS (
  SELECT event_id AS ingest_seq, CAST((user_id + dayofyear(ts)) % 12 AS VARCHAR) AS resortID,
    CASE WHEN event_id % 89 = 0 THEN '2024' ELSE '2025' END AS seasonID,
    CASE WHEN event_id % 101 = 0 THEN 'day7' ELSE CAST(dayofyear(ts) AS VARCHAR) END AS dayID,
    CAST(user_id AS VARCHAR) AS skierID, CAST(json_extract_string(props, '$.k') AS INT) % 45 AS liftID,
    CASE WHEN event_id % 97 = 0 THEN 361 ELSE 1 + 15 * CAST(hour(ts) AS INT) END AS time
  FROM events)"""
_PLACE = f"coalesce({_is_int('resortID')} AND TRY_CAST(resortID AS INT) BETWEEN 1 AND 10 AND {_is_int('seasonID')} AND TRY_CAST(seasonID AS INT) = 2025 AND {_is_int('dayID')}, false)"
_IDS = f"({_PLACE} AND coalesce({_is_int('skierID')} AND TRY_CAST(skierID AS INT) BETWEEN 1 AND 100000, false))"
_BODY = "coalesce(liftID BETWEEN 1 AND 40 AND time BETWEEN 1 AND 360, false)"
VALID = f"{RAW}, valid AS (SELECT * FROM raw WHERE {_IDS} AND {_BODY})"
TAGGED = f"{RAW}, tagged AS (SELECT *, CASE WHEN NOT {_IDS} THEN '{BAD_IDS}' WHEN NOT {_BODY} THEN '{BAD_BODY}' END AS reject_reason FROM raw)"
_LATEST = """current AS (
  SELECT resortID, seasonID, dayID, skierID, time, arg_max(liftID, ingest_seq) AS liftID, arg_max(liftID, ingest_seq) * 10 AS vertical
  FROM valid GROUP BY resortID, seasonID, dayID, skierID, time)"""
CURRENT = f"{VALID}, {_LATEST}"
SEASONS = f"""valid AS (
  SELECT * FROM (SELECT l_orderkey * 64 + CAST(l_quantity AS INT) AS ingest_seq, CAST(l_suppkey % 10 + 1 AS VARCHAR) AS resortID,
    CAST(year(l_shipdate) AS VARCHAR) AS seasonID, CAST(dayofyear(l_shipdate) % 30 + 1 AS VARCHAR) AS dayID,
    CAST(l_partkey % 500 + 1 AS VARCHAR) AS skierID, CAST(l_quantity AS INT) AS liftID, CAST(l_linenumber * 50 AS INT) AS time
  FROM lineitem) WHERE liftID BETWEEN 1 AND 40), {_LATEST}"""
LATENCY = """records AS (
  SELECT event_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) AS end_ms,
    'POST' AS request_type, CAST(floor(value * 1000) AS BIGINT) AS latency_ms,
    CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 429 ELSE 200 END AS response_code,
    CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 61 = 0 THEN 499 WHEN event_type = 'signup' THEN 429 ELSE 200 END AS ended,
    CASE WHEN dayofyear(ts) <= 5 THEN 1 ELSE 2 END AS phase
  FROM events)"""
_DAY = "resortID, seasonID, dayID, skierID"
_SUMMARY = """count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, CAST(floor(quantile_cont(latency_ms, 0.5)) AS BIGINT) AS median_ms,
  CAST(quantile_disc(latency_ms, 0.99) AS BIGINT) AS p99_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms"""
GAUGE = f"""{LATENCY}, spans AS (
  SELECT phase, CAST(ceil(start_ms / {TICK_MS}) AS BIGINT) AS first, (end_ms - 1) // {TICK_MS} AS last FROM records),
covered AS (SELECT phase, tick, count(*) AS active FROM (SELECT phase, unnest(range(first, last + 1)) AS tick FROM spans WHERE first <= last) GROUP BY ALL),
spine AS (SELECT phase, unnest(range(min(first), max(last) + 1)) AS tick FROM spans GROUP BY phase),
gauge AS (SELECT phase, tick, coalesce(active, 0)::BIGINT AS active FROM spine LEFT JOIN covered USING (phase, tick))"""
_TEXT = "CASE WHEN ingest_seq % 53 = 0 THEN NULL WHEN ingest_seq % 59 = 0 THEN 'n/a' ELSE CAST(liftID * 10 AS VARCHAR) END"
_UNIQUE = "SELECT resortID, seasonID, dayID, count(DISTINCT skierID) AS uniqueNumSkiers FROM current GROUP BY ALL"
_VERTICAL = f"SELECT {_DAY}, sum(vertical)::BIGINT AS totalVertical FROM current GROUP BY ALL"
_JOINED = {name: " || '#' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) for name, parts in RIDE_KEYS.items()}

ORACLES = {
    "ride_url_parse": f"WITH {RAW} SELECT ingest_seq, {_DAY}, '/' || resortID || '/seasons/' || seasonID || '/days/' || dayID || '/skier/' || skierID AS url FROM raw",
    "ride_json_decode": f"WITH {RAW} SELECT ingest_seq, CASE WHEN ingest_seq % 83 <> 0 THEN liftID END AS liftID, CASE WHEN ingest_seq % 83 <> 0 THEN time END AS time, ingest_seq % 83 = 0 AS corrupt FROM raw",
    "ride_envelope_json": f"""WITH {VALID} SELECT ingest_seq, CAST(json_object('resortID', resortID, 'seasonID', seasonID, 'dayID', dayID,
        'skierID', skierID, 'liftID', liftID, 'time', time) AS VARCHAR) AS value FROM valid""",
    "rides_valid": f"WITH {VALID} SELECT * FROM valid",
    "rides_quarantine": f"WITH {TAGGED} SELECT ingest_seq, reject_reason FROM tagged WHERE reject_reason IS NOT NULL",
    "rides_current": f"WITH {CURRENT} SELECT * FROM current",
    "rides_enriched": f"""WITH {CURRENT} SELECT {_DAY}, time, {', '.join(f'{v} AS {k}' for k, v in _JOINED.items())},
        CAST(liftID AS VARCHAR) AS liftID_text, CAST(time AS VARCHAR) AS time_text, CAST(vertical AS VARCHAR) AS vertical_text FROM current""",
    "season_from_key": f"WITH {CURRENT} SELECT {_DAY}, time, {_JOINED['season_day']} AS season_day, split_part({_JOINED['season_day']}, '#', 1) AS season FROM current",
    "prefix_scan": f"WITH {CURRENT} SELECT skierID, {_JOINED['sort_key']} AS sort_key, CAST(vertical AS VARCHAR) AS vertical_text FROM current WHERE starts_with({_JOINED['sort_key']}, '{PREFIX}')",
    "vertical_strict": f"WITH {VALID}, t AS (SELECT *, {_TEXT} AS v FROM valid) SELECT {_DAY}, sum(coalesce(CAST(v AS INT), 0))::BIGINT AS totalVertical FROM t WHERE v IS NULL OR v <> 'n/a' GROUP BY ALL",
    "vertical_lenient": f"""WITH {VALID}, t AS (SELECT *, {_TEXT} AS v FROM valid)
        SELECT skierID, resortID, seasonID, sum(TRY_CAST(v AS INT))::BIGINT AS totalVert, count_if(v IS NOT NULL AND TRY_CAST(v AS INT) IS NULL)::BIGINT AS n_warnings FROM t GROUP BY ALL""",
    "skier_day_vertical": f"WITH {CURRENT} {_VERTICAL}",
    "skier_day_vertical_lookup": f"WITH {CURRENT}, gold AS ({_VERTICAL}) SELECT {_DAY}, coalesce(totalVertical, 0) AS totalVertical FROM (SELECT DISTINCT {_DAY} FROM raw) LEFT JOIN gold USING ({_DAY})",
    "resort_unique_skiers": f"WITH {CURRENT} {_UNIQUE}",
    "resort_unique_lookup": f"""WITH {CURRENT}, gold AS ({_UNIQUE}) SELECT resortID, seasonID, dayID, coalesce(uniqueNumSkiers, 0) AS uniqueNumSkiers
        FROM (SELECT DISTINCT resortID, seasonID, dayID FROM raw WHERE {_PLACE}) LEFT JOIN gold USING (resortID, seasonID, dayID)""",
    "unique_skiers_increment": f"WITH {CURRENT} {_UNIQUE}",
    "skier_resort_season_totals": f"WITH {SEASONS} SELECT skierID, resortID, seasonID, sum(vertical)::BIGINT AS totalVert FROM current GROUP BY ALL",
    "skier_resort_one_season": f"WITH {SEASONS} SELECT skierID, resortID, seasonID, sum(vertical)::BIGINT AS totalVert FROM current WHERE seasonID = '{SEASON}' GROUP BY ALL HAVING sum(vertical) > 0",
    "skier_resort_totals_json": f"""WITH {SEASONS}, t AS (SELECT skierID, resortID, seasonID, sum(vertical)::BIGINT AS totalVert FROM current GROUP BY ALL)
        SELECT skierID, resortID, CAST(to_json({{'resorts': list({{'seasonID': seasonID, 'totalVert': totalVert}} ORDER BY seasonID)}}) AS VARCHAR) AS payload FROM t GROUP BY ALL""",
    "read_request_status": f"""WITH {CURRENT}, t AS (SELECT skierID, resortID, seasonID, sum(vertical) AS total FROM current GROUP BY ALL HAVING sum(vertical) > 0)
        SELECT r.resortID, r.seasonID, r.dayID, r.skierID, CASE WHEN {_PLACE.replace('resortID', 'r.resortID').replace('seasonID', 'r.seasonID').replace('dayID', 'r.dayID')} THEN 200 ELSE 400 END AS unique_status,
          CASE WHEN trim(coalesce(r.skierID, '')) = '' OR trim(coalesce(r.resortID, '')) = '' THEN 400 WHEN t.total IS NULL THEN 404 ELSE 200 END AS totals_status,
          200 AS vertical_status
        FROM (SELECT DISTINCT {_DAY} FROM raw) r LEFT JOIN t ON r.skierID = t.skierID AND r.resortID = t.resortID AND r.seasonID = t.seasonID""",
    "skier_season_days": f"WITH {SEASONS} SELECT skierID, seasonID, count(DISTINCT dayID) AS n_days, sum(vertical)::BIGINT AS totalVert FROM current GROUP BY ALL",
    "resort_day_skiers": f"WITH {SEASONS} SELECT DISTINCT resortID, dayID, skierID FROM current",
    "resort_season_activity": f"WITH {SEASONS} SELECT {_DAY}, count(*) AS n_rides, sum(vertical)::BIGINT AS totalVert FROM current GROUP BY ALL",
    "latency_from_intervals": f"WITH {LATENCY} SELECT event_id, latency_ms FROM records",
    "latency_outcomes": f"WITH {LATENCY} SELECT phase, ended AS response_code, count_if(ended BETWEEN 200 AND 299)::BIGINT AS n_success, count_if(ended NOT BETWEEN 200 AND 299)::BIGINT AS n_failure FROM records GROUP BY ALL",
    "latency_summary": f"WITH {LATENCY} SELECT phase, {_SUMMARY} FROM records GROUP BY phase",
    "latency_csv_roundtrip": f"WITH {LATENCY} SELECT request_type, response_code, {_SUMMARY} FROM records GROUP BY request_type, response_code",
    "phase_throughput": f"WITH {LATENCY} SELECT phase, count(*) AS n, round(count(*) / ((max(end_ms) - min(start_ms)) / 1000), 6) AS per_second FROM records GROUP BY ROLLUP (phase)",
    "active_requests_gauge": f"WITH {GAUGE} SELECT * FROM gauge",
    "littles_law": f"""WITH {GAUGE}, a AS (SELECT phase, avg(active) AS active FROM gauge GROUP BY ROLLUP (phase)),
        t AS (SELECT phase, avg(latency_ms) / 1000 AS s FROM records GROUP BY ROLLUP (phase))
        SELECT t.phase, round(coalesce(active, 0.0), 6) AS avg_active, round(CASE WHEN s > 0 THEN coalesce(active, 0.0) / s END, 6) AS per_second
        FROM t LEFT JOIN a ON t.phase IS NOT DISTINCT FROM a.phase""",
    "ingest_stats": f"WITH {TAGGED} SELECT coalesce(reject_reason, 'accepted') AS result, count(*) AS n, min(ingest_seq) AS first_seq, max(ingest_seq) AS last_seq FROM tagged GROUP BY 1",
    "stream_bronze": f"WITH {TAGGED} SELECT ingest_seq, {_DAY}, time, liftID, reject_reason FROM tagged",
    "stream_ingest_counters": f"""WITH {TAGGED} SELECT count_if(reject_reason IS NULL)::BIGINT AS accepted, count_if(reject_reason = '{BAD_IDS}')::BIGINT AS bad_ids,
        count_if(reject_reason = '{BAD_BODY}')::BIGINT AS bad_body, 0::BIGINT AS unreadable, {STEPS - 1}::BIGINT AS first_files_left, 0::BIGINT AS last_files_left FROM tagged""",
    "stream_dead_letters": f"""WITH {TAGGED}, lines AS (SELECT *, CAST(json_object('ingest_seq', ingest_seq, 'resortID', resortID, 'seasonID', seasonID, 'dayID', dayID,
        'skierID', skierID, 'liftID', liftID, 'time', time) AS VARCHAR) AS line FROM tagged)
        SELECT CASE WHEN ingest_seq % 83 = 0 THEN left(line, length(line) - 1) ELSE line END AS value, CASE WHEN ingest_seq % 83 = 0 THEN '{UNREADABLE}' ELSE reject_reason END AS reject_reason
        FROM lines WHERE ingest_seq % 83 = 0 OR reject_reason IS NOT NULL""",
    "stream_redelivered": f"WITH {VALID} SELECT ingest_seq, {_DAY}, time, liftID FROM valid",
    "stream_published": f"WITH {VALID} SELECT ingest_seq, {_DAY}, time, liftID FROM valid",
    "stream_to_marts": f"WITH {CURRENT} {_VERTICAL}",
    "blank_ids": r"""WITH padded AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || chr(9) || chr(13) || chr(10)
        WHEN 3 THEN chr(1) || chr(31) || ' ' WHEN 4 THEN chr(160) WHEN 5 THEN chr(9) || user_id || ' ' ELSE user_id::VARCHAR END AS padded FROM events)
        SELECT event_id AS ingest_seq, coalesce(regexp_full_match(padded, '[\x00-\x20]*'), true) AS is_blank FROM padded""",
    "rides_compacted": f"WITH {CURRENT} SELECT * FROM current",
    "mart_skier_days": f"WITH {CURRENT}, v AS ({_VERTICAL}) SELECT * FROM v WHERE resortID = '{POINT[0]}' AND seasonID = '{POINT[1]}' AND skierID = '{SKIER}'",
    "unique_skiers_tracked": f"WITH {CURRENT} {_UNIQUE}",
    "stream_unique_skiers_within": f"WITH {CURRENT} {_UNIQUE}",
    "mart_lookups": f"""WITH {CURRENT}, v AS ({_VERTICAL}), u AS ({_UNIQUE})
        SELECT {_DAY}, coalesce(totalVertical, 0) AS totalVertical, coalesce(uniqueNumSkiers, 0) AS uniqueNumSkiers
        FROM (SELECT DISTINCT {_DAY} FROM raw) LEFT JOIN v USING ({_DAY}) LEFT JOIN u USING (resortID, seasonID, dayID)""",
    "mart_season_totals": f"WITH {CURRENT} SELECT skierID, resortID, seasonID, sum(vertical)::BIGINT AS totalVert FROM current WHERE resortID = '{POINT[0]}' AND seasonID = '{POINT[1]}' GROUP BY ALL",
    "skier_season_listing": f"""WITH {SEASONS} SELECT skierID, seasonID, CAST(row_number() OVER (PARTITION BY skierID, seasonID ORDER BY TRY_CAST(dayID AS INT), time, resortID, dayID) AS INT) AS position,
        resortID, dayID, time, liftID, vertical FROM current""",
    "latency_report": f"WITH {LATENCY} SELECT phase, response_code, count(*) AS n, printf('%.2f', avg(latency_ms)) AS mean_text FROM records GROUP BY phase, response_code",
    "synthetic_rides": """WITH made AS (SELECT CAST(((event_id * 2654435761 + 40503 + 104729) % 4294967296) // 64 % 100000 + 1 AS INT) AS skier,
          CAST(((event_id * 2654435761 + 40503 + 3 * 104729) % 4294967296) // 64 % 360 + 1 AS INT) AS time FROM events)
        SELECT time, count(*) AS n_rides, count(DISTINCT skier) AS n_skiers FROM made GROUP BY time""",
    "stream_unique_skiers": f"WITH {CURRENT} {_UNIQUE}",
    "stream_rides_current": f"WITH {CURRENT} SELECT * FROM current",
    "stream_day_vertical": f"WITH {CURRENT} {_VERTICAL}",
}
