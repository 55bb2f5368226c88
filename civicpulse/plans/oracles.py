"""The same results in SQL, for an independent engine over the same tables."""

from __future__ import annotations

from civicpulse.functions.fixed_values import SUMMARY_API_VERSION, SUMMARY_PREFIXES, SUMMARY_PROMPT
from civicpulse.plans.queries import SELECTED_DAY, SELECTED_TOPIC, UNMAPPED_DAY, UNMAPPED_TOPIC
from civicpulse.plans.standins import (
    MAP_CODES,
    RESPONSE_OPENINGS,
    UNREADABLE_FROM,
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _trim(value: str) -> str:
    return rf"regexp_replace({value}, '^\s+|\s+$', '', 'g')"


def _two_places(value: str) -> str:
    return f"round_even({value} * 100, 0) / 100"


# Stand-in tables -------------------------------------------------------------------------------

TREND_LONG = """
trend_long AS (
  SELECT o_orderdate::date AS date, o_orderpriority AS topic_name, r_name AS region,
         array_to_string(list_transform(string_split(r_name, ' '),
                                        lambda w: upper(w[1]) || lower(w[2:])), ' ') AS region_name,
         o_totalprice::decimal(18,2) AS interest_value, o_orderkey AS row_id
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CODES = "codes(region, region_code) AS (VALUES " + ", ".join(
    f"('{name}', '{code}')" for name, code in MAP_CODES.items()
) + ")"

SHAPES = "shapes AS (SELECT 'R' || r_regionkey AS region_code, r_name AS region_name FROM region)"

SERIES = """
series AS (
  SELECT event_type AS topic, ts::date AS date, count(*) AS value FROM events GROUP BY ALL)"""

STATISTICS = SERIES + """,
statistics AS (
  SELECT topic, min(date) AS first_date, max(date) AS last_date,
         sum(value)::double / count(value) AS average, max(value)::double AS peak,
         arg_max(value, date)::double AS current
  FROM series GROUP BY topic),
peaks AS (
  SELECT topic, min(date) AS peak_date
  FROM series JOIN statistics USING (topic) WHERE value = peak GROUP BY topic)"""

DIRECTION = """
recent AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY date DESC) AS rn FROM series),
means AS (
  SELECT topic, count(*) AS points, avg(value) FILTER (rn <= 4) AS recent_average,
         avg(value) FILTER (rn > 4) AS previous_average
  FROM recent WHERE rn <= 8 GROUP BY topic),
direction AS (
  SELECT *, CASE WHEN points < 8 THEN '→ Insufficient data'
                 WHEN recent_average > previous_average THEN '↑ Increasing'
                 WHEN recent_average < previous_average THEN '↓ Decreasing'
                 ELSE '→ Stable' END AS trend
  FROM means)"""

MARKS = """
marks(event, event_date) AS (
  VALUES ('Mid January', date '2024-01-15'), ('UK General Election', date '2024-07-04'))"""

REGION_INTEREST = """
region_interest AS (
  SELECT event_type AS topic, n_name AS region, count(*) AS interest
  FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL),
top_regions AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY interest DESC, region) AS rank
  FROM region_interest QUALIFY rank <= 10)"""

RELATED = """
related AS (
  SELECT event_type AS topic, CASE WHEN value >= 10 THEN 'rising' ELSE 'top' END AS kind,
         'k' || json_extract_string(props, '$.k') AS query, count(*) AS value
  FROM events GROUP BY ALL),
top_queries AS (
  SELECT *, row_number() OVER (PARTITION BY topic, kind ORDER BY value DESC, query) AS rank
  FROM related QUALIFY rank <= 10)"""

POSTS = """
posts AS (
  SELECT event_type AS topic, ts AS created_at, ts::date AS day, strftime(ts, '%B %Y') AS month,
         'u' || user_id AS author, props || chr(10) || 'no. ' || event_id AS text,
         round(value * 100)::bigint AS likes, user_id AS reposts, event_id AS replies
  FROM events)"""

CENTROIDS = f"""
points AS (
  SELECT vec_id, label, (vec_id % 5, i) IN ((1, 3), (2, 5), (3, 6)) AS odd, CASE WHEN i < vec_id % 17 + 8 THEN 0 ELSE 1 END AS polygon,
         embedding[2 * i + 1]::double AS lon, embedding[2 * i + 2]::double AS lat
  FROM (SELECT *, unnest(range(0, len(embedding) // 2)) AS i FROM embeddings)),
rings AS (
  SELECT vec_id, label, polygon, count(*) AS n,
         avg(lat) FILTER (lon < {UNREADABLE_FROM} AND NOT odd) AS lat,
         avg(lon) FILTER (lon < {UNREADABLE_FROM} AND NOT odd) AS lon
  FROM points WHERE vec_id % 2 = 0 OR polygon = 0 GROUP BY ALL),
outer_rings AS (
  SELECT * FROM rings WHERE lat IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, polygon) = 1),
centroids AS (
  SELECT 'R' || label AS region_code, round(lat, 9) AS lat, round(lon, 9) AS lon
  FROM outer_rings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) = 1)"""

WEEKLY_BY_CODE = """
weekly AS (
  SELECT topic_name, region_code, date_trunc('week', date)::date AS week,
         sum(interest_value)::double / count(*) AS interest_value
  FROM trend_long JOIN codes USING (region) GROUP BY ALL)"""

HEAT_POINTS = f"{TREND_LONG}, {CODES}, {CENTROIDS}, {WEEKLY_BY_CODE}" + """,
frames AS (
  SELECT *, min(interest_value) OVER (PARTITION BY topic_name, week) AS low,
         max(interest_value) OVER (PARTITION BY topic_name, week) AS high
  FROM weekly JOIN centroids USING (region_code)),
heat AS (
  SELECT topic_name, week, strftime(week, '%Y-%m-%d') AS label, region_code, lat, lon,
         CASE WHEN high > low THEN round((interest_value - low) / (high - low) * 100, 6)
              ELSE 0.0::double END AS weight
  FROM frames)"""

VALUES_MEAN = """
region_means AS (
  SELECT topic_name, date, region, sum(interest_value)::double / count(*) AS interest_value
  FROM trend_long GROUP BY ALL)"""

VALUES_SUM = """
region_sums AS (
  SELECT topic_name, date, region, sum(interest_value)::double AS interest_value
  FROM trend_long GROUP BY ALL)"""


def _choropleth(values: str) -> str:
    """All shapes with their rows of ``values(topic_name, date, region_name, interest_value)``."""
    return f"""
WITH {TREND_LONG}, {CODES}, {SHAPES}, {VALUES_MEAN}, {VALUES_SUM}, bound AS ({values})
SELECT topic_name, date, region_code, region_name, interest_value,
       region_name || ' (' || region_code || ') — ' ||
       coalesce(printf('%.1f', interest_value), '') AS tooltip
FROM shapes LEFT JOIN bound USING (region_name)"""


def _selected(topic: str, day: str) -> str:
    """All shapes for a topic and day: the fill by code, the tooltip's value by name."""
    return f"""
SELECT region_code, region_name, fill.v AS interest_value, '{day}' AS day,
       region_name || ' (' || region_code || ') — ' || coalesce(printf('%.1f', tip.v), '') AS tooltip
FROM shapes
LEFT JOIN (SELECT region_code, avg(interest_value::double) AS v FROM trend_long JOIN codes USING (region)
           WHERE topic_name = '{topic}' AND date = date '{day}' GROUP BY region_code) fill USING (region_code)
LEFT JOIN (SELECT region AS region_name, avg(interest_value::double) AS v FROM trend_long
           WHERE topic_name = '{topic}' AND date = date '{day}' GROUP BY region) tip USING (region_name)"""


def _lenient(value: str) -> str:
    return f"""
WITH cells AS (
  SELECT CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts::date END AS date,
         event_type AS topic_name,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'u' || (user_id % 20) END AS region,
         CASE WHEN event_id % 10 = 0 OR event_id % 11 = 0 THEN NULL ELSE {value} END AS interest_value,
         event_id AS row_id
  FROM events)
SELECT date, topic_name, region, region AS region_name, interest_value, row_id FROM cells
WHERE date IS NOT NULL AND region IS NOT NULL AND interest_value IS NOT NULL"""


# Visible text: drop scripts and styles, split at tags and comments, decode, trim, join.
def _visible(html: str) -> str:
    decoded = "x"
    # A reference cut off by a tag lacks its semicolon, and is one all the same.
    for entity, character in [("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")]:
        decoded = f"regexp_replace({decoded}, '&{entity}(;|$)', '{character}', 'g')"
    return rf"""
array_to_string(list_filter(list_transform(
  regexp_split_to_array(
    regexp_replace({html}, '(?s)<script.*?</script>|<style.*?</style>', '<cut>', 'g'),
    '(?s)<!--.*?-->|<[^>]*>'),
  lambda x: {_trim(decoded)}), lambda x: x <> ''), ' ')"""


_PREFIXES = "|".join(p.replace("'", "''") for p in SUMMARY_PREFIXES)


def _summary(text: str) -> str:
    return rf"regexp_replace(nullif({_trim(text)}, ''), '(?i)^({_PREFIXES})\s*', '')"


_OPENING = "[{}][turn % {} + 1]".format(
    ", ".join(_text(p) for p in RESPONSE_OPENINGS), len(RESPONSE_OPENINGS)
)
_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"

# Oracles ---------------------------------------------------------------------------------------

ORACLES = {
    "region_values_mean": f"WITH {TREND_LONG}, {VALUES_MEAN} SELECT * FROM region_means",
    "region_values_sum": f"WITH {TREND_LONG}, {VALUES_SUM} SELECT * FROM region_sums",
    "region_values_latest": f"""
WITH {TREND_LONG}
SELECT topic_name, region, date, interest_value::double AS interest_value FROM trend_long
QUALIFY row_number() OVER (PARTITION BY topic_name, region ORDER BY date DESC, row_id DESC) = 1""",
    "region_values_latest_of_day": f"""
WITH {TREND_LONG}
SELECT topic_name, date, region, max(interest_value)::double AS interest_value
FROM trend_long GROUP BY ALL""",
    "select_topic_day": f"""
WITH {TREND_LONG}
SELECT * FROM trend_long WHERE topic_name = '{SELECTED_TOPIC}' AND date = date '{SELECTED_DAY}'
ORDER BY region, row_id LIMIT 50""",
    "region_lookup": f"""
WITH {TREND_LONG}, {CODES}, {VALUES_MEAN}
SELECT region_means.*, region_code FROM region_means LEFT JOIN codes USING (region)""",
    "region_map_values": f"""
WITH {TREND_LONG}, {CODES}, {VALUES_SUM}
SELECT region_sums.*, region_code FROM region_sums JOIN codes USING (region)""",
    "choropleth": _choropleth(
        "SELECT topic_name, date, region AS region_name, interest_value "
        "FROM region_means JOIN codes USING (region)"
    ),
    "choropleth_by_name": _choropleth(
        "SELECT topic_name, date, region AS region_name, interest_value FROM region_sums"
    ),
    "choropleth_selected": f"""
WITH {TREND_LONG}, {CODES}, {SHAPES}
{_selected(SELECTED_TOPIC, SELECTED_DAY)} UNION ALL {_selected(UNMAPPED_TOPIC, UNMAPPED_DAY)}""",
    "mapped_values": f"""
WITH {TREND_LONG}, {CODES}, known AS (SELECT * FROM trend_long JOIN codes USING (region))
SELECT 'mean' AS how, topic_name, date, region_code, sum(interest_value)::double / count(*) AS interest_value
FROM known GROUP BY ALL
UNION ALL
SELECT 'sum', topic_name, date, region_code, sum(interest_value)::double FROM known GROUP BY ALL
UNION ALL
SELECT 'latest', topic_name, date, region_code, interest_value::double FROM known
QUALIFY row_number() OVER (PARTITION BY topic_name, region_code ORDER BY date DESC, row_id DESC) = 1""",
    "preview_topic": f"""
WITH {TREND_LONG}
SELECT * FROM trend_long WHERE topic_name = '{SELECTED_TOPIC}' ORDER BY region, row_id LIMIT 50""",
    "melt_measures": """
UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax FROM lineitem)
ON l_quantity, l_discount, l_tax INTO NAME measure VALUE interest_value""",
    "union_columns": """
SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, NULL::double AS balance FROM customer
UNION ALL SELECT s_name, NULL, NULL, s_acctbal FROM supplier
UNION ALL SELECT n_name, NULL, NULL, NULL FROM nation""",
    "lenient_cast": _lenient("value"),
    "lenient_cast_clamped": _lenient("greatest(0.0::double, least(100.0::double, value))"),
    "date_labels": """
SELECT o_orderkey, date_trunc('week', o_orderdate)::date AS week_start,
       date_trunc('week', o_orderdate)::date + 6 AS week_end,
       strftime(o_orderdate, '%Y-%m') AS month_key, strftime(o_orderdate, '%B %Y') AS month_label,
       month(o_orderdate) AS month_number, date_trunc('month', o_orderdate)::date AS month_first,
       (date_trunc('month', o_orderdate) + interval 1 month)::date AS month_next,
       strftime(o_orderdate, '%d %B %Y') AS long_date, strftime(o_orderdate, '%Y-%m-%d') AS iso_date,
       strftime(o_orderdate, '%Y-%m-%d %H:%M') AS iso_minute
FROM orders""",
    "series_summary": f"""
WITH {STATISTICS}
SELECT topic, {_two_places('average')} AS average_interest, peak::bigint AS peak_interest, peak_date,
       strftime(peak_date, '%d %B %Y') AS peak_date_label, current::bigint AS current_interest
FROM statistics JOIN peaks USING (topic)""",
    "trend_direction": f"WITH {SERIES}, {DIRECTION} SELECT * FROM direction",
    "timeline": f"""
WITH {STATISTICS}, {MARKS}
SELECT topic, 'interest' AS kind, date, value::double AS value, NULL AS label, average
FROM series JOIN statistics USING (topic)
UNION ALL
SELECT topic, 'peak', peak_date, peak, 'Peak', average FROM statistics JOIN peaks USING (topic)
UNION ALL
SELECT topic, 'event', event_date, NULL, event, average
FROM statistics JOIN marks ON event_date BETWEEN first_date AND last_date""",
    "annotate_events": f"""
WITH {STATISTICS}, {MARKS}
SELECT topic, event, event_date
FROM statistics JOIN marks ON event_date BETWEEN first_date AND last_date""",
    "weekly_series": f"""
WITH {TREND_LONG},
weekly AS (
  SELECT topic_name, region, date_trunc('week', date)::date + 6 AS week_end,
         sum(interest_value)::double / count(*) AS interest_value
  FROM trend_long GROUP BY ALL),
calendar AS (
  SELECT topic_name, region,
         unnest(generate_series(min(week_end), max(week_end), interval 7 day))::date AS week_end
  FROM weekly GROUP BY topic_name, region)
SELECT topic_name, region, week_end, interest_value
FROM calendar LEFT JOIN weekly USING (topic_name, region, week_end)""",
    "weekly_series_sparse": f"""
WITH {TREND_LONG}
SELECT topic_name, region, date_trunc('week', date)::date + 6 AS week_end,
       sum(interest_value)::double / count(*) AS interest_value
FROM trend_long GROUP BY ALL""",
    "monthly_rollup": """
SELECT o_orderpriority AS topic, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS total
FROM orders GROUP BY ALL""",
    "monthly_wide": """
SELECT strftime(ts, '%Y-%m') AS month, count(*) FILTER (event_type = 'click') AS click,
       count(*) FILTER (event_type = 'error') AS error,
       count(*) FILTER (event_type = 'purchase') AS purchase,
       count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view
FROM events GROUP BY ALL""",
    "centroids": f"WITH {CENTROIDS} SELECT * FROM centroids",
    "region_dimension": """
SELECT 'R' || label AS region_code, 'Region ' || max(vec_id) AS region_name
FROM embeddings GROUP BY label""",
    "sparkline_series": f"""
WITH {TREND_LONG}, {CODES}, {CENTROIDS}, {WEEKLY_BY_CODE},
calendar AS (
  SELECT topic_name, region_code,
         unnest(generate_series(min(week), max(week), interval 7 day))::date AS week,
         arg_max(interest_value, week) AS latest
  FROM weekly GROUP BY topic_name, region_code)
SELECT topic_name, region_code, lat, lon, week + 6 AS week_end, interest_value,
       printf('%.1f', latest)::double AS latest
FROM calendar LEFT JOIN weekly USING (topic_name, region_code, week) JOIN centroids USING (region_code)""",
    "heat_frames_flat": f"WITH {HEAT_POINTS} SELECT * FROM heat",
    "heat_frames": f"""
WITH {HEAT_POINTS}
SELECT topic_name, week, label, string_agg(region_code, ',' ORDER BY region_code) AS codes,
       count(*) AS n_points, max(weight) AS peak
FROM heat GROUP BY topic_name, week, label""",
    "profile_trends": f"""
WITH {TREND_LONG}
SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT region) AS n_regions,
       count(DISTINCT topic_name) AS n_topics, count(*) AS n_rows FROM trend_long""",
    "region_pairs": f"WITH {TREND_LONG} SELECT DISTINCT region, region_name FROM trend_long",
    "catalog_topics": f"""
WITH {TREND_LONG}
SELECT topic_name, min(date) AS first_date, max(date) AS last_date
FROM trend_long GROUP BY topic_name ORDER BY topic_name""",
    "catalog_dates": f"""
WITH {TREND_LONG}
SELECT date, count(*) AS n_rows, date = (SELECT max(date) FROM trend_long) AS is_default
FROM trend_long GROUP BY date ORDER BY date""",
    "coverage": f"""
WITH {TREND_LONG}, {CODES},
requested AS (
  SELECT o_orderpriority AS topic_name FROM orders UNION SELECT c_mktsegment FROM customer),
found AS (
  SELECT topic_name, count(*) AS n_rows, count(*) FILTER (region_code IS NULL) AS n_unmapped
  FROM trend_long LEFT JOIN codes USING (region) GROUP BY topic_name)
SELECT topic_name, coalesce(n_rows, 0) AS n_rows, coalesce(n_unmapped, 0) AS n_unmapped,
       n_rows IS NULL AS no_data
FROM requested LEFT JOIN found USING (topic_name)""",
    "series_summary_by_region": f"""
WITH {TREND_LONG}, {VALUES_SUM},
peaks AS (
  SELECT topic_name, region, date AS peak_date, interest_value AS peak FROM region_sums
  QUALIFY row_number() OVER (PARTITION BY topic_name, region ORDER BY interest_value DESC, date) = 1),
means AS (
  SELECT topic_name, region, sum(interest_value::decimal(28,2))::double / count(*) AS average,
         arg_max(interest_value, date) AS current
  FROM region_sums GROUP BY topic_name, region)
SELECT topic_name, region, {_two_places('average')} AS average_interest,
       trunc(peak)::bigint AS peak_interest, peak_date,
       strftime(peak_date, '%d %B %Y') AS peak_date_label, trunc(current)::bigint AS current_interest
FROM peaks JOIN means USING (topic_name, region)""",
    "top_regions": f"WITH {REGION_INTEREST} SELECT * FROM top_regions",
    "top_queries": f"WITH {RELATED} SELECT * FROM top_queries",
    "top_posts": f"""
WITH {POSTS},
requests AS (
  SELECT topic, unnest(generate_series(min(day), max(day) + 1, interval 1 day))::date AS day
  FROM posts GROUP BY topic),
matched AS (
  SELECT r.topic, r.day, p.* EXCLUDE (topic, day), 'day' AS match_level
  FROM requests r JOIN posts p ON r.topic = p.topic AND r.day = p.day
  UNION ALL
  SELECT r.topic, r.day, p.* EXCLUDE (topic, day), 'month'
  FROM requests r JOIN posts p ON r.topic = p.topic AND strftime(r.day, '%B %Y') = p.month
  WHERE NOT EXISTS (SELECT 1 FROM posts q WHERE q.topic = r.topic AND q.day = r.day))
SELECT * EXCLUDE (created_at), strftime(created_at, '%Y-%m-%d %H:%M') AS posted,
       row_number() OVER (PARTITION BY topic, day ORDER BY likes DESC, created_at, author, text) AS rank
FROM matched QUALIFY rank <= 10""",
    "topic_report": f"""
WITH {STATISTICS}, {DIRECTION}, {REGION_INTEREST}, {RELATED},
requested AS (SELECT event_type AS topic FROM events UNION SELECT r_name FROM region),
region_lists AS (
  SELECT topic, string_agg(region || '=' || interest, ';' ORDER BY rank) AS top_regions
  FROM top_regions GROUP BY topic),
query_lists AS (
  SELECT topic,
         string_agg(query || '=' || value, ';' ORDER BY rank) FILTER (kind = 'top') AS top_queries,
         string_agg(query || '=' || value, ';' ORDER BY rank) FILTER (kind = 'rising') AS rising_queries
  FROM top_queries GROUP BY topic)
SELECT topic, 'United Kingdom' AS geography, {_two_places('average')} AS average_interest,
       peak::bigint AS peak_interest, strftime(peak_date, '%d %B %Y') AS peak_date_label,
       current::bigint AS current_interest, trend,
       CASE WHEN trend IS NULL THEN 'No data found for "' || topic ||
            '". Try a different search term or timeframe.' END AS error,
       top_regions, top_queries, rising_queries
FROM requested LEFT JOIN statistics USING (topic) LEFT JOIN peaks USING (topic)
LEFT JOIN direction USING (topic) LEFT JOIN region_lists USING (topic)
LEFT JOIN query_lists USING (topic)""",
    "dedupe_articles": """
SELECT md5(text) AS url, lang AS title, source AS search_query, doc_id AS pos FROM documents
QUALIFY row_number() OVER (
  PARTITION BY md5(text)
  ORDER BY CASE source WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END, source, doc_id) = 1""",
    "html_text": f"SELECT page_id, url, {_visible('html')} AS content FROM pages",
    "summary_requests": f"""
WITH documents AS (
  SELECT * REPLACE (CASE WHEN doc_id % 10 = 3 THEN '   ' ELSE text END AS text) FROM documents)
SELECT doc_id::varchar AS url,
       json_object('anthropic_version', '{SUMMARY_API_VERSION}', 'max_tokens', 200, 'messages',
                   [json_object('role', 'user', 'content',
                                {_text(SUMMARY_PROMPT)} || substring(text, 1, 15000))])::varchar AS body
FROM documents WHERE {_trim('text')} <> ''""",
    "summary_requests_of_all_texts": f"""
SELECT doc_id::varchar AS url,
       json_object('anthropic_version', '{SUMMARY_API_VERSION}', 'max_tokens', 200, 'messages',
                   [json_object('role', 'user', 'content',
                                {_text(SUMMARY_PROMPT)} || substring(text, 1, 15000))])::varchar AS body
FROM documents WHERE {_trim('text')} <> ''""",
    "clean_summaries": rf"""
SELECT conv_id || '/' || turn AS url,
       {_summary(f"{_OPENING} || ' ' || chr(10) || text || chr(10)")} AS summary
FROM conversations""",
    "attach_summaries": """
SELECT documents.doc_id::varchar AS url, source AS headline, 'quality ' || quality AS summary
FROM documents LEFT JOIN labels USING (doc_id)""",
    "news_digest": f"""
SELECT url, {_visible('html')} AS content, 'Narrow: ' || {_TITLE} AS headline, {_trim(_TITLE)} AS summary
FROM pages""",
    "speech_rows": r"""
WITH turns AS (
  SELECT *, unnest(string_split(text, chr(10))) AS line_text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal
  FROM conversations)
SELECT conv_id || '-' || turn || '.xml' AS file_name, ordinal, nullif(line_text, '') AS data,
       conv_id::varchar AS conv, ordinal::varchar AS line, role, 'own' AS turn
FROM turns""",
    "trend_dir_file": f"""
WITH {TREND_LONG}
SELECT date, 'orders' AS topic_name, region, sum(interest_value)::double AS interest_value
FROM trend_long GROUP BY ALL
UNION ALL
SELECT l_shipdate::date, 'shipments', r_name, sum(l_quantity)
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "trend_long_file": f"""
WITH {TREND_LONG}
SELECT date, topic_name, region, region AS region_name, interest_value::double AS interest_value, row_id
FROM trend_long""",
    "posts_file": f"""
WITH {POSTS}
SELECT * REPLACE (strftime(created_at, '%Y-%m-%d %H:%M') AS created_at,
                  CASE WHEN replies % 7 > 2 THEN likes END AS likes)
FROM posts WHERE replies % 11 <> 0""",
    "posts_large_file": f"""
WITH {POSTS}
SELECT * REPLACE (strftime(created_at, '%Y-%m-%d %H:%M') AS created_at,
                  CASE WHEN replies % 7 > 2 THEN likes END AS likes)
FROM posts WHERE replies % 11 <> 0""",
    "counts_file": f"WITH {SERIES} SELECT topic, date, value::double AS value FROM series",
    "boundaries_file": f"WITH {CENTROIDS} SELECT * FROM centroids",
    "boundaries_large_file": f"WITH {CENTROIDS} SELECT * FROM centroids",
    "articles_file": """
SELECT source AS search_query, pos, 'https://news.example/' || doc_id || '/' || pos AS url, text AS title
FROM (SELECT *, unnest(range(0, doc_id % 3)) AS pos FROM documents)""",
    "articles_of_all_texts_file": """
SELECT source AS search_query, pos, 'https://news.example/' || doc_id || '/' || pos AS url, text AS title
FROM (SELECT *, unnest(range(0, doc_id % 3 + 1)) AS pos FROM documents)""",
    "speeches_large_file": """
SELECT 'turns' AS source, conv_id::varchar AS conv, turn::varchar AS turn, role, text AS data
FROM conversations""",
    "speeches_file": """
SELECT 'turns' AS source, conv_id::varchar AS conv, turn::varchar AS turn, role, text AS data
FROM conversations""",
    "table_sink": f"WITH {TREND_LONG}, {VALUES_SUM} SELECT * FROM region_sums",
}

# Results that are merged from loads equal those of all rows.
ORACLES |= {
    "weekly_series_by_loads": ORACLES["weekly_series"],
    "monthly_rollup_by_loads": ORACLES["monthly_rollup"],
    "profile_by_loads": ORACLES["profile_trends"],
    "staged_sink": ORACLES["table_sink"],
}
