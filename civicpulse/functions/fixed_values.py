"""Values that results depend on, stated once.

Every value here is a fixed value: changing one changes what the operators return.
"""

from __future__ import annotations

# The regions of a wide trend table and their official area codes.
REGION_COLUMNS = ["England", "Wales", "Scotland", "Northern Ireland"]
REGION_CODES = {
    "England": "E92000001",
    "Northern Ireland": "N92000002",
    "Scotland": "S92000003",
    "Wales": "W92000004",
}

# Column names a long trend table may arrive with, and ours.
TREND_ALIASES = {"Program": "topic_name", "value": "interest_value"}
TREND_COLUMNS = ["date", "topic_name", "region", "region_name", "interest_value"]

# Property names of official boundary files, in order of preference.
CODE_PROPERTIES = ["CTRY24CD", "RGN24CD"]
NAME_PROPERTIES = ["CTRY24NM", "RGN24NM"]

# Text that stands for a missing cell in a CSV file (the pandas defaults).
MISSING_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Labels of the trend direction, and how many points are compared.
TREND_UP = "↑ Increasing"
TREND_DOWN = "↓ Decreasing"
TREND_FLAT = "→ Stable"
TREND_UNKNOWN = "→ Insufficient data"
TREND_POINTS = 4

# Events marked on a timeline, as (label, ISO date).
REFERENCE_EVENTS = [("UK General Election", "2024-07-04")]

# The summary request and the phrases removed from its answer.
SUMMARY_PROMPT = (
    "Summarize the following article in exactly 100 words. "
    "Provide only the summary without any preamble:\n\n"
)
SUMMARY_MAX_CHARS = 15000
SUMMARY_MAX_TOKENS = 200
SUMMARY_API_VERSION = "bedrock-2023-05-31"
SUMMARY_PREFIXES = [
    "Here is a 100 word summary:",
    "Here is a 100-word summary:",
    "Here's a 100 word summary:",
    "Here's a 100-word summary:",
    "Here is the summary:",
    "Here's the summary:",
    "Here is a 100-word summary of the article:",
]

# How many rows the ranked reports show.
TOP_REGIONS = 10
TOP_QUERIES = 10
TOP_POSTS = 10
PREVIEW_ROWS = 50

# What a report says of a topic without data; the topic goes between.
NO_DATA = ('No data found for "', '". Try a different search term or timeframe.')
