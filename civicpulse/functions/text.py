"""Text column expressions around article summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicpulse.functions.fixed_values import (
    SUMMARY_API_VERSION,
    SUMMARY_MAX_CHARS,
    SUMMARY_MAX_TOKENS,
    SUMMARY_PREFIXES,
    SUMMARY_PROMPT,
)

# Every character Python calls white space: Unicode space plus the four separators.
_SPACE = r"[\s\x1c-\x1f]"


def strip_space(text: Column) -> Column:
    """Trim all white space at both ends, not only blanks."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def has_text(text: Column) -> Column:
    """True when at least one character is not white space; false for NULL."""
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def truncate(text: Column, max_chars: int = SUMMARY_MAX_CHARS) -> Column:
    """The first ``max_chars`` characters."""
    return F.substring(text, 1, max_chars)


def summary_prompt(content: Column, max_chars: int = SUMMARY_MAX_CHARS) -> Column:
    return F.concat(F.lit(SUMMARY_PROMPT), truncate(content, max_chars))


def summary_body(
    prompt: Column,
    max_tokens: int = SUMMARY_MAX_TOKENS,
    api_version: str = SUMMARY_API_VERSION,
) -> Column:
    """JSON body of one summary request."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(
        F.struct(
            F.lit(api_version).alias("anthropic_version"),
            F.lit(max_tokens).alias("max_tokens"),
            F.array(message).alias("messages"),
        )
    )


def response_text(body: Column) -> Column:
    """Trimmed text of a response body; NULL when it is absent or empty."""
    return empty_to_null(strip_space(F.get_json_object(body, "$.content[0].text")))


def drop_prefix(text: Column, prefixes: list[str] = SUMMARY_PREFIXES) -> Column:
    """Remove one leading phrase, in any case, and the white space after it."""
    phrases = "|".join(re.escape(p) for p in prefixes)
    return F.regexp_replace(text, rf"(?i)\A(?:{phrases})(?U:{_SPACE}*)", "")
