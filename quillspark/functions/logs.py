"""Messages and settings of services: rate limits, waiting times, keys that are set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as X

# Marks of a rate limit, where a waiting time stands (the first that matches), and values that stand for no key.
RATE_LIMIT = r"429|(?i:rate limit|resource_exhausted|quota)"
RETRY_AFTER = (r"(?i)retryDelay['\"]?\s*[:=]\s*['\"]?(\d+)s", r"(?i)retry_delay\s*\{\s*seconds:\s*(\d+)", r"(?i)Retry-After['\"]?\s*[:=]\s*['\"]?(\d+)")
NO_KEY = ("your-api-key-here", "your_api_key_here", "your-key-here", "replace-me", "")


def rate_limited(message: Column | str) -> Column:
    """Whether a message tells of a rate limit; a null one doesn't."""
    return F.coalesce(X.col(message).rlike(RATE_LIMIT), F.lit(False))


def retry_seconds(message: Column | str) -> Column:
    """The waiting time that a message names; null if it names none."""
    return F.coalesce(*(F.nullif(F.regexp_extract(X.col(message), p, 1), F.lit("")).try_cast("long") for p in RETRY_AFTER))


def configured(key: Column | str) -> Column:
    """Whether a key is set to more than a placeholder."""
    return F.coalesce(~F.lower(X.trimmed(key)).isin(*NO_KEY), F.lit(False))
