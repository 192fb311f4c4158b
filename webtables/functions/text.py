"""Plain-Column string, number and time helpers.

All are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace(): Unicode White_Space plus the four separators
# U+001C..U+001F. Spark's trim() only removes U+0020.
WS = r"[\p{IsWhite_Space}\x{1c}-\x{1f}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable.

    An outer expression used inside a higher-order lambda is re-evaluated
    for every element; binding it first keeps the work linear."""
    return F.get(F.transform(F.array(value), fn), 0)


def ustrip(s) -> Column:
    """Python ``str.strip()`` (Unicode whitespace)."""
    return F.regexp_replace(_c(s), f"^{WS}+|{WS}+$", "")


def collapse_ws(s) -> Column:
    """Python ``" ".join(s.split())``: trim and collapse whitespace runs."""
    return F.regexp_replace(ustrip(s), f"{WS}+", " ")


def truncate_ellipsis(s, max_length: int = 80) -> Column:
    """Cut to ``max_length-3`` characters plus ``...`` when longer."""
    s = _c(s)
    return F.when(
        F.length(s) > max_length, F.concat(F.substring(s, 1, max_length - 3), F.lit("..."))
    ).otherwise(s)


def format_duration(seconds) -> Column:
    """H8: ``Ns``, ``Nm Ns``, ``Nh Nm``, ``Nd Nh`` (truncated)."""
    s = _c(seconds).cast("double")
    i = lambda x: F.floor(x).cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", i(s)))
        .when(s < 3600, F.format_string("%dm %ds", i(s / 60), i(s % 60)))
        .when(s < 86400, F.format_string("%dh %dm", i(s / 3600), i((s % 3600) / 60)))
        .otherwise(F.format_string("%dd %dh", i(s / 86400), i((s % 86400) / 3600)))
    )


def elapsed_seconds(start, now) -> Column:
    """H9: seconds from ``start`` to ``now`` (``now`` is a parameter)."""
    now_c = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    return (F.unix_micros(now_c.cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))) / 1e6


def iso_format(ts) -> Column:
    """Python ``datetime.isoformat()`` of a UTC timestamp (fraction
    omitted when zero, ``+00:00`` suffix)."""
    t = _c(ts).cast("timestamp")
    frac = F.unix_micros(t) % 1_000_000
    return F.when(frac == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    )


def backoff_delay(k, retry_delay: float = 1.0) -> Column:
    """Wait before retry ``k`` (1-based): ``retry_delay * 2^(k-1)``."""
    return F.lit(float(retry_delay)) * F.pow(F.lit(2.0), _c(k) - 1)


def total_backoff(retries, retry_delay: float = 1.0) -> Column:
    """Sum of waits for ``retries`` retries: ``delay * (2^retries - 1)``."""
    return F.lit(float(retry_delay)) * (F.pow(F.lit(2.0), _c(retries)) - 1)


# The log URL format of an answer-service call.
ANSWER_LOG_URL = 'perplexity://%s  "%s"'


def answer_log_url(model, prompt) -> Column:
    """The synthetic log URL of an answer-service call."""
    return F.format_string(ANSWER_LOG_URL, _c(model), _c(prompt))


def comma_list(s) -> Column:
    """Comma list to trimmed items."""
    return F.transform(F.split(_c(s), ","), lambda x: ustrip(x))


def pct(num, den, places: int = 2) -> Column:
    """A4/A5 pattern: ``round(100*num/den, places)``, 0.0 when ``den`` is 0."""
    return F.when(_c(den) == 0, F.lit(0.0)).otherwise(
        F.round(F.lit(100.0) * _c(num) / _c(den), places)
    )


def ratio(num, den, places: int = 2) -> Column:
    return F.when(_c(den) == 0, F.lit(0.0)).otherwise(F.round(_c(num) / _c(den), places))


def request_id(url, ts) -> Column:
    """Repeatable request id (``uuid4`` is not repeatable)."""
    return F.sha2(F.concat_ws("#", _c(url), F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")), 256)
