"""Costs, settings, times, durations and counts, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import trimmed

# US dollars a million tokens (input, output) by model; the default model; the share that cached input costs.
PRICES = {"claude-sonnet-4-6": (3.0, 15.0), "claude-opus-4-6": (5.0, 25.0), "gpt-5.5": (1.75, 14.0), "gpt-5.5-xhigh": (1.75, 14.0)}
DEFAULT_MODEL, CACHED_SHARE = "claude-sonnet-4-6", 0.1
# Pages made at a time, by default and at most.
PARALLEL_DEFAULT, PARALLEL_MAX = 2, 5


def cost(model: Column, prompt: Column, completion: Column, cached: Column | None = None) -> Column:
    """Cost of a call; cached tokens lie between none and all of the prompt; 0 for unknown models."""
    cached = F.least(F.greatest(F.coalesce(cached, F.lit(0)) if cached is not None else F.lit(0), F.lit(0)), prompt)
    out = None
    for name, (a, b) in PRICES.items():
        value = ((prompt - cached) * a + cached * a * CACHED_SHARE + completion * b) / 1e6
        out = F.when(model == name, value) if out is None else out.when(model == name, value)
    return out.otherwise(F.lit(0.0))


def known_model(model: Column) -> Column:
    return F.coalesce(model.isin(list(PRICES)), F.lit(False))


def resolved_model(model: Column) -> Column:
    return F.when(known_model(model), model).otherwise(F.lit(DEFAULT_MODEL))


def flag(setting: Column, default: bool) -> Column:
    v = F.lower(trimmed(setting))
    return F.when(v == "true", True).when(v == "false", False).otherwise(F.lit(default))


def parallel_limit(setting: Column) -> Column:
    """Pages at a time: 1 to 5; the default for what isn't a number. A blank counts as 0, so it gives 1."""
    text = trimmed(setting)
    number = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    return F.when(number.isNull(), float(PARALLEL_DEFAULT)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(float(PARALLEL_MAX)), number)))


def input_tokens(fresh: Column, created: Column, read: Column) -> Column:
    return F.coalesce(fresh, F.lit(0)) + F.coalesce(created, F.lit(0)) + F.coalesce(read, F.lit(0))


def app_time(text: Column) -> Column:
    """Milliseconds since 1970 of a time text; UTC where it names no zone; null if it isn't one."""
    t = trimmed(text)
    zoned = t.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})\z")
    norm = F.when(zoned, t).otherwise(F.concat(F.when(t.contains("T"), t).otherwise(F.regexp_replace(t, r"\A(\S*) ", "$1T")), F.lit("Z")))
    return F.unix_millis(F.try_to_timestamp(F.nullif(norm, F.lit("Z"))))


def relative_time(then_ms: Column, now_ms: Column) -> Column:
    diff = now_ms - then_ms
    minutes = F.floor(diff / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(then_ms.isNull(), "").when(diff < 60_000, "just now").when(minutes < 60, said(minutes, "m")).when(hours < 24, said(hours, "h")).otherwise(said(days, "d"))


def _minutes(ms: Column, minutes: Column) -> Column:
    return F.concat(minutes.cast("string"), F.lit("m "), F.floor(F.pmod(ms, F.lit(60_000)) / 1000 + 0.5).cast("string"), F.lit("s"))


def _unless_none(ms: Column, text: Column, none: str = "") -> Column:
    return F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit(none)).otherwise(text)


def duration_floor(ms: Column) -> Column:
    """Rounded seconds; from a minute on, whole minutes and the rest."""
    return _unless_none(ms, F.when(ms < 60_000, F.concat(F.floor(ms / 1000 + 0.5).cast("string"), F.lit("s"))).otherwise(_minutes(ms, F.floor(ms / 60_000))))


def duration_rounded(ms: Column) -> Column:
    """The same with minutes rounded on their own, so that 90 s are 2m 30s."""
    return _unless_none(ms, F.when(ms < 60_000, F.concat(F.floor(ms / 1000 + 0.5).cast("string"), F.lit("s"))).otherwise(_minutes(ms, F.floor(ms / 60_000 + 0.5))))


def duration_short(ms: Column) -> Column:
    """ms under a second, seconds with a decimal under a minute, then as duration_rounded."""
    seconds = F.concat(F.format_string("%.1f", ms / 1000), F.lit("s"))
    return _unless_none(ms, F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, seconds).otherwise(_minutes(ms, F.floor(ms / 60_000 + 0.5))))


def token_text(n: Column, decimals: int = 1, none: str = "") -> Column:
    """1234 as 1.2K, millions as 1.2M; `none` for null and 0."""
    return _unless_none(
        n,
        F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M")))
        .when(n >= 1_000, F.concat(F.format_string(f"%.{decimals}f", n / 1_000), F.lit("K")))
        .otherwise(n.cast("string")),
        none,
    )


def percent(share: Column) -> Column:
    return F.coalesce(F.concat(F.format_string("%.0f", share * 100), F.lit("%")), F.lit("n/a"))


def progress(done: Column, total: Column, start: int, span: int) -> Column:
    return (F.lit(start) + F.floor(done / total * span)).cast("int")


# Error texts after which a call is tried again; the second runner knows more of them.
RETRY_TEXTS = ["rate limit", "overloaded", "SIGTERM", "exit code"]
RETRY_TEXTS_WIDE = ["rate limit", "overloaded", "sigterm", "exit code", "timed out", "429", "503"]


def retryable(message: Column, wide: bool = False) -> Column:
    """Whether an error is worth another try; the wide list is held against the lower-case text."""
    out, said = F.lit(False), F.lower(message) if wide else message
    for text in RETRY_TEXTS_WIDE if wide else RETRY_TEXTS:
        out = out | said.contains(text)
    return out


def retry_delay_ms(attempt: Column) -> Column:
    """Wait before the next of three retries; null when there is none."""
    return F.when(attempt < 3, F.pow(F.lit(2), attempt) * 2000).cast("long")


def short_model(model: Column) -> Column:
    return F.when(model.contains("opus-4-6"), "opus-4.6").when(model.contains("sonnet-4-6"), "sonnet-4.6").otherwise(model)


def source_badge(kind: Column) -> Column:
    """label and cls of a wiki's source."""
    badge = lambda label: F.struct(F.lit(label).alias("label"), F.lit(label.lower()).alias("cls"))
    return F.when(kind == "local", badge("Local")).otherwise(badge("GitHub"))


def app_date(text: Column) -> Column:
    """The day of a time text, as month/day/year; empty if it isn't a time."""
    day = F.date_format(F.timestamp_millis(app_time(text)), "M/d/yyyy")
    return F.coalesce(day, F.lit(""))


#: Keys of a JSON schema whose values name schemas.
_NAMED = ("properties", "$defs", "definitions")


def strict_schema(node: object, names: bool = False) -> object:
    """A JSON schema whose objects take no other keys, unless they say so."""
    if isinstance(node, list):
        return [strict_schema(x) for x in node]
    if not isinstance(node, dict):
        return node
    closed = {} if names or node.get("type") != "object" else {"additionalProperties": False}
    return {k: strict_schema(v, not names and k in _NAMED and isinstance(v, dict)) for k, v in (node | {k: v for k, v in closed.items() if k not in node}).items()}
