"""Scalar column expressions: durations, display ids, clipping, aliases, patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worklog.schema import ALIASES

# Milliseconds of each unit of a duration.
UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def lookup(column: Column, table: dict[str, str]) -> Column:
    """The table's value, else the column itself."""
    if not table:
        return column
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[column], column)


def duration_ms(column: Column) -> Column:
    """Milliseconds of a text such as 2h30m; null where it is empty, zero, incomplete, of unknown unit or too large."""
    text = F.trim(column)
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+)(ms|[smhdw])"), F.lit(0))
    units = F.create_map(*[F.lit(x) for pair in UNIT_MS.items() for x in pair])

    def add(total: Column, part: Column) -> Column:
        number = F.regexp_extract(part, "^[0-9]+", 0).try_cast("long")
        return F.try_add(total, F.try_multiply(number, units[F.regexp_extract(part, "[a-z]+$", 0)].cast("long")))

    total = F.aggregate(parts, F.lit(0).cast("long"), add)
    return F.when(text.rlike(r"^([0-9]+(ms|[smhdw]))+$") & (total > 0), total)


def since_bound(column: Column, now: Column) -> Column:
    """A bound given as a time or as a look-back duration before now."""
    return F.coalesce(F.try_to_timestamp(column).cast("timestamp_ntz"), now - F.make_dt_interval(secs=duration_ms(column) / F.lit(1000)))


def clip(column: Column, n: int = 500, marker: str = "...") -> Column:
    return F.when(F.char_length(column) > n, F.concat(F.left(column, F.lit(n)), F.lit(marker))).otherwise(column)


def stamp(column: Column) -> Column:
    """A time as text to the minute, with a space for the T."""
    return F.translate(F.left(column.cast("string"), F.lit(16)), "T", " ")


def short_id(column: Column) -> Column:
    return F.left(column, F.lit(8))


def clip_json_strings(column: Column, n: int = 500) -> Column:
    """Clip every string value of a JSON text, at any depth, keys untouched; escapes count as one character."""
    unit = r'(?:[^"\\]|\\u[0-9a-fA-F]{4}|\\[^u])'
    return F.regexp_replace(column, rf'"({unit}{{{n}}}){unit}++"(?!\s*:)', F.lit('"$1..."'))


def format_display_id(prefix: Column, number: Column) -> Column:
    return F.format_string("%s-%04d", prefix, number.cast("long"))


def display_prefix(column: Column) -> Column:
    return F.nullif(F.regexp_extract(column, "^(.*)-([0-9]+)$", 1), F.lit(""))


def display_number(column: Column) -> Column:
    """The number after the last dash, null if there is none."""
    return F.regexp_extract(column, "^(.*)-([0-9]+)$", 2).try_cast("long")


def normalise_enum(column: Column, domain: str) -> Column:
    return lookup(column, ALIASES.get(domain, {}))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_any(columns: list[Column], text: str) -> Column:
    """Whether a column holds the text, % and _ being wildcards; only A-Z are folded."""
    pattern = F.lit("%" + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) + "%")
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.like(lower_ascii(c), pattern, F.lit("\x01")), F.lit(False))
    return found


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, never below zero."""
    return F.greatest(F.lit(0).cast("long"), F.timestamp_diff("SECOND", start, end))


def hours_minutes(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h "), F.floor(seconds % 3600 / 60).cast("string"), F.lit("m"))


def glob_regex(pattern: Column) -> Column:
    """A regular expression for a glob in which wildcards cross slashes; see valid_glob for what counts as a glob."""
    out = F.regexp_replace(pattern, r"([.+^$()|\\])", r"\\$1")
    out = F.regexp_replace(out, r"\[!", "[^")
    out = F.regexp_replace(out, r"\*+", ".*")
    out = F.replace(out, F.lit("?"), F.lit("."))
    out = F.when(out.contains("{"), F.replace(F.replace(F.replace(out, F.lit("{"), F.lit("(?:")), F.lit("}"), F.lit(")")), F.lit(","), F.lit("|"))).otherwise(out)
    return F.concat(F.lit("(?s)^"), out, F.lit("$"))


def valid_glob(pattern: Column) -> Column:
    """Brackets and braces are closed and not nested, no class is empty and no backslash escapes occur."""
    return pattern.rlike(r"^(?:[^\[\]{}\\]|\[!?[^\[\]]+\]|\{[^{}\[\]]*\})*$")
