"""Dates, durations, arrays, maps and JSON (§2.8.5, X8, X21, X35)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two times."""
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def format_date(at: Column) -> Column:
    """Day, short month and year; a dash for none."""
    return F.coalesce(F.date_format(at, "d MMM y"), F.lit("—"))


def relative_time(at: Column, now: Column) -> Column:
    """just now, minutes, hours, days up to a month, then the date; a dash for none. Each unit is rounded from the one before."""
    minutes = F.floor(duration_ms(at, now) / 60_000 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    ago = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f"{unit} ago"))
    return F.when(at.isNull(), "—").when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h")).when(days < 30, ago(days, "d")).otherwise(format_date(at))


def remaining_ms(status: Column, progress: Column, started: Column, now: Column) -> Column:
    """The elapsed time over the share done, less the elapsed time; null unless processing and 5 % done."""
    elapsed = duration_ms(started, now)
    return F.when((status == "PROCESSING") & (progress >= 5), elapsed / (progress / 100.0) - elapsed)


def filled_ratio(cells: Column) -> Column:
    """Share of the cells of a nested array that aren't blank; 0 without cells."""
    flat = F.flatten(cells)
    return F.coalesce(F.size(F.filter(flat, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")) / F.nullif(F.size(flat), F.lit(0)), F.lit(0.0))


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))


def overlay(old: Column, new: Column) -> Column:
    """The entries of two maps; those of ``new`` win (U5). Null maps count as empty."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def without_keys(m: Column, keys: tuple[str, ...]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def safe_json(text: Column) -> Column:
    """A variant, null where the text is no JSON."""
    return F.try_parse_json(text)


def window_json(script: Column) -> Column:
    """The object that a script assigns to a member of ``window``, as text; null without one."""
    return F.nullif(F.regexp_extract(script, r"(?s)window\.\w+\s*=\s*(\{.*?\})\s*;", 1), F.lit(""))


def image_start_number(value: Column) -> Column:
    """A whole number of at least 1; anything else is 1."""
    return F.greatest(F.lit(1), F.coalesce(value.cast("string").try_cast("int"), F.lit(1)))


def is_url(value: Column) -> Column:
    """X35."""
    return F.coalesce(value.rlike(r"(?i)^(?:https?|file)://"), F.lit(False))


def suffix(url: Column) -> Column:
    """The lower-cased extension of a path without query and fragment, with its point; empty without one."""
    return F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"(\.[A-Za-z0-9]{1,8})$", 1))


def mime_type(url: Column) -> Column:
    """By extension; octets where it isn't known."""
    known = {".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml", ".webp": "image/webp", ".json": "application/json", ".csv": "text/csv"}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), suffix(url)), F.lit("application/octet-stream"))


def same_src(a: Column, b: Column) -> Column:
    """Equal, or with the same last part of their paths."""
    tail = lambda c: F.regexp_extract(F.regexp_replace(c, r"[?#].*$|/+$", ""), r"([^/]*)$", 1)
    return F.coalesce((a == b) | ((tail(a) != "") & (tail(a) == tail(b))), F.lit(False))
