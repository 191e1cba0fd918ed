"""Path and text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def drop_directory1(path: Column) -> Column:
    return F.regexp_replace(path, "^[^/]*/?", "")


def take_directory1(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def replace_directory1(path: Column, directory: Column) -> Column:
    return F.concat(directory, F.lit("/"), drop_directory1(path))


def take_extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def drop_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def replace_extension(path: Column, ext: str) -> Column:
    return F.concat(drop_extension(path), F.lit("" if not ext else "." + ext.lstrip(".")))


def take_file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def take_directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, "(?<!^)/[^/]*$", ""))


def combine(left: Column, right: Column) -> Column:
    return F.when(right.startswith("/"), right).when((left == "") | left.endswith("/"), F.concat(left, right)).otherwise(F.concat(left, F.lit("/"), right))


def to_standard(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def normalise(path: Column) -> Column:
    """Removes empty and ``.`` components, and ``..`` with the component before it; a relative path
    keeps leading ``..`` and an absolute one keeps them too; a final slash stays."""
    parts = F.filter(F.split(path, "/+"), lambda p: (p != "") & (p != "."))
    stack = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda s, p: F.when((p == "..") & (F.size(s) > 0) & (F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit("")) != ".."), F.slice(s, 1, F.greatest(F.lit(0), F.size(s) - 1))).otherwise(F.concat(s, F.array(p))))
    body = F.array_join(stack, "/")
    absolute, final = path.startswith("/"), path.rlike("/$")
    # "/." keeps its dot; every other path of nothing is "." or "./".
    return (
        F.when(path == "/.", "/.")
        .when(absolute & (body == ""), "/")
        .when(absolute, F.concat(F.lit("/"), body, F.when(final, "/").otherwise("")))
        .when(body == "", F.when(final, "./").otherwise("."))
        .otherwise(F.concat(body, F.when(final, "/").otherwise("")))
    )


def show_time(seconds: Column) -> Column:
    """1h02m, 1m02s or 1.50s."""
    half_up = lambda x: F.floor(x + 0.5).cast("int")
    minutes, rest = F.floor(half_up(seconds) / 60).cast("int"), half_up(seconds) % 60
    hours = F.floor(half_up(seconds / 60) / 60).cast("int")
    return F.when(seconds >= 3600, F.format_string("%dh%02dm", hours, half_up(seconds / 60) % 60)).when(seconds >= 60, F.format_string("%dm%02ds", minutes, rest)).otherwise(F.format_string("%.2fs", seconds))


def show_min_sec(seconds: Column) -> Column:
    s = seconds.cast("int")
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm%02ds", F.floor(s / 60).cast("int"), s % 60))


def uri_parameters(query: Column) -> Column:
    """The parameters of a query string as a map, decoded; the last of a repeated name stays."""
    pairs = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")
    decode = lambda x: F.try_url_decode(x)
    entries = F.transform(pairs, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(entries, lambda e: e["k"] == k), F.lit(-1))["v"]))


def quote(text: Column) -> Column:
    """Double quotes around a text that holds a space."""
    return F.when(F.contains(text, F.lit(" ")), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)


def make_relative(base: Column, path: Column) -> Column:
    """``path`` as seen from the directory ``base``; a relative path stays as it is, and of a relative base
    an absolute path has none (null). Links are not followed."""
    parts = lambda x: F.filter(F.split(normalise(x), "/"), lambda p: (p != "") & (p != "."))
    a, b = parts(base), parts(path)
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    common = F.when(F.array_position(same, False) > 0, F.array_position(same, False).cast("int") - 1).otherwise(F.least(F.size(a), F.size(b)))
    up = F.array_repeat(F.lit(".."), F.size(a) - common)
    found = F.array_join(F.concat(up, F.slice(b, common + 1, F.greatest(F.lit(0), F.size(b) - common))), "/")
    return F.when(~path.startswith("/"), path).when(base.startswith("/"), F.when(found == "", ".").otherwise(found))


def show_percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share.cast("double") * 100)


def show_int(number: Column) -> Column:
    """Digits in groups of three."""
    return F.format_number(number, 0)


def plural(number: Column, many: str = "s", one: str = "") -> Column:
    return F.when(number == 1, one).otherwise(many)


def show_run(run: Column) -> Column:
    """How long ago a run was: 0 is the latest."""
    return F.when(run == 0, "Latest run").otherwise(F.concat(run.cast("string"), F.lit(" run"), plural(run), F.lit(" ago")))


def show_duration_secs(seconds: Column) -> Column:
    """Whole seconds, halves to the even one: 5s, 1m05s, 1h02m."""
    return F.regexp_replace(show_time(F.bround(seconds.cast("double"))), r"\.00s$", "s")


def trim(text: Column) -> Column:
    """Without white space around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def abbreviate(text: Column, short: list[tuple[str, str]]) -> Column:
    """``text`` with each of some strings replaced, from left to right; where several start, the longest (of
    equal ones the first given); what was put in is not looked at again. One expression: the text is cut
    into such strings and what lies between, and each string looked up."""
    table = {}
    for full, brief in short:
        if full:
            table.setdefault(full, brief)
    if not table:
        return text
    names = "|".join(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", x) for x in sorted(table, key=len, reverse=True))
    pieces = F.regexp_extract_all(text, F.lit(rf"(?:{names})|(?:(?!{names})[\s\S])+"), F.lit(0))
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")
