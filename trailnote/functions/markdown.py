"""Column functions that take Markdown notes apart. All are built-in expressions on one row.

A null text gives empty results. Lines may end in LF or CRLF. Fenced blocks (three backticks
or tildes) hold no headings, list items, tables or links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[`~]*[ \t]*$|\z)"
# Prefixes of note identifiers.
PREFIXES = ("A", "E", "EV", "P", "D", "R")
ID = r"\b(?:EV|[AEPDR])-\d{8}-[a-z0-9]+(?:-[a-z0-9]+)*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, whatever projections are merged."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(text: Column) -> Column:
    """text without carriage returns and without the three control characters used as marks here."""
    return F.translate(F.coalesce(text, F.lit("")), "\r\x01\x02\x03", "")


def without_fences(text: Column) -> Column:
    return F.regexp_replace(text_of(text), _FENCE, "")


def _pairs(entries: Column) -> Column:
    """A map of (key, value) structs; of equal keys the first counts."""
    key = lambda x: x["key"]
    first = lambda all_: F.transform(F.array_distinct(F.transform(all_, key)), lambda k: F.element_at(all_, F.array_position(F.transform(all_, key), k).cast("int")))
    return let(entries, lambda all_: F.map_from_entries(F.when(F.size(F.array_distinct(F.transform(all_, key))) == F.size(all_), all_).otherwise(first(all_))))


def _entry(line: Column) -> Column:
    """key and value of 'key: value', split at the first colon; an empty value is null."""
    return F.struct(F.trim(F.substring_index(line, ":", 1)).alias("key"), F.nullif(F.trim(F.substr(line, F.locate(":", line) + 1)), F.lit("")).alias("value"))


def front_matter(text: Column) -> Column:
    """map<string,string> of the leading --- block; an empty map where there is none."""
    block = F.regexp_extract(text_of(text), r"(?s)\A---[ \t]*\n(.*?)(?<=\n)---[ \t]*(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*[^:\s][^:]*:"))
    return _pairs(F.transform(lines, _entry))


def body(text: Column) -> Column:
    """text after its front matter."""
    return F.regexp_replace(text_of(text), r"(?s)\A---[ \t]*\n.*?(?<=\n)---[ \t]*(?:\n|\z)", "")


def header_date(text: Column) -> Column:
    """The date of a 'Created: YYYY-MM-DD' line, else null."""
    return F.regexp_extract(text_of(text), r"(?m)^\s*(?:[-*]\s+)?Created:\s*(\d{4}-\d{2}-\d{2})\b", 1).try_cast("date")


def sections(text: Column) -> Column:
    """array<struct<level, heading, body>> in order; what precedes the first heading has level 0.

    One pass marks headings outside fences: a fence matches first and stays as it is.
    """
    marked = F.regexp_replace(body(text), r"(?ms)(^[ \t]*(```|~~~).*?(?:^[ \t]*\2[`~]*[ \t]*$|\z))|^(#{1,6})[ \t]+([^\n]*?)[ \t]*#*[ \t]*$", "$1\x01$3\x02$4\x03")
    parts = F.split(F.replace(marked, F.lit("\x01\x02\x03"), F.lit("")), "\x01")
    made = F.transform(
        parts,
        lambda x, i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.length(F.substring_index(x, "\x02", 1))).alias("level"),
            F.when(i == 0, F.lit("")).otherwise(F.substring_index(F.substring_index(x, "\x03", 1), "\x02", -1)).alias("heading"),
            F.trim(F.when(i == 0, x).otherwise(F.substr(x, F.locate("\x03", x) + 1)), F.lit(" \t\n")).alias("body"),
        ),
    )
    return F.filter(made, lambda s: (s["level"] > 0) | (s["body"] != ""))


def list_items(text: Column) -> Column:
    """array<struct<depth, item>> of bullets and numbered items; two blanks or a tab are one depth. Empty items are dropped."""
    rule = r"^([ \t]*)(?:[-*+]|\d+[.)])[ \t]+(.*)$"
    lines = F.filter(F.split(without_fences(text), "\n"), lambda x: x.rlike(rule))
    made = F.transform(lines, lambda x: F.struct(F.floor(F.length(F.replace(F.regexp_extract(x, rule, 1), F.lit("\t"), F.lit("  "))) / 2).cast("int").alias("depth"), F.trim(F.regexp_extract(x, rule, 2)).alias("item")))
    return F.filter(made, lambda s: s["item"] != "")


def kv_bullets(text: Column) -> Column:
    """map<string,string> of '- Key: value' bullets; a bullet without a value maps to null."""
    rule = r"^[ \t]*[-*+][ \t]+([^:`]+:.*)$"
    lines = F.filter(F.split(without_fences(text), "\n"), lambda x: x.rlike(rule))
    return _pairs(F.transform(lines, lambda x: _entry(F.regexp_extract(x, rule, 1))))


def md_tables(text: Column) -> Column:
    """array<array<array<string>>>: tables, rows, cells. The --- row is dropped; bars in backticks or after a backslash do not split."""
    blocks = F.filter(F.split(without_fences(text), r"(?m)^(?![ \t]*\|)[^\n]*(?:\n|\z)"), lambda b: F.trim(b, F.lit(" \t\n")) != "")
    inner = lambda line: F.regexp_replace(F.trim(line, F.lit(" \t")), r"^\||(?<!\\)\|$", "")
    cells = lambda line: F.transform(F.split(inner(line), r"(?<!\\)\|(?=(?:[^`]*`[^`]*`)*[^`]*$)"), lambda c: F.trim(c))
    rows = lambda b: F.transform(F.filter(F.split(b, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^[ \t]*\|[ \t:|-]*-[ \t:|-]*$")), cells)
    return F.transform(blocks, rows)


def numbered_items(text: Column) -> Column:
    """array<struct<rank, title, fields>> of '1. title' with nested '- Key: value' lines."""
    parts = F.filter(F.split(without_fences(text), r"(?m)^(?=\d+[.)][ \t])"), lambda x: x.rlike(r"^\d+[.)][ \t]"))
    first = r"^(\d+)[.)][ \t]+([^\n]*)"
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, first, 1).cast("int").alias("rank"), F.trim(F.regexp_extract(x, first, 2)).alias("title"), kv_bullets(x).alias("fields")))


def resolved(folder: Column, target: Column) -> Column:
    """target as a path from the root, for a link in a note of folder. Addresses with a scheme stay; .. that has nothing above it stays."""
    path = F.when(target.startswith("/"), F.substr(target, F.lit(2))).otherwise(F.concat_ws("/", F.nullif(folder, F.lit("")), target))
    last = lambda parts: F.get(parts, F.size(parts) - 1)
    up = lambda parts: F.coalesce(~last(parts).isin("..", ""), F.lit(False))
    step = lambda parts, x: F.when(x == ".", parts).when((x == "..") & up(parts), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(F.concat(parts, F.array(x)))
    folded = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(target.rlike(r"^[a-zA-Z][\w+.-]*:"), target).when(path.contains("./"), folded).otherwise(path)


def links(text: Column, folder: Column) -> Column:
    """array<struct<target, type>>, distinct: markdown links, paths in backticks, identifiers."""

    def found(plain: Column) -> Column:
        each = lambda rule, kind: F.transform(F.regexp_extract_all(plain, F.lit(rule), F.lit(1)), lambda x: F.struct((x if kind == "id" else resolved(folder, x)).alias("target"), F.lit(kind).alias("type")))
        return F.array_distinct(F.concat(each(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)", "link"), each(r"`([\w./-]+\.md)`", "path"), each(f"({ID})", "id")))

    return let(without_fences(text), found)


def parse_id(id: Column) -> Column:
    """struct<prefix, date, slug, known>; date is null where its digits are no date, known is whether the prefix is one."""
    rule = r"^([A-Z]+)-(\d{8})-(.+)$"
    part = lambda k: F.nullif(F.regexp_extract(id, rule, k), F.lit(""))
    prefix = part(1)
    return F.struct(prefix.alias("prefix"), F.try_to_date(part(2), "yyyyMMdd").alias("date"), part(3).alias("slug"), F.coalesce(prefix.isin(*PREFIXES), F.lit(False)).alias("known"))
