"""Note corpora: scanning folders of Markdown files, parsed child tables, and writing notes.

A corpus is a table (path, kind, folder_state, text), one row per note. Kind and state come
from the path (``assumptions/active/x.md``, or ``kind=assumptions/state=active/`` as written
by ``write_notes``, which Spark prunes by). An empty folder gives a typed empty table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailnote.functions import markdown as md
from trailnote.sources.templates import FIELDS, KINDS, SECTIONS, STATES

CORPUS = "path string, kind string, folder_state string, text string"


def located(path: Column) -> tuple[Column, Column]:
    """(kind, state) of a path; unknown folders give their own name as kind, no state gives null."""
    plain = F.regexp_replace(path, r"(^|/)(?:kind|state)=", "$1")
    kind = F.coalesce(*[F.when(plain.rlike(rf"(?:^|/){folder}/"), F.lit(kind)) for _, kind, folder in KINDS], F.when(plain.rlike(r"(?:^|/)learning/"), F.concat(F.lit("learning_"), F.regexp_replace(F.regexp_extract(plain, r"([^/]+)\.\w+$", 1), "-", "_"))), F.lit("other"))
    return kind, F.nullif(F.regexp_extract(plain, rf"/({'|'.join(STATES)})/", 1), F.lit(""))


def corpus(rows: DataFrame) -> DataFrame:
    """(path, kind, folder_state, text) of rows (path, text)."""
    kind, state = located(F.col("path"))
    return rows.select("path", kind.alias("kind"), state.alias("folder_state"), "text")


def scan_notes(spark: SparkSession, root: str) -> DataFrame:
    """Every file below root as one note; path is relative to root."""
    try:
        files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,txt}")
    except AnalysisException:
        return spark.createDataFrame([], CORPUS)
    # _metadata gives an absolute, percent-encoded address; root may come with or without a scheme.
    base = root.rstrip("/").split("://")[-1]
    inner = F.ltrim(F.substring_index(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), base, -1), F.lit("/"))
    return corpus(files.select(inner.alias("path"), F.col("value").alias("text")))


def headers(notes: DataFrame) -> DataFrame:
    """(path, kind, folder_state, fm): front matter as a map."""
    return notes.select("path", "kind", "folder_state", md.front_matter(F.col("text")).alias("fm"))


def typed(notes: DataFrame, kind: str) -> DataFrame:
    """Notes of one kind with the template's fields as columns: dates and numbers cast, what does not cast null."""
    fm = headers(notes.filter(F.col("kind") == kind))

    def cast(name: str) -> Column:
        value = F.col("fm")[name]
        if name.endswith("_at") or name == "date":
            return value.try_cast("date").alias(name)
        return value.try_cast("double").alias(name) if name.startswith(("confidence", "reliability")) else value.alias(name)

    return fm.select("path", "folder_state", *[cast(x) for x in FIELDS[kind]])


def note_sections(notes: DataFrame) -> DataFrame:
    """(path, kind, ord, level, heading, body)."""
    return notes.select("path", "kind", F.posexplode(md.sections(F.col("text"))).alias("ord", "s")).select("path", "kind", "ord", "s.*")


def note_items(notes: DataFrame) -> DataFrame:
    """(path, heading, ord, depth, item): list items by section."""
    return note_sections(notes).select("path", "heading", F.posexplode(md.list_items(F.col("body"))).alias("ord", "i")).select("path", "heading", "ord", "i.*")


def note_links(notes: DataFrame) -> DataFrame:
    """(path, target, type): where each note points, header fields included."""
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit(""))
    return notes.select("path", F.explode(md.links(F.col("text"), folder)).alias("l")).select("path", "l.*")


def log_entries(notes: DataFrame) -> DataFrame:
    """(path, entry_date, ord, title, fields, items): one row per section whose heading begins with a date."""
    rule = r"^(\d{4}-\d{2}-\d{2})\b[\s:\u2014-]*(.*)$"
    rows = note_sections(notes).filter(F.col("heading").rlike(rule))
    return rows.select("path", F.regexp_extract("heading", rule, 1).try_cast("date").alias("entry_date"), "ord", F.regexp_extract("heading", rule, 2).alias("title"), md.kv_bullets(F.col("body")).alias("fields"), F.transform(md.list_items(F.col("body")), lambda x: x["item"]).alias("items"))


def table_rows(notes: DataFrame) -> DataFrame:
    """(path, table_no, row_no, cells): row 0 is the table's header."""
    tables = notes.select("path", F.posexplode(md.md_tables(F.col("text"))).alias("table_no", "t"))
    return tables.select("path", "table_no", F.posexplode("t").alias("row_no", "cells"))


def pool_items(notes: DataFrame) -> DataFrame:
    """(path, track, grp, rank, title, link, why): numbered items under level-2 tracks and level-3 groups.

    The fill-down window is over the sections of one note.
    """
    above = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    filled = note_sections(notes).withColumn("track", F.last(F.when(F.col("level") <= 2, F.col("heading")), ignorenulls=True).over(above)).withColumn("grp", F.when(F.col("level") > 2, F.col("heading")))
    rows = filled.select("path", "track", "grp", F.explode(md.numbered_items(F.col("body"))).alias("i"))
    return rows.select("path", "track", "grp", "i.rank", "i.title", F.col("i.fields")["Link"].alias("link"), F.col("i.fields")["Why"].alias("why"))


def ids_of(notes: DataFrame) -> DataFrame:
    """(path, id, prefix, date, slug, known) of each note that declares an identifier."""
    return headers(notes).select("path", F.col("fm")["id"].alias("id")).filter("id IS NOT NULL").select("path", "id", md.parse_id(F.col("id")).alias("p")).select("path", "id", "p.*")


def rendered(kind: str, values: Mapping[str, Column], sections: Mapping[str, Column]) -> Column:
    """The text of a new note: the template's fields and headings in order, filled where given."""
    line = lambda name: F.concat(F.lit(f"{name}:"), F.coalesce(F.concat(F.lit(" "), values[name].cast("string")), F.lit("")) if name in values else F.lit(""), F.lit("\n"))
    part = lambda name: F.concat(F.lit(f"\n## {name}\n\n"), F.coalesce(F.concat(sections[name].cast("string"), F.lit("\n")), F.lit("")) if name in sections else F.lit(""))
    return F.concat(F.lit("---\n"), *[line(x) for x in FIELDS[kind]], F.lit("---\n\n# "), F.coalesce(values["title"] if "title" in values else F.lit(None), F.lit("")), F.lit("\n"), *[part(x) for x in SECTIONS.get(kind, ())])


def new_note(rows: DataFrame, kind: str, values: Mapping[str, Column], sections: Mapping[str, Column], state: Column | None = None) -> DataFrame:
    """(path, kind, folder_state, text) of one new note per row, in the inbox unless a state is given."""
    folder = next(f for _, k, f in KINDS if k == kind)
    state = F.lit("inbox") if state is None else state
    path = F.concat(F.lit(f"{folder}/"), state, F.lit("/"), values["id"], F.lit(".md"))
    return rows.select(path.alias("path"), F.lit(kind).alias("kind"), state.alias("folder_state"), rendered(kind, values, sections).alias("text"))


def write_notes(notes: DataFrame, root: str) -> None:
    """One file per note below root/kind=<folder>/state=<state>, laid out for partition pruning; Spark names the files, so links break: notefiles.write_note_files keeps paths."""
    folder = F.coalesce(*[F.when(F.col("kind") == k, F.lit(f)) for _, k, f in KINDS], F.col("kind"))
    notes.select(folder.alias("kind"), F.coalesce("folder_state", F.lit("none")).alias("state"), "text").write.partitionBy("kind", "state").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(root)


def rebuilt_index(principles: DataFrame) -> DataFrame:
    """(status, id, line): the lines of the index, principles in force and those under re-check; sort by status and id to write it."""
    status = F.when(F.col("status") == "active", "active").otherwise("under re-check")
    return principles.select(status.alias("status"), "id", F.concat(F.lit("- ["), F.coalesce("title", "id"), F.lit("]("), F.col("id"), F.lit(".md)")).alias("line"))
