"""Classification, filters and conformance of notes.

Findings have a shape of their own: (path, rule, detail). Conditions are three-valued where a
measure may be missing: null means "not known", never "passed".
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailnote.functions import markdown as md
from trailnote.sources.notes import headers, note_items, note_sections
from trailnote.sources.templates import STATES, catalog

# Kinds of input. The signs that tell them, and the order in which these are tried, are ours.
INPUT_KINDS = (
    ("periodic review", r"\b((last|this|past) (week|month|quarter|year)|looking back|in review|retrospective)\b"),
    ("profile update", r"\b(i am (a|an|now)|my (role|goals?|values|strengths?|constraints?|preferences?) (is|are|changed)|i now (live|work|prefer|value))\b"),
    ("evidence capture", r"\b(observed|measured|noticed|recorded|saw that|found that|results? (was|were))\b"),
    ("experiment design", r"\b(test (it|whether|if)|try (it|out)|experiment|trial|pilot|for (the next )?[0-9]+ (days|weeks))\b"),
    ("principle synthesis", r"\b(always|never|rule of thumb|as a rule|principle|from now on)\b"),
    ("new assumption", r"\b(i (believe|think|suspect|assume|guess)|hypothesis|assumption|probably|might be)\b"),
)
# Scopes from wide to narrow.
SCOPES = ("always", "current season", "under constraints", "habit / environment")


def classify(text: Column) -> Column:
    """One of the six input kinds, or 'unclassified'; null text is unclassified."""
    return F.coalesce(*[F.when(F.lower(text).rlike(rule), F.lit(kind)) for kind, rule in INPUT_KINDS], F.lit("unclassified"))


def split_input(rows: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, ord, unit, kind): a mixed input as its smallest useful units, which are list items and paragraphs."""
    units = F.filter(F.split(md.without_fences(F.col(text)), r"\n\s*\n|\n(?=\s*[-*+]\s)"), lambda x: F.trim(x, F.lit(" \t\n-*+#")) != "")
    cut = rows.select(F.col(key), F.posexplode(F.transform(units, lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*+#]+\s+", ""), F.lit(" \t\n")))).alias("ord", "unit"))
    return cut.withColumn("kind", classify(F.col("unit")))


def score(conditions: Mapping[str, Column]) -> Column:
    """How many conditions hold; unknown ones do not."""
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions.values()), F.lit(0))


def judged(rows: DataFrame, conditions: Mapping[str, Column], least: int | None = None) -> DataFrame:
    """rows with each condition as a column, score, and passed: at least so many of them, all by default."""
    return rows.select("*", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in conditions.items()], score(conditions).alias("score"), (score(conditions) >= (len(conditions) if least is None else least)).alias("passed"))


def assumption_quality(rows: DataFrame, specific: Column, relevant: Column, grounded: Column) -> DataFrame:
    """judged() by the three qualities of an assumption: specific, relevant to a decision, grounded in something seen."""
    return judged(rows, {"specific": specific, "relevant": relevant, "grounded": grounded})


def experiment_quality(rows: DataFrame, cheap: Column, short: Column, clear: Column, reversible: Column) -> DataFrame:
    """judged() by the four qualities of an experiment: cheap enough to run, short enough to finish, clear enough to interpret, safe enough to reverse."""
    return judged(rows, {"cheap": cheap, "short": short, "clear": clear, "reversible": reversible})


def gate(measures: Mapping[str, tuple[Column, float]]) -> Column:
    """'continue' if every measure reaches its minimum, 'drop' if one is below, else 'unknown'."""
    below = F.lit(False)
    missing = F.lit(False)
    for value, least in measures.values():
        below = below | F.coalesce(value < least, F.lit(False))
        missing = missing | value.isNull()
    return F.when(below, "drop").when(missing, "unknown").otherwise("continue")


def relevant(notes: DataFrame, heading: str = "Decision Relevance") -> DataFrame:
    """(path, relevant): whether the section that says which decision is affected has any text."""
    parts = note_sections(notes).filter(F.col("heading") == heading).groupBy("path").agg(F.max(F.length(F.trim("body", F.lit(" \t\n-"))) > 0).alias("has"))
    return notes.select("path").join(parts, "path", "left").select("path", F.coalesce("has", F.lit(False)).alias("relevant"))


def missing_fields(notes: DataFrame) -> DataFrame:
    """(path, kind, name): declared fields that a note's header lacks or leaves empty."""
    declared = F.broadcast(catalog(notes.sparkSession).filter("part = 'field'").groupBy("kind").agg(F.collect_list("name").alias("names")))
    met = headers(notes).join(declared, "kind")
    return met.select("path", "kind", F.explode(F.filter("names", lambda n: F.try_element_at(F.col("fm"), n).isNull())).alias("name"))


def section_conformance(notes: DataFrame) -> DataFrame:
    """(path, heading, finding): template sections that are missing, level-2 headings that are extra."""
    declared = F.broadcast(catalog(notes.sparkSession).filter("part = 'section'").groupBy("kind").agg(F.collect_list("name").alias("names")))
    heads = F.array_distinct(F.transform(F.filter(md.sections(F.col("text")), lambda s: s["level"] == 2), lambda s: s["heading"]))
    met = notes.select("path", "kind", heads.alias("heads")).join(declared, "kind")
    tagged = lambda xs, what: F.transform(xs, lambda x: F.struct(x.alias("heading"), F.lit(what).alias("finding")))
    both = F.concat(tagged(F.array_except("names", "heads"), "missing"), tagged(F.array_except("heads", "names"), "extra"))
    return met.select("path", F.explode(both).alias("x")).select("path", "x.*")


def state_conflicts(notes: DataFrame) -> DataFrame:
    """(path, folder_state, status): notes whose header disagrees with their folder; the folder wins."""
    rows = headers(notes).select("path", "folder_state", F.col("fm")["status"].alias("status"))
    return rows.filter(F.col("folder_state").isNotNull() & ~F.col("folder_state").eqNullSafe(F.col("status")))


def value_findings(notes: DataFrame) -> DataFrame:
    """(path, rule, detail): unknown prefix, unknown state, confidence outside 0 to 1, no header."""
    fm = F.col("fm")
    value = fm["confidence"].try_cast("double")
    checks = [
        ("no header", F.size(fm) == 0, F.lit(None)),
        ("unknown prefix", fm["id"].isNotNull() & ~md.parse_id(fm["id"])["known"], fm["id"]),
        ("unknown status", fm["status"].isNotNull() & ~fm["status"].isin(*STATES), fm["status"]),
        ("confidence", fm["confidence"].isNotNull() & ~F.coalesce(value.between(0, 1), F.lit(False)), fm["confidence"]),
    ]
    found = F.filter(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, bad, detail in checks]), lambda x: x.isNotNull())
    return headers(notes).select("path", F.explode(found).alias("x")).select("path", "x.*")


def placeholders(notes: DataFrame) -> DataFrame:
    """(path, heading): sections that have a heading and nothing but empty bullets."""
    return note_sections(notes).filter((F.col("level") > 0) & ~F.col("body").rlike(r"(?m)^[ \t]*(?:[-*+]|\d+[.)])?[ \t]*[^\s*+.-][^\n]*$")).select("path", "heading")


def item_counts(notes: DataFrame) -> DataFrame:
    """(path, heading, n_items)."""
    return note_items(notes).groupBy("path", "heading").agg(F.count("*").alias("n_items"))


def scope_valid(scope: Column) -> Column:
    """Whether scope is one of SCOPES; null is not."""
    return F.coalesce(scope.isin(*SCOPES), F.lit(False))


def scope_rank(scope: Column) -> Column:
    """1 for the widest scope; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in SCOPES]), scope), F.lit(0)).cast("int")


def excluded(flags: Sequence[Column]) -> Column:
    """Whether none of the reasons against holds; an unknown reason does not hold."""
    return ~score({str(i): f for i, f in enumerate(flags)}).cast("boolean")
