"""The note templates: kinds, their fields in order, their sections, their identifiers' prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fields of each kind's header, in order.
FIELDS = {
    "assumption": "id title status domain created_at updated_at confidence source related_profile related_experiment review_at verified_at falsified_at supersedes".split(),
    "experiment": "id title status created_at start_at end_at related_assumption owner cost_level confidence_before confidence_after".split(),
    "evidence": "id title date type related_assumption related_experiment source reliability".split(),
    "principle": "id title status validated_at validity_scope confidence derived_from recheck_at".split(),
    "review": "period date".split(),
    "sleep_offload": "date".split(),
}
# Sections of each kind, in order.
SECTIONS = {
    "assumption": ["Statement", "Why I Believe This", "What Would Make It True", "What Would Falsify It", "Minimal Test", "Decision Relevance", "Notes"],
    "experiment": ["Goal", "Hypothesis", "Method", "Success Criteria", "Failure Criteria", "Metrics Or Signals", "Risks", "Result Summary"],
    "evidence": ["Observation", "Interpretation", "Limits", "Raw Notes"],
    "principle": ["Principle Statement", "Why I Trust It", "Supporting Evidence", "Boundary Conditions", "How It Should Change Decisions"],
    "review": ["What Happened", "Assumptions Advanced", "Assumptions Invalidated", "New Evidence", "Emerging Principles", "What Needs Re-checking", "Next Focus"],
}
# Identifier prefix, kind, folder.
KINDS = (
    ("A", "assumption", "assumptions"),
    ("E", "experiment", "experiments"),
    ("EV", "evidence", "evidence"),
    ("P", "principle", "principles"),
    ("D", "decision", "decisions"),
    ("R", "review", "reviews"),
)
# Lifecycle states, and the moves allowed between them.
STATES = ("inbox", "active", "verified", "falsified", "archived")
MOVES = (
    ("inbox", "active"),
    ("active", "verified"),
    ("active", "falsified"),
    ("verified", "principle"),
    ("inbox", "archived"),
    ("active", "archived"),
    ("verified", "archived"),
    ("falsified", "archived"),
)


def catalog(spark: SparkSession) -> DataFrame:
    """(kind, part, name, ord): one row per declared field or section."""
    rows = [(kind, part, name, i) for part, of in (("field", FIELDS), ("section", SECTIONS)) for kind, names in of.items() for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "kind string, part string, name string, ord int")
