"""Chat formatting: a role automaton, a declarative template, loss flags, and the way back.

All of it is DataFrame functions. A conversation's rows meet by conv_id (they are one
training example and have to), in order of turn. The automaton is a table of allowed
(state, role) steps folded over the roles; conversations it rejects are formatted all the
same and flagged, so that a caller may filter.

Template: each turn is ``### role: `` + escaped text + ``</turn>\\n``. Inside texts a
backslash, ``#`` and ``<`` (in roles also ``:``) become two-character escapes, so no control string can occur in
an escaped text, and reading back is exact for every text.

Defined cases: null text and null role count as empty; rows with a null conv_id form one
conversation; equal turn numbers are ordered by role and text; null turns come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
#: Texts of these roles carry the loss.
TRAINED = ("assistant",)
# The automaton. state, role read, next state.
STEPS = (
    ("start", "system", "system"),
    ("start", "user", "user"),
    ("system", "user", "user"),
    ("user", "assistant", "assistant"),
    ("assistant", "user", "user"),
)
ACCEPTING = ("user", "assistant")


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape(text: Column) -> Column:
    """Pairs of backslashes are cut from left to right first, so what is left of a backslash starts another escape."""

    def part(x: Column) -> Column:
        for code, plain in (("\\h", "#"), ("\\l", "<"), ("\\c", ":")):
            x = F.replace(x, F.lit(code), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def accepted(roles: Column) -> Column:
    step = {f"{state}\n{role}": then for state, role, then in STEPS}
    table = F.create_map(*[F.lit(x) for pair in step.items() for x in pair])
    end = F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.get(F.array(F.try_element_at(table, F.concat(s, F.lit("\n"), r))), F.lit(0)), F.lit("rejected")))
    return end.isin(*ACCEPTING)


def formatted(rows: DataFrame) -> DataFrame:
    """(conv_id, valid, segments array<struct<text, loss>>, formatted) per conversation."""
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    opened = lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(AFTER_ROLE))
    segments = F.flatten(F.transform("turns", lambda t: F.array(segment(opened(t), F.lit(False)), segment(escape(t["text"]), t["role"].isin(*TRAINED)), segment(F.lit(CLOSE), F.lit(False)))))
    made = talks.select("conv_id", accepted(F.transform("turns", lambda t: t["role"])).alias("valid"), segments.alias("segments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(made: DataFrame) -> DataFrame:
    """(conv_id, valid, turns array<struct<role, text>>, loss_text, formatted_chars) from formatted() alone."""
    raw = F.split("formatted", CLOSE)
    bodies = F.slice(raw, F.lit(1), F.greatest(F.size(raw) - 1, F.lit(0)))
    head = lambda x: F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), AFTER_ROLE, 1)
    turn = lambda x: F.struct(unescape(head(x)).alias("role"), unescape(F.substr(x, F.lit(len(OPEN) + len(AFTER_ROLE) + 1) + F.length(head(x)))).alias("text"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return made.select("conv_id", "valid", F.transform(bodies, turn).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(rows: DataFrame) -> DataFrame:
    back = read_back(formatted(rows))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c, 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(whole).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"), "formatted_chars", "valid")
