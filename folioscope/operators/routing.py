"""What a question asks for, by ordered rules: the first rule that fits decides, and words are sought as parts of words.

Rules are given as (result, parts of words) and can be replaced; a null question has no result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of passages, in the order in which they are tried.
KINDS = [
    ("key", ["key message", "headline"]), ("kg", ["knowledge gap", "research need"]), ("il", ["figure", "illustration", "table", "diagram"]), ("ref", ["reference", "citation", "cited", "bibliograph"]),
    ("guidance", ["guidance", "how to use"]), ("person", ["expert", "author", "who wrote", "lead"]), ("chapter", ["chapter"]),
]
#: What points to the reports of meetings.
MEETINGS = ["session", "meeting", "plenary", "chair"]
#: How many rows each kind asks for, and for any other.
ROWS = {"ref": 30, "key": 100, "kg": 100, "person": 200}
OTHER_ROWS = 3


def has_any(question: Column, parts: list[str]) -> Column:
    low = F.lower(question)
    found = low.contains(parts[0])
    for p in parts[1:]:
        found = found | low.contains(p)
    return found


def kind(question: Column, rules: list[tuple[str, list[str]]] = KINDS) -> Column:
    out = F.lit(None).cast("string")
    for name, parts in reversed(rules):
        out = F.when(has_any(question, parts), name).otherwise(out)
    return out


def route(question: Column) -> Column:
    """plenary, assessments or both: what names a meeting goes to its reports, what asks for a kind to the assessments."""
    return F.when(question.isNotNull(), F.when(has_any(question, MEETINGS), "plenary").when(kind(question).isNotNull(), "assessments").otherwise("both"))


def plan(question: Column) -> Column:
    """(kind, k, per_group): key messages and references are one list, everything else is sought in each group."""
    asked = kind(question)
    k = F.lit(OTHER_ROWS)
    for name, n in ROWS.items():
        k = F.when(asked == name, n).otherwise(k)
    return F.struct(asked.alias("kind"), k.alias("k"), (~F.coalesce(asked.isin("key", "ref"), F.lit(False))).alias("per_group"))


def with_latest(question: Column, latest: Column) -> Column:
    """A question about the last or the next session, with the number that this means put after it."""
    low = F.lower(question)
    number = F.when(low.rlike(r"\b(last|latest|most recent) (session|meeting)\b"), latest).when(low.rlike(r"\b(next|coming) (session|meeting)\b"), latest + 1)
    return F.when(number.isNotNull(), F.concat(question, F.lit(" (session "), number.cast("string"), F.lit(")"))).otherwise(question)
