"""Where patterns match, in code points, with column functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "array<struct<start:bigint,end:bigint,text:string,part:string>>"


def pattern_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: start, end (exclusive), text and the group's text.

    The pieces between the matches give the distances; both lists come from the same matcher.
    """
    none = F.array().cast(SPAN)

    def placed(found: Column) -> Column:
        rows = F.arrays_zip(found.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"))
        start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + F.char_length(x["gap"])
            end = at + F.char_length(x["m"])
            return F.struct(end.cast("bigint").alias("at"), F.concat(acc["spans"], F.array(F.struct(at.cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["m"].alias("text"), x["g"].alias("part")))).cast(SPAN).alias("spans"))

        return F.aggregate(rows, start, step, lambda acc: acc["spans"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def of_kind(spans: Column, rank: int, kind: str) -> Column:
    """Spans as struct(start, rank, end, kind, text), ready to be sorted by start and then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text")))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def blanked(text: Column, spans: Column, fill: str = " ") -> Column:
    """The text with a filler in the places of spans that are sorted by start."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        blank = F.repeat(F.lit(fill), (s["end"] - F.greatest(s["start"], acc["at"])).cast("int"))
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], before, blank).alias("out")))

    rest = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, sorted by start, replaced by its kind in brackets; overlaps count once."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        new = F.concat(acc["out"], before, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(new).alias("out")))

    rest = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
