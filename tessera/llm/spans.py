"""Matches of a pattern with their places, by DataFrame functions.

`split` gives the text between the matches and `regexp_extract_all` the matches; both find the same ones, so running
lengths of the two give each match's start and end in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"
#: Matches that one inner fold takes: folds copy their array for each match, so long lists are folded in runs.
RUN = 256


def spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None, hint: Column | None = None) -> Column:
    """Spans of the matches of `pattern` that `keep` accepts, as SPAN.  hint: cheaper test that a text may have one."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(between, found, lambda b, m: F.struct(m.alias("m"), F.length(b).alias("b")))  # the last has no match
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + x["b"]
        end = at + F.length(x["m"])
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("match"))
        good = x["m"].isNotNull() if keep is None else x["m"].isNotNull() & keep(x["m"])
        return F.struct(F.coalesce(end, at).alias("at"), F.when(good, F.concat(state["out"], F.array(span))).otherwise(state["out"]).cast(SPAN).alias("out"))

    def whole(every: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / RUN).cast("int")), lambda i: F.aggregate(F.slice(every, i * RUN + 1, F.lit(RUN)), start, step))
        moved = lambda state, run: F.struct(
            (state["at"] + run["at"]).alias("at"),
            F.concat(state["out"], F.array(F.transform(run["out"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), s["kind"], (s["end"] + state["at"]).alias("end"), s["match"])))).alias("out"),
        )
        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), moved, lambda state: F.flatten(state["out"]))

    some = text.rlike(pattern)
    if hint is not None:
        some = hint & some
    return F.when(some, whole(pieces)).otherwise(F.array().cast(SPAN))


def joined(found: Column, names: list[str]) -> Column:
    """kind:start:end of each, in the order of `found`, joined by commas."""
    name = F.array(*[F.lit(x) for x in names])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["end"])), ",")


def count_of(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
