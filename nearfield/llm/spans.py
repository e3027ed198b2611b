"""Places of regular-expression matches, natively: DataFrame functions only.

A span is a struct (start, end, value) in code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,value:string>>"
NAMED = "array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>"


#: Code points of a block of a text, and least items of a part of an array.
BLOCK = 1024
PART = 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(items: Column) -> Column:
    """``items`` in parts of about the root of their number, so that growing an array part by part copies little."""
    wide = F.greatest(F.lit(PART), F.ceil(F.sqrt(F.size(items))).cast("int"))
    many = F.greatest(F.ceil(F.size(items) / wide).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), many - 1), lambda j: F.slice(items, j * wide + 1, wide))


def matches(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Spans of the leftmost, non-overlapping matches for which ``valid(value)`` holds.

    The text between matches and the matches themselves come from the same scan
    order, so running lengths give the places.  pattern: Java syntax, no empty matches.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))
        keep = F.when(x["hit"].isNull(), False).otherwise(F.coalesce(valid(x["hit"]), F.lit(False)))
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    local = lambda all_pieces: F.transform(_parts(all_pieces), lambda part: F.aggregate(part, start, step))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<by:int,out:{SPANS}>>").alias("out"))
    placed = lambda parts: F.aggregate(
        parts, begin, lambda state, x: F.struct((state["at"] + x["at"]).alias("at"), F.concat(state["out"], F.array(F.struct(state["at"].alias("by"), x["out"].alias("out")))).alias("out")), lambda state: state["out"]
    )
    moved = lambda part: F.transform(part["out"], lambda s: F.struct((s["start"] + part["by"]).alias("start"), (s["end"] + part["by"]).alias("end"), s["value"].alias("value")))
    return F.flatten(F.transform(placed(bound(pieces, local)), moved))


def running_max(values: Column) -> Column:
    """The largest of the ints up to each place."""
    low = F.lit(-(2**31)).cast("int")
    grown = lambda state, x: bound(F.greatest(state["top"], x), lambda top: F.struct(top.alias("top"), F.concat(state["out"], F.array(top)).alias("out")))
    start = F.struct(low.alias("top"), F.array().cast("array<int>").alias("out"))
    local = F.transform(_parts(values), lambda part: F.aggregate(part, start, grown))
    begin = F.struct(low.alias("top"), F.array().cast("array<struct<least:int,out:array<int>>>").alias("out"))
    step = lambda state, x: F.struct(F.greatest(state["top"], x["top"]).alias("top"), F.concat(state["out"], F.array(F.struct(state["top"].alias("least"), x["out"].alias("out")))).alias("out"))
    parts = F.aggregate(local, begin, step, lambda state: state["out"])
    return F.flatten(F.transform(parts, lambda part: F.transform(part["out"], lambda x: F.greatest(x, part["least"]))))


def blocks(text: Column) -> Column:
    """``text`` in blocks, from which ``cut`` takes a piece without walking the whole text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(parts: Column, begin: Column, length: Column) -> Column:
    first = F.floor(begin / BLOCK).cast("int")
    many = F.floor((begin + length) / BLOCK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(parts, first + 1, many), ""), begin % BLOCK + 1, length)


def none() -> Column:
    return F.array().cast(SPANS)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    d = digits(value)
    n = F.char_length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number (letters A-Z count 10 to 35) gives 1 modulo 97, its first four characters last."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def add(total: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, total * 10 + c - 48).otherwise(total * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), add) == 1


def named(spans: Column, kind: str, rank: int, score: Callable[[Column], Column]) -> Column:
    """Spans as (start, rank, end, kind, value, score), which sort by start, then by rank."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"), score(s).cast("double").alias("score")))


def clear_of(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``, in order of start: one pass each way over all of them."""

    def tested(own: Column, base: Column) -> Column:
        mark = lambda x, rank: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x.alias("span"))
        both = F.array_sort(F.concat(F.transform(base, lambda x: mark(x, 0)), F.transform(own, lambda x: mark(x, 1))))

        def passed(all_spans: Column) -> Column:
            low = F.lit(-(2**31)).cast("int")
            before = running_max(F.transform(all_spans, lambda x: F.when(x["rank"] == 0, x["end"]).otherwise(low)))
            after = F.reverse(running_max(F.reverse(F.transform(all_spans, lambda x: F.when(x["rank"] == 0, -x["start"]).otherwise(low)))))
            kept = F.filter(F.arrays_zip(all_spans.alias("x"), before.alias("b"), after.alias("a")), lambda z: (z["x"]["rank"] == 1) & (z["b"] <= z["x"]["start"]) & (z["x"]["end"] + z["a"] <= 0))
            return F.transform(kept, lambda z: z["x"]["span"])

        return bound(both, passed)

    return bound(spans, lambda own: F.when(F.size(own) == 0, own).otherwise(bound(others, lambda base: F.when(F.size(base) == 0, own).otherwise(tested(own, base)))))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mask: Callable[[Column], Column]) -> Column:
    """``text`` with each span (sorted by start; overlaps merge) replaced by ``mask(span)``."""

    def pieces(own: Column, reach: Column, parts: Column) -> Column:
        # What stands before a span that no earlier one reaches, and its mask.
        zipped = F.arrays_zip(own.alias("s"), F.concat(F.array(F.lit(0)), reach).alias("at"))
        fresh = F.filter(zipped, lambda z: z["s"].isNotNull() & (z["s"]["start"] >= z["at"]))
        masked = F.array_join(F.transform(fresh, lambda z: F.concat(cut(parts, z["at"], z["s"]["start"] - z["at"]), mask(z["s"]))), "")
        last = F.element_at(reach, -1)
        return F.concat(masked, cut(parts, last, F.char_length(text) - last))

    whole = lambda own: bound(running_max(F.transform(own, lambda s: s["end"])), lambda reach: bound(blocks(text), lambda parts: pieces(own, reach, parts)))
    return bound(spans, lambda own: F.when(F.size(own) > 0, whole(own)).otherwise(text))
