"""Places of regular-expression matches in texts, by column expressions alone.

The matches of a pattern and the text between them are two arrays from the same
left-to-right search; the lengths of both, added up, are the places. The running sum
is taken in blocks, so that a text with very many matches costs little more than its
length. Places count code points from 0, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
SPAN = "struct<start:int,end:int,match:string,before:string,after:string>"


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda acc, x: acc + x)


def _block_starts(widths: Column, count: Column) -> Column:
    """Sums of all widths before each block."""
    blocks = F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: _total(F.slice(widths, b * BLOCK + 1, F.lit(BLOCK))))
    return F.aggregate(
        sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    )


def _placed(hits: Column, between: Column, widths: Column, starts: Column) -> Column:
    def place(match: Column, i: Column) -> Column:
        whole = F.floor(i / BLOCK).cast("int")
        inside = _total(F.slice(widths, whole * BLOCK + 1, i % BLOCK))
        at = F.get(starts, whole) + inside + F.length(F.get(between, i))
        return F.struct(
            at.cast("int").alias("start"),
            (at + F.length(match)).cast("int").alias("end"),
            match.alias("match"),
            F.right(F.get(between, i), F.lit(1)).alias("before"),
            F.left(F.get(between, i + 1), F.lit(1)).alias("after"),
        )

    return F.transform(hits, place)


def with_spans(rows: DataFrame, text: str, patterns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """Adds one array of spans for each pattern, under the name `_<key>`.

    `patterns` maps a key to a pattern and a cheap condition that any text with a
    match meets, or None. A span is (start, end, match, before, after); the last two
    are the characters next to it, empty at the ends of the text. A null text has
    empty arrays. Patterns must not match the empty string.
    """
    empty = F.array().cast("array<string>")
    steps: list[dict[str, Column]] = [{}, {}, {}, {}, {}]
    for key, (pattern, condition) in patterns.items():
        needed = F.col(text).isNotNull() if condition is None else F.coalesce(condition, F.lit(False))
        hits, between, widths, starts = (F.col(f"_{key}_{part}") for part in ("found", "rest", "widths", "starts"))
        some = F.size(hits) > 0
        steps[0][f"_{key}_found"] = F.when(
            needed, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        ).otherwise(empty)
        steps[1][f"_{key}_rest"] = F.when(some, F.split(F.col(text), pattern, -1)).otherwise(empty)
        steps[2][f"_{key}_widths"] = F.zip_with(
            F.slice(between, F.lit(1), F.size(hits)), hits, lambda a, b: F.length(a) + F.length(b)
        )
        steps[3][f"_{key}_starts"] = F.when(some, _block_starts(widths, F.size(hits))).otherwise(F.array(F.lit(0)))
        steps[4][f"_{key}"] = F.when(some, _placed(hits, between, widths, starts)).otherwise(
            F.array().cast(f"array<{SPAN}>")
        )
    # Each step reads columns that the one before has computed; none is computed in a lambda.
    for step in steps:
        rows = rows.withColumns(step)
    return rows.drop(*(name for step in steps[:4] for name in step))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reverse = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        x = F.substr(reverse, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code of letters and digits has the check remainder 1."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def add(acc: Column, i: Column) -> Column:
        x = F.substr(moved, i, F.lit(1))
        value = F.when(x.between("0", "9"), x.cast("int")).otherwise(F.ascii(x) - 55)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def joined(spans: Column) -> Column:
    """kind:start:end of an array of spans, joined by commas."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )
