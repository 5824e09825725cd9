"""Personal data: patterns propose, checksums confirm, words nearby weigh.

Column expressions only. Every span has a score: what its kind is worth once its
checks hold, and more if one of the kind's context words stands within `WINDOW`
characters before or after it. Kinds in `BASE` are kept whatever the score; the
others need `THRESHOLD`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsquant.llm.spans import digits_of, luhn, mod97, with_spans

WINDOW = 48
THRESHOLD = 0.6
RAISE = 0.35


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, worth without context, and context words."""

    pattern: str
    worth: float
    context: tuple[str, ...]


# A local part starts where none of its characters stands before, or where the last
# match ended; so a long run of such characters is read once. Possessive repeats
# match as the plain ones do here: what follows them is in none of their classes.
_LOCAL = "[A-Za-z0-9._%+-]"
#: In the order in which spans with one start are listed.
KINDS: dict[str, Kind] = {
    "email": Kind(rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, ("mail", "contact")),
    "ip": Kind(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, ("ip", "host", "server", "address")),
    "card": Kind(r"[0-9](?:[\x20-]?[0-9]){11,}+", 0.7, ("card", "visa", "credit", "payment", "karte", "carte")),
    "phone": Kind(r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, ("phone", "tel", "call", "mobile", "fax")),
    "iban": Kind(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", 0.8, ("iban", "account", "bank", "konto", "compte")),
    "ssn": Kind(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, ("ssn", "social security", "tax id")),
}
BASE = ("email", "ip", "card", "phone")


def valid(kind: str, s: Column) -> Column:
    """Whether a span passes the checks of its kind."""
    digits = digits_of(s["match"])
    count = F.length(digits)
    free = lambda pattern: ~s["before"].rlike(pattern) & ~s["after"].rlike(pattern)
    if kind == "ip":
        parts = F.split(s["match"], r"\.")
        small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(parts, lambda p: small(p) & (F.right(p, F.lit(4)).cast("int") <= 255))
    if kind == "card":
        return count.between(12, 19) & luhn(digits)
    if kind == "phone":
        return count.between(9, 15)
    if kind == "iban":
        code = F.replace(s["match"], F.lit(" "), F.lit(""))
        return free("[A-Za-z0-9]") & F.length(code).between(15, 34) & mod97(code)
    if kind == "ssn":
        return free("[0-9-]") & ~s["match"].rlike("^(000|666|9)|-00-|0000$")
    return F.lit(True)


def _scored(rank: int, name: str, kind: Kind, threshold: float) -> Column:
    """The confirmed spans of one kind with their scores."""
    text = F.col("text")
    words = "|".join(kind.context)

    def scored(s: Column) -> Column:
        near = F.concat_ws(
            " ",
            F.substr(text, F.greatest(s["start"] - WINDOW + 1, F.lit(1)), F.least(s["start"], F.lit(WINDOW))),
            F.substr(text, s["end"] + 1, F.lit(WINDOW)),
        )
        more = F.lit(min(kind.worth + RAISE, 1.0))
        return F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            s["end"].alias("end"),
            F.lit(name).alias("kind"),
            F.when(F.lower(near).rlike(words), more).otherwise(F.lit(kind.worth)).alias("score"),
        )

    found = F.transform(F.filter(F.col(f"_{name}"), lambda s: valid(name, s)), scored)
    return found if name in BASE else F.filter(found, lambda s: s["score"] >= threshold)


def find_personal_data(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Adds the personal data of every whole text.

    Returns the id column and `spans`, an array of (start, rank, end, kind, score)
    in order of start and of `KINDS`; `rank` is the place in `KINDS`. One row for
    each row of `docs`, repeated ids and null ids included; other columns are not
    read. A null or empty text has no spans. Spans of different kinds may overlap.
    """
    text = F.col("text")
    digit = text.rlike("[0-9]")
    gates = {
        "email": text.contains("@"),
        "phone": text.contains("+"),
        "iban": text.rlike("[A-Z]{2}[0-9]{2}"),
        "ssn": text.rlike("[0-9]-[0-9]{2}-"),
    }
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    rows = with_spans(rows, "text", {k: (v.pattern, gates.get(k, digit)) for k, v in KINDS.items()})
    parts = [_scored(rank, name, kind, threshold) for rank, (name, kind) in enumerate(KINDS.items())]
    return rows.select(F.col("id").alias(id_column), F.array_sort(F.concat(*parts)).alias("spans"))
