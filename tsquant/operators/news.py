"""Sentiment scores, articles and index members."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace
from datetime import datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsquant.functions.series import SLOT, Series, join_slots, measured, with_slots

DAY_SECONDS = 86_400


def value_before(
    df: DataFrame,
    value: str,
    seconds: int,
    out: str,
    series: Series | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add the last known ``value`` of the same key at or before ``seconds`` ago.

    Values and questions (each row's time less the distance) are put in one time
    order and the last value is carried forward. Order is only needed within a
    slot of time; what a slot inherits comes from the small slot table.

    ``source`` is a table with the keys, times and values of ``df`` that is cheaper
    to read again, such as the one ``df`` was derived from.
    """
    source = df if source is None else source
    series = measured(source, Series.of(df, series))
    at, known, question = "_at", "_known", "_question"
    # Rows of a busy hour ask about the hour that long before it.
    slots = series.slots and series.slots.also_before(seconds)
    cut = replace(series, time=at, tiebreak=(question, *series.tiebreak), slots=slots)
    own = F.col(series.time).cast("timestamp")
    ago = own - F.make_dt_interval(secs=F.lit(seconds))
    values = source.where(F.col(value).isNotNull()).select(
        *series.keys, own.alias(at), *series.tiebreak, F.col(value).alias(known),
        F.lit(False).alias(question),
    )

    newest = F.struct(at, *series.tiebreak)
    slots, _ = with_slots(
        values.unionByName(
            source.select(*series.keys, ago.alias(at), F.lit(True).alias(question)),
            allowMissingColumns=True,
        ),
        cut,
    )
    slots = slots.groupBy(*cut.keys, SLOT).agg(
        F.max_by(known, F.when(~F.col(question), newest)).alias("_last")
    )
    earlier = cut.slots_in_order().rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(
        *cut.keys,
        SLOT,
        F.last("_last", ignorenulls=True).over(earlier).alias("_inherited"),
        F.lit(True).alias("_there"),
    )

    asked = df.withColumns({at: ago, question: F.lit(True)})
    both, _ = with_slots(asked.unionByName(values, allowMissingColumns=True), cut)
    so_far = cut.slot_window().rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(known, ignorenulls=True).over(so_far)
    elsewhere = F.raise_error(F.lit("source lacks a time of the rows")).cast("boolean")
    return (
        join_slots(both, slots, cut)
        .where(F.coalesce("_there", elsewhere))
        .withColumn(out, F.coalesce(last, "_inherited"))
        .where(F.col(question))
        .select(*df.columns, out)
    )


def values_before(
    df: DataFrame, value: str, ages: dict[str, int], series: Series | None = None
) -> DataFrame:
    """Add the last known ``value`` of the same key at or before several ages ago.

    ``ages`` maps a new column to its distance in seconds. Every row becomes one
    value and one question for each age; all of them share one slot table and one
    pass in time order, and the answers of a row meet again by its value. Rows of one
    key and time all come back.
    """
    series = measured(df, Series.of(df, series))
    at, known, asked = "_at", "_known", "_asked"
    slots = series.slots
    for seconds in ages.values():
        slots = slots and slots.also_before(seconds)
    cut = replace(series, time=at, tiebreak=(asked, *series.tiebreak), slots=slots)
    own = F.col(series.time).cast("timestamp")
    entry = [F.struct(own.alias(at), F.col(value).alias(known), F.lit(0).alias(asked))]
    nothing = F.lit(None).cast(df.schema[value].dataType)
    for number, seconds in enumerate(ages.values(), 1):
        ago = own - F.make_dt_interval(secs=F.lit(seconds))
        entry.append(F.struct(ago.alias(at), nothing.alias(known), F.lit(number).alias(asked)))
    both = df.select("*", F.inline(F.array(*entry))).where((F.col(asked) > 0) | F.col(known).isNotNull())
    slotted, _ = with_slots(both, cut)

    newest = F.when(F.col(asked) == 0, F.struct(at, *series.tiebreak))
    slots = slotted.groupBy(*cut.keys, SLOT).agg(F.max_by(known, newest).alias("_last"))
    earlier = cut.slots_in_order().rowsBetween(Window.unboundedPreceding, -1)
    inherited = F.last("_last", ignorenulls=True).over(earlier).alias("_inherited")
    so_far = cut.slot_window().rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(known, ignorenulls=True).over(so_far)
    answered = (
        join_slots(slotted, slots.select(*cut.keys, SLOT, inherited), cut)
        .withColumn("_answer", F.coalesce(last, "_inherited"))
        .where(F.col(asked) > 0)
    )
    # The answers of a row meet by its whole value: equal rows are counted and come out as
    # often as they went in. Maps cannot be grouped by, their entries can.
    kinds = {f.name: f.dataType for f in df.schema.fields}
    maps = [c for c, kind in kinds.items() if isinstance(kind, T.MapType)]
    whole = [F.sort_array(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in df.columns]
    found = [F.max(F.when(F.col(asked) == n, F.col("_answer"))).alias(out) for n, out in enumerate(ages, 1)]
    rows = answered.groupBy(*whole).agg(F.count_if(F.col(asked) == 1).alias("_copies"), *found)
    rows = rows.withColumns({c: F.map_from_entries(c) for c in maps})
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")
    return rows.select(*df.columns, *ages, copies).drop("_copy")


def sentiment_evolution(
    scores: DataFrame, score: str = "sentiment_score", series: Series | None = None
) -> DataFrame:
    """Change of the score against 24 hours and 7 days ago; NULL without a score
    that old."""
    ages = {"_day_ago": DAY_SECONDS, "_week_ago": 7 * DAY_SECONDS}
    aged = values_before(scores, score, ages, series)
    return aged.withColumns(
        {
            "evolution_24h": F.col(score) - F.col("_day_ago"),
            "evolution_7d": F.col(score) - F.col("_week_ago"),
        }
    ).drop(*ages)


def daily_sentiment(
    scores: DataFrame,
    score: str = "sentiment_score",
    importance: str = "importance",
    time: str = "timestamp",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Importance-weighted mean score and number of articles per day."""
    weight = F.col(importance)
    return scores.groupBy(*keys, F.to_date(time).alias("date_bucket")).agg(
        F.try_divide(F.sum(weight * F.col(score)), F.sum(F.when(F.col(score).isNotNull(), weight)))
        .alias("sentiment_score"),
        F.count("*").alias("articles"),
    )


def daily_keywords(
    scores: DataFrame,
    keywords: str = "keywords",
    time: str = "timestamp",
    keys: Sequence[str] = (),
) -> DataFrame:
    """How often each keyword was given per day."""
    return (
        scores.select(*keys, F.to_date(time).alias("date_bucket"), F.explode(keywords).alias("keyword"))
        .groupBy(*keys, "date_bucket", "keyword")
        .agg(F.count("*").alias("mentions"))
    )


def articles_by_symbol(
    articles: DataFrame,
    symbols: Sequence[str] | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
    processed: bool | None = None,
) -> DataFrame:
    """One row per article and symbol it mentions, narrowed by symbol, time and
    state. Conditions on the article come before the unfolding."""
    if since is not None:
        articles = articles.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        articles = articles.where(F.col("timestamp") < F.lit(until).cast("timestamp"))
    if processed is not None:
        articles = articles.where(F.col("processed") == processed)
    if symbols is not None:
        wanted = F.array(*[F.lit(s) for s in symbols])
        articles = articles.where(F.arrays_overlap("symbols", wanted))
    rows = articles.withColumn("symbol", F.explode(F.array_distinct("symbols")))
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin(list(symbols)))
    return rows


def index_composition(
    indices: DataFrame, companies: DataFrame, sector: str = "sector"
) -> DataFrame:
    """Members of each index with their attributes and weight: the weight of the
    sector in the index, shared equally by its members there. A member that is no
    known company, or of no known sector, stays with null attributes and no weight."""
    members = indices.select(
        "country",
        "index_symbol",
        "sector_weights",
        F.explode(F.array_distinct("composition")).alias("company_symbol"),
    ).join(companies, "company_symbol", "left")
    # An index has as many rows as members.
    together = Window.partitionBy("country", "index_symbol", sector)
    weight = F.try_element_at("sector_weights", F.col(sector))
    return (
        members.withColumn("sector_members", F.count(F.lit(1)).over(together))
        .withColumn("sector_weight", weight)
        .withColumn("weight", F.col("sector_weight") / F.col("sector_members"))
        .drop("sector_weights")
    )


# Fixed values of HTML: elements without content, elements whose content is not
# text, and elements that run on within a line.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
}
NO_TEXT = {"script", "style", "template"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del",
    "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}


class _FirstElement(HTMLParser):
    """Collects the text of the first element with the tag and class."""

    def __init__(self, tag: str, css_class: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.css_class = tag, css_class
        self.depth = 0  # open elements of the wanted tag, from the match on
        self.muted = 0
        self.done = False
        self.parts: list[str] = []

    def _matches(self, tag, attrs) -> bool:
        if tag != self.tag:
            return False
        classes = (dict(attrs).get("class") or "").split()
        return self.css_class is None or self.css_class in classes

    def handle_starttag(self, tag, attrs):
        if self.done or tag in VOID:
            if self.depth and tag in ("br", "hr"):
                self.parts.append(" ")
            return
        if self.depth:
            self.depth += tag == self.tag
            self.muted += tag in NO_TEXT
            if tag not in INLINE:
                self.parts.append(" ")
        elif self._matches(tag, attrs):
            self.depth = 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.done or not self.depth:
            return
        if tag not in INLINE:
            self.parts.append(" ")
        self.muted -= tag in NO_TEXT and self.muted > 0
        self.depth -= tag == self.tag
        self.done = not self.depth

    def handle_data(self, data):
        if self.depth and not self.done and not self.muted:
            self.parts.append(data)


def first_element_text(html: str | None, tag: str, css_class: str | None) -> str:
    """Text of the first matching element with white space folded, '' without one."""
    if not html:
        return ""
    parser = _FirstElement(tag, css_class)
    parser.feed(html)
    parser.close()
    return " ".join("".join(parser.parts).split())


def article_text(
    pages: DataFrame, tag: str = "article", css_class: str | None = None, html: str = "html"
) -> DataFrame:
    """Pages with ``article_text``, the text of their first matching element."""

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([first_element_text(page, tag, css_class) for page in batch], dtype=str)

    extract = F.pandas_udf(texts, "string")
    return pages.withColumn("article_text", extract(F.col(html))).drop(html)
