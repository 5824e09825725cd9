"""Near-duplicate documents: minima of universal hashes, bands, checks, components.

1. The words of a text give a set of shingles, hashed to 64 bits. Texts with equal
   sets are one class, led by its least id; only leaders go on.
2. Each of `hashes` universal hash functions gives the least value over the set;
   every `rows` minima make a band. Leaders that share a band are a bucket.
3. In a bucket, everyone is compared with its least id: first by the lowest bits of
   all minima (a signature of 128 bits whose distance bounds the similarity), then
   exactly, on the full sets. Links give components.
4. Members of a bucket that are still outside the component of its least id meet that
   component once: they are compared with it and with each other on the full sets, in
   blocks, and only what connects them is returned. Nothing is capped.
5. Components by large and small stars over all links.

At the threshold 0.8, 32 bands of 4 miss a pair with probability 5e-8; a signature is
refused at six deviations or more from what 0.8 gives.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsquant.llm.arrow import TwoGenerations, held, map_batches, text_slices
from tsquant.llm.components import components
from tsquant.llm.scratch import Scratch

#: Words a Python worker remembers in each of two generations.
WORDS = 100_000
#: Members compared with one leader in one task at most.
STAR = 2048
MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Settings:
    """What counts as similar, and how candidates are found."""

    words: int = 5
    percent: int = 80
    hashes: int = 128
    rows: int = 4
    seed: int = 1

    @property
    def most_different(self) -> int:
        """Differing signature bits beyond which a pair at the threshold is not to be expected."""
        p = (1 - self.percent / 100) / 2
        return math.ceil(self.hashes * p + 6 * math.sqrt(self.hashes * p * (1 - p)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Shingle sets, signatures and bands under fixed settings."""

    def __init__(self, settings: Settings):
        import xxhash

        self.settings = settings
        digest = xxhash.xxh3_64_intdigest
        self.memo = TwoGenerations(lambda words: [digest(w, settings.seed) for w in words], WORDS)
        random = np.random.default_rng(settings.seed)
        self.a = random.integers(0, MASK, settings.hashes, np.uint64, endpoint=True) | np.uint64(1)
        self.b = random.integers(0, MASK, settings.hashes, np.uint64, endpoint=True)
        odd = random.integers(0, MASK, settings.words + 1, np.uint64, endpoint=True) | np.uint64(1)
        self.place, self.salt = odd[:-1], odd[-1]
        self.mix = random.integers(0, MASK, settings.rows, np.uint64, endpoint=True) | np.uint64(1)
        self.band = mixed(np.arange(1, settings.hashes // settings.rows + 1, dtype=np.uint64))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct shingles of every text, as 64-bit hashes."""
        words = [(text or "").encode().lower().split() for text in texts]
        memo = self.memo.of([word for found in words for word in found])
        return [self.shingles(np.array([memo[w] for w in found], np.uint64)) for found in words]

    def shingles(self, words: np.ndarray) -> np.ndarray:
        size = self.settings.words
        if not len(words):
            return words
        if len(words) < size:  # the whole sequence as one
            whole = np.append(words, np.uint64(len(words))) * np.append(self.place[: len(words)], self.salt)
            return mixed(whole.sum(dtype=np.uint64, keepdims=True))
        count = len(words) - size + 1
        total = np.zeros(count, np.uint64)
        for at in range(size):
            total += words[at : at + count] * self.place[at]
        return np.unique(mixed(total))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """The least value of each universal hash (a x + b mod 2**64, high half) over a set."""
        least = np.full(self.settings.hashes, MASK, np.uint64)
        for at in range(0, len(shingles), 1024):
            block = np.multiply.outer(shingles[at : at + 1024], self.a)
            block += self.b
            np.minimum(least, block.min(axis=0), out=least)
        return least >> np.uint64(32)

    def bands(self, minima: np.ndarray) -> np.ndarray:
        joint = (minima.reshape(-1, self.settings.rows) * self.mix).sum(axis=1, dtype=np.uint64)
        return mixed(joint + self.band).view(np.int64)

    def signature(self, minima: np.ndarray) -> np.ndarray:
        """The lowest bit of every minimum, 64 in a word."""
        return np.packbits((minima & np.uint64(1)).astype(np.uint8)).view(np.int64)


def hasher(settings: Settings) -> Hasher:
    """The hasher of settings, kept by the Python worker."""
    return held(("minhash", settings), lambda: Hasher(settings))


def _signed(docs: DataFrame, settings: Settings) -> DataFrame:
    """id, n_shingles, class (null without shingles), bands, signature words of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hasher(settings)
        for part in text_slices(batches):
            sets = own.sets(part.column(1).to_pylist())
            minima = [own.minima(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column(0),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "class": pa.array([_class(s) for s in sets], pa.binary()),
                    "bands": pa.array([None if m is None else own.bands(m) for m in minima], pa.list_(pa.int64())),
                    "bits": pa.array([None if m is None else own.signature(m) for m in minima], pa.list_(pa.int64())),
                }
            )

    return map_batches(docs, run, "id long, n_shingles long, class binary, bands array<long>, bits array<long>")


def classed(docs: DataFrame, settings: Settings, *, text_column: str = "text", out: str = "class") -> DataFrame:
    """Adds the class of every row's text, null without shingles: equal sets have equal classes."""
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    at = docs.columns.index(text_column)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hasher(settings)
        for part in text_slices(batches, f"c{at}"):
            found = [_class(s) for s in own.sets(part.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*names, "out"])

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)]).add("out", "binary")
    return map_batches(docs.toDF(*names), run, schema).toDF(*docs.columns, out)


def _class(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _numbers(named: DataFrame) -> DataFrame:
    """A number for each (id, class), in that order: partitions are ranges, and their numbers ascend.

    Write it before use; another run may number anew.
    """
    pairs = named.select("id", "class").distinct().repartitionByRange("id", "class")
    return pairs.sortWithinPartitions("id", "class").withColumn("number", F.monotonically_increasing_id())


def _differing(left: Column, right: Column, words: int) -> Column:
    return sum((F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i)))) for i in range(words)), F.lit(0))


def _similarities(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, common, total) of pairs (a, b), from the full sets of (id, text).

    Members come to their leader's task with their texts; the leader's text goes to
    as many tasks as its members fill.
    """
    counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / STAR).cast("int")
    leaders = counted.select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    split = pairs.join(counted, "a").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    wanted = split.union(leaders.select("a", F.col("a").alias("b"), "part"))
    rows = wanted.join(texts.select(F.col("id").alias("b"), "text"), "b")
    # A leader's own row is the first of its part.
    rows = rows.select("a", "part", (F.col("a") != F.col("b")).alias("member"), "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hasher(settings)
        key, lead = None, np.zeros(0, np.uint64)
        for slice_ in text_slices(batches):
            out: list[tuple[int, int, int, int]] = []
            sets = own.sets(slice_.column(4).to_pylist())
            for a, part, member, b, found in zip(*(slice_.column(i).to_pylist() for i in range(4)), sets, strict=True):
                if not member:
                    key, lead = (a, part), found
                    continue
                if key != (a, part):
                    raise ValueError(f"the text of {a} is missing")
                common = len(np.intersect1d(lead, found, assume_unique=True))
                out.append((a, b, common, len(lead) + len(found) - common))
            columns = [*zip(*out)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "common", "total"])

    return map_batches(rows, run, "a long, b long, common long, total long")


def near_duplicates(
    docs: DataFrame,
    settings: Settings = Settings(),
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    by_text: bool = False,
) -> DataFrame:
    """Groups of documents linked by the similarity of their shingle sets.

    Words are what stands between the ASCII spaces 0x20 and 0x09 to 0x0D, A-Z as a-z.
    Two documents are linked if 100 * common >= percent * total shingles. Returns the
    id column (whole numbers), `n_shingles`, `component_id` (the least id reached by
    links) and `kept` (the id is its component's): one row for each row of `docs`;
    other columns are not read. A null or empty text has no shingles and is linked
    with nothing. A row without an id is linked with nothing, has no component and is
    not kept.

    Rows with one id are one document: what one of its texts is linked with, the
    others are too. With `by_text` each different set of an id is a document of its
    own, told by a further column, its `class` (see `classed`); `kept` then holds for
    the rows of one set only, those of the least id and, within it, the least class.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"))
    signed = scratch.table(_signed(texts, settings), "signed")
    named = signed.where(F.col("id").isNotNull() & F.col("class").isNotNull())
    spread = named.groupBy("id").agg(F.min("class").alias("least"), F.max("class").alias("most"))
    # Where an id has several sets, numbers stand for its sets instead of the id.
    several = not spread.where("least <> most").isEmpty()
    if several:
        numbers = scratch.table(_numbers(named), "numbers")
        named = named.join(numbers, ["id", "class"]).drop("id").withColumnRenamed("number", "id")
        texts = classed(texts, settings).join(numbers, ["id", "class"]).select(F.col("number").alias("id"), "text")
    classes = scratch.table(named.groupBy("class").agg(F.min("id").alias("lead")), "classes")
    links = _links(texts, named, classes, settings, scratch)
    if several and not by_text:
        led = numbers.join(classes, "class").select("id", "lead")
        first = led.groupBy("id").agg(F.min("lead").alias("a"))
        same = led.join(first, "id").select("a", F.col("lead").alias("b"))
        links = links.union(same)
    found = components(links, scratch)
    rows = signed.select("id", "n_shingles", "class").join(classes, "class", "left")
    rows = rows.join(found.withColumnRenamed("id", "lead"), "lead", "left")
    rows = rows.withColumn("found", F.coalesce("component", "lead")).drop("component", "lead")
    if several:
        of = numbers.select(F.col("number").alias("found"), F.col("id").alias("component_id"))
        rows = rows.join(numbers, ["id", "class"], "left").join(of, "found", "left")
    else:
        rows = rows.withColumns({"number": F.col("id"), "component_id": F.col("found")})
    rows = rows.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    own = F.coalesce(F.col("number") == F.col("found"), F.col("id").isNotNull()) if by_text else F.col("id") == F.col("component_id")
    kept = F.coalesce(own, F.lit(False)).alias("kept")
    out = rows.select(F.col("id").alias(id_column), "n_shingles", "component_id", kept, *["class"] * by_text)
    out = scratch.table(out, "result")
    scratch.drop("signed", "numbers", "classes", "leads", "stars", "pairs", "texts", "linked", "near", "outside", "wide", "more")
    return out


def _links(texts: DataFrame, named: DataFrame, classes: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """Links (a, b) between leaders of classes, enough for the same components as all links."""
    percent = settings.percent
    of_lead = (named["class"] == classes["class"]) & (named["id"] == classes["lead"])
    leads = scratch.table(named.join(classes, of_lead, "left_semi"), "leads")
    placed = leads.select(F.explode("bands").alias("bucket"), "id")
    least = placed.groupBy("bucket").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = placed.join(least, "bucket").where("id <> a").select("bucket", "a", F.col("id").alias("b"), "n")
    stars = scratch.table(stars, "stars")
    sketch = leads.groupBy("id").agg(F.min(F.struct("n_shingles", "bits")).alias("s"))

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and signatures leave possible."""
        left = sketch.select(F.col("id").alias("a"), F.col("s").alias("sa"))
        right = sketch.select(F.col("id").alias("b"), F.col("s").alias("sb"))
        both = pairs.join(left, "a").join(right, "b")
        sizes = F.col("sa.n_shingles"), F.col("sb.n_shingles")
        near = _differing(F.col("sa.bits"), F.col("sb.bits"), settings.hashes // 64) <= settings.most_different
        return both.where((F.least(*sizes) * 100 >= F.greatest(*sizes) * percent) & near).select("a", "b")

    pairs = scratch.table(likely(stars.select("a", "b").distinct()), "pairs")
    ids = stars.select("a").union(stars.select("b")).distinct().withColumnRenamed("a", "id")
    needed = texts.join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    needed = scratch.table(needed, "texts")
    linked = F.col("common") * 100 >= F.col("total") * percent
    near = scratch.table(_similarities(pairs, needed, settings), "near")
    links = near.where(linked).select("a", "b")

    # Buckets of three or more whose members are not one component yet: with the
    # component of the bucket's least id come all members outside it.
    found = scratch.table(components(links, scratch, "first"), "linked")
    wide = stars.where("n > 2").select("a", "b").distinct()
    wide = wide.join(found.select(F.col("id").alias("a"), F.col("component").alias("home")), "a", "left")
    wide = wide.join(found.select(F.col("id").alias("b"), F.col("component").alias("own")), "b", "left")
    wide = wide.select(F.coalesce("home", "a").alias("home"), "b", F.coalesce("own", "b").alias("own"))
    outside = wide.where("home <> own").select("home", F.col("b").alias("id")).distinct()
    outside = scratch.table(outside, "outside")
    homes = outside.select("home").distinct()
    inside = found.join(homes, F.col("component") == F.col("home"), "left_semi").select(F.col("component").alias("home"), "id")
    inside = inside.union(homes.select("home", F.col("home").alias("id"))).distinct()
    groups = outside.withColumn("outside", F.lit(True)).union(inside.withColumn("outside", F.lit(False)))
    return links.union(scratch.table(_group_links(groups, needed, settings, scratch), "more"))


def _group_links(groups: DataFrame, texts: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect what is linked in groups (home, id, outside).

    Members that are not `outside` are one component already. A group is compared in
    one task, a wide one part by part; tasks return spanning forests, never pairs.
    """
    counted = groups.groupBy("home").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") * 2 / STAR).cast("int")
    # Written, so that its size is known: while it is small, no row moves to its home for the join.
    wide = scratch.table(counted.where(F.col("n") > STAR).select("home", parts.alias("parts")), "wide")
    rows = groups.join(wide, "home", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda p: F.struct(F.least(p, F.col("part")).alias("i"), F.greatest(p, F.col("part")).alias("j")),
    )
    rows = rows.join(texts, "id").select("home", F.explode(meets).alias("ij"), "part", "outside", "id", "text")
    rows = rows.select("home", "ij.i", "ij.j", "part", "outside", "id", "text")
    rows = rows.repartition("home", "i", "j").sortWithinPartitions("home", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hasher(settings)
        key, held = None, []
        for slice_ in text_slices(batches):
            sets = own.sets(slice_.column(6).to_pylist())
            for *place, part, outside, id_, found in zip(*(slice_.column(i).to_pylist() for i in range(6)), sets, strict=True):
                if place != key:
                    yield _edges(held, key, settings.percent)
                    key, held = place, []
                held.append((part, outside, id_, found))
        yield _edges(held, key, settings.percent)

    return map_batches(rows, run, "a long, b long")


def _edges(rows: list[tuple[int, bool, int, np.ndarray]], key: list | None, percent: int) -> pa.RecordBatch:
    """A spanning forest of the links between two parts of a group, or within one."""
    out: list[tuple[int, int]] = []
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    if key is not None:
        home, i, j = key
        left = [r for r in rows if r[0] == i]
        right = left if i == j else [r for r in rows if r[0] == j]
        turns = [(left, right)] if i == j else [(left, right), (right, [r for r in left if not r[1]])]
        for queries, against in turns:
            queries = [r for r in queries if r[1]]
            if not queries or not against:
                continue
            sizes = np.array([len(r[3]) for r in against])
            owner = np.repeat(np.arange(len(against)), sizes)
            flat = np.concatenate([r[3] for r in against])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for _, _, id_, own in queries:
                first, last = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                count = last - first
                at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                common = np.bincount(owner[at], minlength=len(against))
                for k in np.flatnonzero(common * 100 >= (len(own) + sizes - common) * percent).tolist():
                    _, outside, other, _ = against[k]
                    x, y = top(id_), top(other if outside else home)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        out.append((id_, other))
    return pa.RecordBatch.from_arrays([pa.array([e[n] for e in out], pa.int64()) for n in (0, 1)], ["a", "b"])
