"""Near-duplicate vectors: learned binary codes, Hamming tables, exact cosines.

1. Equal vectors are one class, led by its least id; only leaders go on.
2. Iterative quantisation learns rotations of the centred, decorrelated space whose
   signs are balanced bits that lose little; each of several starts gives as many bits
   as the vectors have components.
3. The bits are cut into substrings, one table for each: vectors with an equal
   substring share a bucket. Substrings have log2 of the number of leaders bits, and
   there are as many tables as a pair at the threshold needs to be met with
   probability `recall`, as measured on pairs made from the sample: centring widens
   angles where vectors share a direction. Where that would take more than
   `MOST_TABLES`, substrings are shorter and buckets wider, down to one bucket that
   holds all pairs.
4. Buckets are compared block by block with the original vectors in double precision.
   A pair counts in the first table in which it meets, so no list of pairs exists:
   tasks return the number of links of each vector and a spanning forest of them.
5. Components by large and small stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsquant.llm.arrow import map_batches
from tsquant.llm.components import components
from tsquant.llm.scratch import Scratch

#: Vectors the rotations are learned from, at most; every vector is indexed.
SAMPLE = 20_000
#: Members of a bucket that one task compares with as many others.
BLOCK = 2048
ROUNDS = 30
#: Tables at most, since every vector goes to each.
MOST_TABLES = 96
#: Pairs of each kind that recall is measured on.
PAIRS = 4000


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by their largest component first, so no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Codes:
    """Rotations learned from a sample, and the substrings of the codes they give."""

    def __init__(self, sample: np.ndarray, bits: int, tables: int, seed: int = 1):
        random = np.random.default_rng(seed)
        unit = units(sample)
        self.mean = unit.mean(axis=0)
        centred = unit - self.mean
        size = centred.shape[1]
        _, _, axes = np.linalg.svd(centred, full_matrices=len(centred) < size)
        turned = centred @ axes.T
        turns = []
        for _ in range(math.ceil(bits * tables / size)):
            turn, _ = np.linalg.qr(random.normal(size=(size, size)))
            for _ in range(ROUNDS):
                signs = np.where(turned @ turn >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(turned.T @ signs)
                turn = left @ right
            turns.append(axes.T @ turn)
        # Bits of different rotations are mixed, so that substrings fail independently.
        order = random.permutation(size * len(turns))[: bits * tables]
        self.pool = np.concatenate(turns, axis=1)[:, order]
        self.cut(bits, tables)

    def cut(self, bits: int, tables: int) -> None:
        """Takes substrings of so many of the bits learned."""
        self.planes = self.pool[:, : bits * tables]
        self.bits, self.tables = bits, tables

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """One substring, as a whole number, for each vector and table."""
        unit = units(vectors)
        signs = (unit - self.mean) @ self.planes >= 0
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        return signs.reshape(len(vectors), self.tables, self.bits) @ weights


def tables_needed(bits: int, threshold: float, recall: float) -> int:
    """Tables in which a pair at the threshold meets at least once with the given probability.

    A random plane separates two vectors with probability angle / pi.
    """
    equal = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - equal)))


def pairs_at(sample: np.ndarray, threshold: float, count: int, seed: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors of the sample and others at the threshold: in any direction, and where the sample varies."""
    random = np.random.default_rng(seed)
    unit = units(sample)
    one, two, base = (unit[random.integers(len(unit), size=count)] for _ in range(3))
    out = []
    for away in (random.normal(size=base.shape), one - two):
        away = away - (away * base).sum(axis=1, keepdims=True) * base
        length = np.linalg.norm(away, axis=1)
        some = length > 1e-6
        if some.any():
            away = away[some] / length[some, None]
            out.append((base[some], threshold * base[some] + math.sqrt(max(0.0, 1 - threshold**2)) * away))
    return out


def codes_for(sample: np.ndarray, bits: int, threshold: float, recall: float) -> Codes:
    """Codes of `bits` or less in each table, whose tables let pairs at the threshold meet.

    With a `recall` of 1 all pairs are compared.
    """
    if recall >= 1:  # no code is sure: one bucket of all
        codes = Codes(sample, 1, 1)
        codes.cut(0, 1)
        return codes
    pairs = pairs_at(sample, threshold, PAIRS)

    def enough(codes: Codes, bits: int, most: int) -> int | None:
        """Least number of tables with which every kind of pair is met with probability `recall`."""
        needed = 1
        for a, b in pairs:
            equal = np.logical_not(np.logical_xor(*((v - codes.mean) @ codes.pool >= 0 for v in (a, b))))
            met = equal[:, : bits * most].reshape(len(a), most, bits).all(axis=2)
            reached = np.logical_or.accumulate(met, axis=1).mean(axis=0)
            if reached[-1] < recall:
                return None
            needed = max(needed, int((reached >= recall).argmax()) + 1)
        return needed

    tables = min(MOST_TABLES, tables_needed(bits, threshold, recall))
    codes = Codes(sample, bits, tables)
    if enough(codes, bits, tables):
        return codes
    codes = Codes(sample, bits, MOST_TABLES)
    for fewer in range(bits, 0, -1):
        tables = enough(codes, fewer, MOST_TABLES)
        if tables:
            codes.cut(fewer, tables)
            return codes
    codes.cut(0, 1)  # one bucket of all
    return codes


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of rows with one key, from batches sorted by key."""
    held: dict[str, np.ndarray] | None = None

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {}
        for name in batch.schema.names:
            column = batch.column(name)
            if pa.types.is_list(column.type):
                out[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            else:
                out[name] = column.to_numpy(zero_copy_only=False)
        return out

    for batch in rows:
        if not batch.num_rows:
            continue
        fresh = columns(batch)
        if held is not None:
            fresh = {k: np.concatenate([held[k], v]) for k, v in fresh.items()}
        keys = np.stack([fresh[k] for k in ("place", "key", "i", "j")], axis=1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts = [0, *edges.tolist()]
        for start, end in zip(starts, starts[1:]):
            if end - start > 1:
                yield {k: v[start:end] for k, v in fresh.items()}
        held = {k: v[starts[-1] :] for k, v in fresh.items()}
    if held is not None and len(held["key"]) > 1:
        yield held


def _compared(block: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and their weighted numbers of links within a block, and edges that connect them."""
    place, i, j = int(block["place"][0]), int(block["i"][0]), int(block["j"][0])
    left = np.flatnonzero(block["part"] == i)
    right = left if i == j else np.flatnonzero(block["part"] == j)
    unit = units(block["vector"].astype(np.float64))
    linked = unit[left] @ unit[right].T >= threshold
    codes, ids, many = block["codes"], block["id"], block["many"]
    for earlier in range(place):  # met there already
        linked &= codes[left, earlier][:, None] != codes[right, earlier][None, :]
    linked &= ids[left][:, None] != ids[right][None, :]
    a, b = np.nonzero(np.triu(linked, 1) if i == j else linked)
    if not len(a):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    counts = np.zeros(len(ids), np.int64)
    np.add.at(counts, left[a], many[right[b]])
    np.add.at(counts, right[b], many[left[a]])
    some = np.flatnonzero(counts)
    tree = _forest(left[a], right[b], len(ids))
    return ids[some], counts[some], ids[left[a[tree]]], ids[right[b[tree]]]


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> list[int]:
    """Places of edges that connect what all edges connect."""
    parent = list(range(size))
    out = []
    for at, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[y] = x
            out.append(at)
    return out


def near_vectors(
    vectors: DataFrame,
    *,
    threshold: float = 0.95,
    recall: float = 0.99,
    sample: int = SAMPLE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Direct links and components of vectors by cosine, in double precision.

    Returns the id column (whole numbers), `n_links` (other rows linked directly),
    `component_id` (the least id reached, the own included) and `kept` (the id is its
    component's): one row for each row of `vectors`; other columns are not read. A
    vector that is null, empty or zero, or holds a null or a non-finite component, is
    linked with nothing, and vectors of different lengths are not linked; vectors of
    each length are compared in turn. With a `recall` of 1 all pairs are. A row without an id is linked with nothing, has no component and is not
    kept; rows with one id are one node of the components, and not linked to each
    other unless their vectors are equal.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    value = vectors[vector_column].cast("array<double>")
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), value.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    # Two hashes of 64 bits name a class.
    named = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    good_rows = named.where("good")
    classes = good_rows.groupBy("h1", "h2").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("many"))
    classes = scratch.table(classes, "classes")
    leads = scratch.table(
        good_rows.join(classes, ["h1", "h2"]).where("id = lead").dropDuplicates(["h1", "h2"]).select("id", "many", "vector"),
        "leads",
    )
    result = named.select("id", "good", "h1", "h2")
    degrees = spark.createDataFrame([], "id long, links long")
    edges = spark.createDataFrame([], "a long, b long")
    sizes = leads.groupBy(F.size("vector").alias("size")).count().where("count > 1").orderBy("size").collect()
    for size, count in sizes:
        own = leads.where(F.size("vector") == size)
        bits = max(4, math.ceil(math.log2(count)))
        chosen = own.orderBy(F.xxhash64("id")).limit(sample) if count > sample else own
        codes = codes_for(np.array([r.vector for r in chosen.select("vector").toLocalIterator()]), bits, threshold, recall)
        codes.pool = codes.planes  # what tasks need
        more = _linked(own, codes, threshold, scratch, f"-{size}")
        degrees, edges = degrees.union(more[0]), edges.union(more[1])
    degrees = degrees.groupBy("id").agg(F.sum("links").alias("links"))
    found = components(edges, scratch)
    by_class = classes.join(degrees, classes["lead"] == degrees["id"], "left").drop("id")
    by_class = by_class.join(found, by_class["lead"] == found["id"], "left").drop("id")
    out = result.join(by_class, ["h1", "h2"], "left")
    links = F.when(F.col("good"), F.coalesce("links", F.lit(0)) + F.col("many") - 1).otherwise(F.lit(0))
    component = F.when(F.col("good"), F.coalesce("component", "lead")).otherwise(F.col("id"))
    out = out.select(
        F.col("id").alias(id_column), links.cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
    out = scratch.table(out, "result")
    scratch.drop("classes", "leads", *[f"{name}-{size}" for name in ("found", "wide") for size, _ in sizes])
    return out


def _linked(leads: DataFrame, codes: Codes, threshold: float, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(id, links) and edges (a, b) among (id, many, vector) of one length."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column(2)
            if batch.num_rows:
                found = codes.of(vector.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                ends = pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(found.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "many", "vector", "codes"])

    coded = map_batches(leads, code, "id long, many long, vector array<double>, codes array<long>")
    placed = coded.select("id", "many", "vector", "codes", F.posexplode("codes").alias("place", "key"))
    # A bucket beyond a block is compared part by part; parts are told by the id.
    wide = coded.select(F.posexplode("codes").alias("place", "key")).groupBy("place", "key").count()
    wide = wide.where(F.col("count") > BLOCK).select(
        "place", "key", F.ceil(F.col("count") / (BLOCK // 2)).cast("int").alias("parts")
    )
    # Written, so that its size is known: while it is small, no vector moves for the join.
    wide = scratch.table(wide, f"wide{name}")
    placed = placed.join(wide, ["place", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda p: F.struct(F.least(p, F.col("part")).alias("i"), F.greatest(p, F.col("part")).alias("j")),
    )
    pairs = placed.select("place", "key", "part", "id", "many", "vector", "codes", F.explode(others).alias("ij"))
    pairs = pairs.select("place", "key", "ij.i", "ij.j", "part", "id", "many", "vector", "codes")
    sorted_rows = pairs.repartition("place", "key", "i", "j").sortWithinPartitions("place", "key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            ids, links, a, b = _compared(block, threshold)
            if len(ids):
                nothing = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.nulls(len(ids), pa.int64())], ["x", "y", "z"])
                yield pa.RecordBatch.from_arrays([pa.array(a), nothing, pa.array(b)], ["x", "y", "z"])

    found = scratch.table(map_batches(sorted_rows, compare, "x long, y long, z long"), f"found{name}")
    degrees = found.where("y IS NOT NULL").groupBy(F.col("x").alias("id")).agg(F.sum("y").alias("links"))
    return degrees, found.where("z IS NOT NULL").select(F.col("x").alias("a"), F.col("z").alias("b")).distinct()
