"""Ranked lexical search: the documents of greatest inner product with a query, by ball trees.

A document is a sparse vector of saturated term frequencies, a query one of term weights;
both are scaled by the square root of the weights, so that common terms hardly widen a
ball. Each task builds trees of balls over some thousand documents. A node has the
centroid of its documents and, for each band of terms, the radius of a ball around it
that holds them all. No document of a node scores above

    centroid . query + sum over bands of radius * |query within the band|,

where of the query only those terms count that the node's documents hold, computed with
an allowance for rounding. One ball over all terms would be a bound too, but one that
prunes nothing: it lets the whole distance lie in the few terms of the query. A search
goes down the nodes of highest bound first and stops where the bound is below the worst
of the best scores so far. Scores at the leaves are whole numbers, exact. Best scores
are carried from tree to tree of a task; the best of all tasks are ranked by Spark.

Queries come in blocks of bounded size, each a pass over all documents, of which only the
block's terms are kept.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsquant.llm.arrow import map_batches, text_slices
from tsquant.llm.scratch import Scratch
from tsquant.llm.words import Words, split_words, text_bytes

#: Terms of the queries of a block, about; a query is never cut.
BLOCK_TERMS = 100_000
#: Documents of a tree, its stored terms, and documents of a leaf.
TREE_ROWS, TREE_TERMS, LEAF_ROWS = 4096, 2_000_000, 16
#: Terms whose ball is one, and the bands of the others.
COMMON_TERMS, BANDS = 32, 128
#: Relative allowance for rounding: sums of up to a million products of doubles err by
#: less than a million times 2^-53, which is 1.2e-10.
ROUNDING = 1e-9

#: Fixed by the contract: saturation and length normalisation of a term frequency.
UNIT, TF_UNIT, LENGTH_UNIT, LENGTH_PERCENT = 1_000_000_000, 1000, 12, 25

#: Letters and digits of ASCII and all bytes of other characters stay, A-Z in lower case.
FOLDED = np.array(
    [b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8
)


def split_terms(texts: pa.Array) -> Words:
    """Terms of texts: maximal runs of ASCII letters, digits and characters beyond ASCII."""
    data, starts = text_bytes(texts)
    folded = pa.py_buffer(FOLDED[data])
    return split_words(pa.StringArray.from_buffers(len(texts), pa.py_buffer(starts.astype(np.int32)), folded))


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def saturated(tf: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The value of a term that occurs tf times in a document of `length` terms."""
    m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * length * documents) // total
    return (UNIT * tf) // (TF_UNIT * tf + LENGTH_UNIT * m)


def counted_terms(docs: DataFrame, terms: list[str], id_column: str, text_column: str) -> DataFrame:
    """Of each document its id, its number of terms `n`, and which of the given terms it holds
    how often: `held` (places in the list) and `tf`."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for part in text_slices(batches):
            words = split_terms(part.column(1))
            place = pc.fill_null(pc.index_in(words.spelled, value_set=known), -1).to_numpy().astype(np.int64)
            place = place[words.codes] if len(words.codes) else np.zeros(0, np.int64)
            owners = np.repeat(np.arange(part.num_rows), np.diff(words.starts))
            wanted = place >= 0
            keys, tf = np.unique(owners[wanted] * len(terms) + place[wanted], return_counts=True)
            sizes = np.bincount(keys // max(1, len(terms)), minlength=part.num_rows)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            held = pa.array(keys % max(1, len(terms)), pa.int32())
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column(0),
                    "n": pa.array(np.diff(words.starts), pa.int64()),
                    "held": pa.ListArray.from_arrays(offsets, held),
                    "tf": pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64())),
                }
            )

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return map_batches(rows, run, f"id {kind}, n long, held array<int>, tf array<long>")


class Vectors:
    """Sparse rows: `columns` and `values` (whole numbers) on end, row i from `starts[i]`."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, scaled: np.ndarray):
        self.starts, self.columns, self.values, self.scaled = starts, columns, values, scaled

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> Vectors:
        sizes = self.starts[rows + 1] - self.starts[rows]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(starts[-1]) + np.repeat(self.starts[rows] - starts[:-1], sizes)
        return Vectors(starts, self.columns[at], self.values[at], self.scaled[at])

    def dense(self, row: int, size: int) -> np.ndarray:
        out = np.zeros(size)
        here = slice(self.starts[row], self.starts[row + 1])
        out[self.columns[here]] = self.scaled[here]
        return out

    def products(self, dense: np.ndarray) -> np.ndarray:
        """Of every row with a dense vector in the scaled space; no row is empty."""
        return np.add.reduceat(self.scaled * dense[self.columns], self.starts[:-1])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Exact products with whole weights."""
        return np.add.reduceat(self.values * weights[self.columns], self.starts[:-1])


def bands_of(weights: np.ndarray, common: int = COMMON_TERMS, bands: int = BANDS) -> np.ndarray:
    """The band of each term: the commonest ones share the first, the others are dealt out."""
    order = np.empty(len(weights), np.int64)
    order[np.argsort(weights, kind="stable")] = np.arange(len(weights))
    return np.where(order < common, 0, 1 + order % bands)


class BallTree:
    """Balls over rows: `centroids` and `radii` (one for each band of terms) by node; `below[i]`
    has the two nodes below node i, or the rows of a leaf and their places in the tree's
    input."""

    def __init__(self, rows: Vectors, bands: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.bands, count, dimensions = bands, int(bands.max()) + 1, len(bands)
        self.below: list[tuple] = []
        centroids, radii = [], []
        waiting = [(rows, np.arange(len(rows)))]
        while waiting:
            own, places = waiting.pop(0)
            centroid = np.bincount(own.columns, weights=own.scaled, minlength=dimensions) / len(own)
            # Squares of the distances to the centroid, by row and band.
            cell = np.repeat(np.arange(len(own)) * count, np.diff(own.starts)) + bands[own.columns]
            middle = np.bincount(bands, weights=centroid**2, minlength=count)
            near = centroid[own.columns]
            apart = np.bincount(cell, weights=own.scaled * (own.scaled - 2 * near), minlength=len(own) * count)
            apart = apart.reshape(len(own), count) + middle
            # What cancels there may err by a part of what it is taken of.
            most = np.bincount(cell, weights=own.scaled**2, minlength=len(own) * count).reshape(len(own), count).max(axis=0)
            radii.append(np.sqrt(np.maximum(apart.max(axis=0), 0) + ROUNDING * (most + 2 * middle)))
            centroids.append(centroid)
            if len(own) <= leaf_rows:
                self.below.append((own, places))
                continue
            # The row farthest from the centroid, and the one farthest from that, part the rest.
            squares = np.add.reduceat(own.scaled**2, own.starts[:-1])
            one = own.products(own.dense(int(apart.sum(axis=1).argmax()), dimensions))
            two = own.products(own.dense(int((squares - 2 * one).argmax()), dimensions))
            order = np.argsort(one - two, kind="stable")
            halves = np.sort(order[: len(own) // 2]), np.sort(order[len(own) // 2 :])
            first = len(self.below) + 1 + len(waiting)
            self.below.append((first, first + 1))
            waiting += [(own.take(half), places[half]) for half in halves]
        self.centroids, self.radii = np.array(centroids), np.array(radii)

    def bounds(self, columns: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Of every node, a score that none of its rows exceeds; `query` in the scaled space.

        Of the query only the terms count that some row of the node holds.
        """
        bands = self.bands[columns]
        order = np.argsort(bands, kind="stable")
        columns, query, bands = columns[order], query[order], bands[order]
        first = np.flatnonzero(np.concatenate(([True], bands[1:] != bands[:-1])))
        centre = self.centroids[:, columns]
        lengths = np.sqrt(np.add.reduceat((centre > 0) * query**2, first, axis=1))
        high = centre @ query + (lengths * self.radii[:, bands[first]]).sum(axis=1)
        return high * (1 + ROUNDING) + 1


class Best:
    """The highest scores of one query so far; equal ones by the lesser id, null last."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def least(self) -> int:
        """What a further score must reach."""
        return self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, found: list[tuple[int, object]]) -> None:
        self.rows = sorted([*self.rows, *found], key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))[: self.top]


class Search:
    """The queries of a block: of each its terms and their weights, whole and scaled."""

    def __init__(self, queries: list[dict[int, int]], weights: np.ndarray, top: int):
        self.weights = weights
        self.terms, self.exact = [], []
        for query in queries:
            terms = np.array(sorted(t for t in query if weights[t] > 0), np.int64)
            self.terms.append(terms)
            self.exact.append(np.array([query[t] for t in terms.tolist()], np.int64) * weights[terms])
        self.best = [Best(top) for _ in queries]
        #: Leaves that were scored, and all that there were, over queries and trees.
        self.visited = self.leaves = 0

    def over(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, ids: list) -> None:
        """Searches a tree of these rows, none of them empty."""
        seen, columns = np.unique(columns, return_inverse=True)
        root = np.sqrt(self.weights[seen].astype(float))
        tree = BallTree(Vectors(starts, columns, values, values * root[columns]), bands_of(self.weights[seen]))
        leaves = sum(isinstance(b[0], Vectors) for b in tree.below)
        dense = np.zeros(len(seen), np.int64)
        for terms, exact, best in zip(self.terms, self.exact, self.best):
            at = np.searchsorted(seen, terms)
            here = np.flatnonzero(seen[np.minimum(at, len(seen) - 1)] == terms)
            self.leaves += leaves
            if not len(here):
                continue
            at, exact = at[here], exact[here]
            bounds = tree.bounds(at, exact / root[at])
            dense[at] = exact
            waiting = [(-bounds[0], 0)]
            while waiting:
                bound, node = heapq.heappop(waiting)
                if -bound < best.least():
                    break
                one, two = tree.below[node]
                if isinstance(one, Vectors):
                    self.visited += 1
                    scores = one.scores(dense)
                    high = np.flatnonzero(scores >= best.least())
                    best.add([(int(scores[i]), ids[two[i]]) for i in high.tolist()])
                else:
                    heapq.heappush(waiting, (-bounds[one], one))
                    heapq.heappush(waiting, (-bounds[two], two))
            dense[at] = 0


def search(
    vectors: DataFrame, queries: dict[int, dict[int, int]], weights: np.ndarray, documents: int, total: int, top: int
) -> DataFrame:
    """The best documents of each task for each query, as (row, id, score); queries are by row."""
    kind = vectors.schema["id"].dataType.simpleString()
    needed = sorted({t for query in queries.values() for t in query})
    useful = np.zeros(len(weights), bool)
    useful[needed] = weights[needed] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Search(list(queries.values()), weights, top)
        held: list[pa.RecordBatch] = []

        def finish() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            sizes = pc.list_value_length(rows["held"]).to_numpy()
            columns = pc.list_flatten(rows["held"]).to_numpy().astype(np.int64)
            tf = pc.list_flatten(rows["tf"]).to_numpy()
            owners = np.repeat(np.arange(rows.num_rows), sizes)
            values = saturated(tf, rows["n"].to_numpy()[owners], documents, total)
            kept = useful[columns] & (values > 0)
            sizes = np.bincount(owners[kept], minlength=rows.num_rows)
            full = np.flatnonzero(sizes)
            if len(full):
                ids = rows["id"].take(pa.array(full)).to_pylist()
                own.over(np.concatenate(([0], np.cumsum(sizes[full]))), columns[kept], values[kept], ids)
            held.clear()

        n_rows = n_terms = 0
        for batch in batches:
            held.append(batch)
            n_rows += batch.num_rows
            n_terms += len(pc.list_flatten(batch.column(2)))
            if n_rows >= TREE_ROWS or n_terms >= TREE_TERMS:
                finish()
                n_rows = n_terms = 0
        if held:
            finish()
        found = [(row, doc, score) for row, best in zip(queries, own.best) for score, doc in best.rows]
        for start in range(0, len(found), 10_000):
            part = found[start : start + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in part], t) for i, t in enumerate((pa.int64(), batch.schema.field(0).type, pa.int64()))],
                ["row", "id", "score"],
            )

    return map_batches(vectors, run, f"row long, id {kind}, score long")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    *,
    top: int = 20,
    id_column: str = "doc_id",
    item_column: str = "item_id",
    text_column: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The `top` documents of highest score above 0 for each item: the item's id, `rank` (int,
    from 1), the document's id and `score` (long); equal scores by ascending id, null last.

    Every row of `items` is an item, also where ids repeat or are null, and every row
    of `docs` a document, so repeated rows take ranks of their own. Null, empty and
    term-less texts find nothing and are not found; an empty table gives no rows. Other
    columns of both tables are not read. Document ids are whole numbers or text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    rows = items.select(items[item_column].alias("item"), items[text_column].alias("text"))
    # Terms are no more than half of the characters, and one.
    size = rows.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_terms))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    numbered = numbered.withColumn("block", F.expr(f"pmod(xxhash64(row), {blocks})").cast("int"))
    numbered = scratch.table(numbered, "items")
    parts = []
    for block in range(blocks):
        asked = numbered.where(F.col("block") == block).select("row", "text").orderBy("row").collect()
        words = split_terms(pa.array([r["text"] for r in asked], pa.string()))
        terms = words.spelled.to_pylist()
        queries = {r["row"]: {} for r in asked}
        for at, query in enumerate(queries.values()):
            for code in words.codes[words.starts[at] : words.starts[at + 1]].tolist():
                query[code] = query.get(code, 0) + 1
        name = f"terms-{block}"
        vectors = scratch.table(counted_terms(docs, terms, id_column, text_column), name)
        facts = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        documents, total = facts[0], facts[1] or 1
        holding = vectors.select(F.explode("held").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(len(terms), np.int64)
        for term, count in holding:
            weights[term] = term_weight(documents, count)
        found = search(vectors.where(F.size("held") > 0), queries, weights, documents, total, top)
        parts.append(scratch.table(found, f"found-{block}"))
        scratch.drop(name)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(numbered.select("row", "item"), "row").select(
        F.col("item").alias(item_column), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_column), "score"
    )
