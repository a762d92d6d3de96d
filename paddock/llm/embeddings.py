"""Near duplicates among embeddings with an inverted multi-index.

Vectors are brought to length one and cut into halves. Each half has a codebook of its own, made by k-means on a
bounded sample; a cell is a pair of centroids, one of each codebook. Every vector is put into its cell. The cells
that a vector visits come from a multi-sequence traversal: pairs of centroids in the order of the sum of
the squared distances of the halves. Every vector goes `beyond` the distance of its own cell, and up to a common
reach at least. Half the squared distance at the threshold is the least value of `beyond`, on every table; the
sample raises it, where each vector with links outside its cell counts once, by the farthest of them, so that a large group of near
copies, all in or beside one cell, does not outvote the others. The reach is set on linked pairs. All vectors of the visited cells are compared by their
cosine in double precision, so no pair below the threshold is linked.

Equal vectors stand in the index once, with their number. Vectors of one cell are dealt into blocks of at most
some `BLOCK` rows. Visitors are packed by cell where they are read, dealt over copies of the blocks where a cell has many
of them, and shuffled once, to the blocks; a pair is counted by each side that visits
the other, and by the visiting side alone for both where only one does. Blocks return counts and, in place of all
links, edges that connect the same vectors.

Rows: vectors that are null, of length zero, or with null or non-finite components link with nothing, and so do
vectors whose number of components differs. Repeated rows (same id) count as one vector. Rows with a null id are told apart by
their vectors, one result row for each; a null id counts as smaller than any number, so a component with one has a
null id, and keeps the first of its null-id rows by a hash of their vectors. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import numbers, partitions, ragged, saved
from paddock.llm.components import components

COSINE = 0.9
#: vectors that codebooks and reach are fitted on, at most, and the target recall
SAMPLE, RECALL = 8_000, 0.998
#: vectors in a block of a cell, and in a block of its visitors
BLOCK = 512
#: vectors whose visits are packed at once, and visits of a cell for each copy of its blocks
PACK, VISITORS = 2_000, 4_096


@dataclass(frozen=True)
class Index:
    """Codebooks of both halves and the reach of the traversal."""

    first: np.ndarray
    second: np.ndarray
    reach: float
    beyond: float = 0.0

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves to the centroids."""
        cut = self.first.shape[1]
        return _distances(vectors[:, :cut], self.first), _distances(vectors[:, cut:], self.second)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self.halves(vectors)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def limits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far each vector goes, from the distances of its halves."""
        return np.maximum(self.reach, a.min(1) + b.min(1) + self.beyond)

    def links_visits(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) of the visits that links are looked for in."""
        return self.visits(vectors, self.limits(*self.halves(vectors)))

    def visits(self, vectors: np.ndarray, limits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) of all visits. Both lists of centroids are sorted by distance; the traversal goes along
        the sums in ascending order, and stops beyond the limits, or else the reach. The own cell is always visited."""
        a, b = self.halves(vectors)
        by_a, by_b = a.argsort(1), b.argsort(1)
        a, b = np.take_along_axis(a, by_a, 1), np.take_along_axis(b, by_b, 1)
        limit = np.maximum(self.reach if limits is None else limits, a[:, 0] + b[:, 0])
        at, cell = [], []
        for i in range(a.shape[1]):
            rows = np.flatnonzero(a[:, i] + b[:, 0] <= limit)
            if len(rows) == 0:
                break
            # in column i the sums ascend, so the visited ones are a prefix
            n = (a[rows, i][:, None] + b[rows] <= limit[rows][:, None]).sum(1)
            who = np.repeat(rows, n)
            j = ragged(np.zeros(len(n), np.int64), n)
            at.append(who)
            cell.append(by_a[who, i] * b.shape[1] + by_b[who, j])
        return np.concatenate(at), np.concatenate(cell)

    def visited(self, vectors: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Does each vector visit the cell beside it?"""
        a, b = self.halves(vectors)
        rows = np.arange(len(vectors))
        limit = self.limits(a, b)
        return a[rows, cell // len(self.second)] + b[rows, cell % len(self.second)] <= limit


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)[None], 0)


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(5)
    x = np.unique(x, axis=0)
    centroids = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _distances(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centroids


def centroids_for(vectors: int) -> int:
    """Centroids of each half: the cells, their square, grow as the vectors do, up to what the sample can fit."""
    return min(SAMPLE // 8, max(16, math.isqrt(vectors) // 4))


def fit(sample: np.ndarray, cosine: float = COSINE, recall: float = RECALL, centroids: int = 16) -> Index:
    """Codebooks, and how far the traversal goes: the smallest reach at which the wanted share of the sample's linked
    pairs is visited, and how far beyond its own cell a vector must go to meet its links."""
    cut = (sample.shape[1] + 1) // 2
    index = Index(_k_means(sample[:, :cut], centroids), _k_means(sample[:, cut:], centroids), 0.0)
    a, b = index.halves(sample)
    i, j = a.argmin(1), b.argmin(1)
    own = a.min(1) + b.min(1)
    needed, farthest = [], np.zeros(len(sample))
    for at in range(0, len(sample), 1000):
        linked = sample[at : at + 1000] @ sample.T >= cosine
        linked[np.arange(len(linked)), at + np.arange(len(linked))] = False
        p, q = np.nonzero(linked)
        # a pair is found if either visits the other
        p = p + at
        one = a[p, i[q]] + b[p, j[q]]
        two = a[q, i[p]] + b[q, j[p]]
        needed.append(np.minimum(one, two))
        np.maximum.at(farthest, p, np.minimum(one - own[p], two - own[q]))
    needed = np.sort(np.concatenate(needed))
    reach = float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else 0.0
    outside = farthest[farthest > 0]
    beyond = float(np.quantile(outside, recall, method="higher")) if len(outside) else 0.0
    # half the squared distance at the threshold, however many links the sample has
    return Index(index.first, index.second, reach * 1.05, max(beyond * 1.05, 1 - cosine))


def _matrix(column: pa.Array) -> np.ndarray:
    """Fixed-size binary rows of doubles as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, row, unit): keys and vectors of length one, as bytes; unusable vectors are left out."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
            lengths = np.asarray([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
            edge = np.cumsum(lengths) - lengths
            keep, out = [], []
            for size in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == size)
                matrix = values[ragged(edge[rows], lengths[rows])].reshape(len(rows), size)
                with np.errstate(all="ignore"):
                    scale = np.abs(matrix).max(1)
                    matrix = matrix / scale[:, None]
                    matrix = matrix / np.sqrt((matrix**2).sum(1))[:, None]
                fine = np.isfinite(matrix).all(1)
                keep.append(rows[fine])
                out += [r.astype("<f8").tobytes() for r in matrix[fine]]
            if out:
                at = pa.array(np.concatenate(keep))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("row").take(at), pa.array(out, pa.binary())], names=["id", "row", "unit"])

    own = _keyed(vectors, id_col, vector_col, F.col(vector_col).cast("array<double>").alias("vector")).where("vector is not null")
    return own.mapInArrow(unit, "id long, row string, unit binary").dropDuplicates(["id", "row"])


def _keyed(vectors: DataFrame, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    """(id, row): row is empty, and tells rows with a null id apart by their vectors."""
    row = F.when(F.col(id_col).isNotNull(), "").otherwise(F.sha2(F.coalesce(F.col(vector_col).cast("string"), F.lit("")), 256))
    return vectors.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), *more)


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few edges that connect the same numbers as the given ones: each end with the smallest number reached."""
    label = {}

    def top(x: int) -> int:
        while label.get(x, x) != x:
            label[x] = label.get(label[x], label[x])
            x = label[x]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            label[max(x, y)] = min(x, y)
            label.setdefault(min(x, y), min(x, y))
    ends = np.unique(np.concatenate([left, right]))
    tops = np.array([top(int(x)) for x in ends], np.int64)
    return ends[ends != tops], tops[ends != tops]


_FOUND = "a long, b long, n long"


def _compare(index: Index, cosine: float):
    """Blocks of one size of vectors: rows (cell, visitors, units) x (cell, members, units)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, qn = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_copies"], "<i8")
                m, mn = np.frombuffer(row["m_ids"], "<i8"), np.frombuffer(row["m_copies"], "<i8")
                x = np.frombuffer(row["q_units"], "<f8").reshape(len(q), -1)
                y = np.frombuffer(row["m_units"], "<f8").reshape(len(m), -1)
                if x.shape[1] != y.shape[1]:
                    continue
                link = x @ y.T >= cosine
                link &= q[:, None] != m[None, :]
                p, r = np.nonzero(link)
                if len(p) == 0:
                    continue
                # members that do not visit the visitor's cell hear of the link here
                alone = ~index.visited(y[r], index.cells(x)[p])
                ids = np.concatenate([q[p], m[r[alone]]])
                copies = np.concatenate([mn[r], qn[p[alone]]])
                who, at = np.unique(ids, return_inverse=True)
                count = np.bincount(at, weights=copies).astype(np.int64)
                a, b = _forest(q[p], m[r])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([who, a])), pa.concat_arrays([pa.nulls(len(who), pa.int64()), pa.array(b, pa.int64())]), pa.array(np.concatenate([count, np.zeros(len(a), np.int64)]))],
                    names=["a", "b", "n"],
                )

    return compare


def _blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Gathers rows (cell, block, rep, copies, unit) into packed blocks, one task per bucket of cells."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("block", "ascending"), ("rep", "ascending")])
        cell, block = (table.column(c).to_numpy() for c in ("cell", "block"))
        rep, copies = numbers(table.column("rep").combine_chunks()), table.column("copies").to_numpy()
        unit = table.column("unit").to_pylist()
        change = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1])) + 1
        edge = np.concatenate([[0], change, [len(cell)]]).tolist()
        pairs = list(zip(edge[:-1], edge[1:], strict=True))
        return pa.table(
            {
                "cell": pa.array(cell[edge[:-1]]),
                "block": pa.array(block[edge[:-1]]),
                "m_ids": pa.array([rep[a:b].astype("<i8").tobytes() for a, b in pairs], pa.binary()),
                "m_copies": pa.array([copies[a:b].astype("<i8").tobytes() for a, b in pairs], pa.binary()),
                "m_units": pa.array([b"".join(unit[a:b]) for a, b in pairs], pa.binary()),
            }
        )

    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("cell", "block"), F.lit(blocks)))
    return bucketed.groupBy("bucket").applyInArrow(pack, "cell long, block long, m_ids binary, m_copies binary, m_units binary")


def links(units: DataFrame, index: Index, cosine: float) -> DataFrame:
    """(a, b, n) over distinct vectors of one length (rep, copies, unit): rows with a null b give a's links, n of
    them; the others connect a and b."""
    spark = units.sparkSession
    sent = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("cell", pa.array(sent.value.cells(_matrix(batch.column("unit"))), pa.int64()))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for start in range(0, batch.num_rows, PACK):
                some = batch.slice(start, PACK)
                matrix = _matrix(some.column("unit"))
                at, cell = sent.value.links_visits(matrix)
                by = cell.argsort(kind="stable")
                yield at[by], cell[by], some, matrix

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell, _, _ in visits(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.unique(cell, return_counts=True)], names=["cell", "n"])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, cell, some, matrix in visits(batches):
            rep, copies = numbers(some.column("rep")), numbers(some.column("copies"))
            edges = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            edge = np.unique(np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(edges[:-1], edges[1:], strict=True)] + [edges[-1:]])).tolist()
            pairs = list(zip(edge[:-1], edge[1:], strict=True))
            for k in range(0, len(pairs), 500):
                part = pairs[k : k + 500]
                packed = [pa.array([x[at[a:b]].astype(kind).tobytes() for a, b in part], pa.binary()) for x, kind in ((rep, "<i8"), (copies, "<i8"), (matrix, "<f8"))]
                yield pa.RecordBatch.from_arrays([pa.array(cell[[a for a, _ in part]], pa.int64()), *packed], names=["cell", "q_ids", "q_copies", "q_units"])

    members = units.mapInArrow(place, "rep long, copies long, unit binary, cell long")
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    crowd = units.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.ceil(F.sum("n") / VISITORS).alias("copies_of"))
    # at most one row per cell, and the number of cells is bounded by the sample
    cells = F.broadcast(saved(sizes.join(crowd, "cell"), "cells"))
    blocks = 4 * partitions(spark)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    right = _blocks(members.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), "parts")).drop("parts", "copies_of"), blocks)
    right = right.join(cells, "cell").withColumn("copy", upto("copies_of")).drop("parts", "copies_of")
    left = units.mapInArrow(packs, "cell long, q_ids binary, q_copies binary, q_units binary").join(cells, "cell")
    left = left.withColumn("copy", F.pmod(F.xxhash64("q_ids"), "copies_of")).withColumn("block", upto("parts")).drop("parts", "copies_of")
    return left.join(right, ["cell", "block", "copy"]).mapInArrow(_compare(index, cosine), _FOUND)


def report(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    units = saved(_usable(vectors, id_col, vector_col), "units")
    # a vector that only null ids have stands in the index under a hash of it
    rep = F.coalesce(F.min("id"), F.xxhash64("unit"))
    distinct = units.groupBy("unit").agg(rep.alias("rep"), F.count("*").alias("copies"), F.min(F.when(F.col("row") != "", F.col("row"))).alias("nameless"))
    distinct = saved(distinct.select("rep", "copies", "unit", "nameless"), "distinct")
    every = _keyed(vectors, id_col, vector_col).distinct()
    sizes = [r[0] for r in distinct.select(F.length("unit")).distinct().collect()]  # lengths of vectors
    found = None
    for size in sorted(sizes):
        same = distinct.where(F.length("unit") == size).drop("nameless")
        drawn = [r[0] for r in same.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("unit").collect()]  # SAMPLE vectors
        index = fit(np.frombuffer(b"".join(drawn), "<f8").reshape(len(drawn), -1), cosine, centroids=centroids_for(same.count()))
        part = links(same, index, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return every.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = saved(found, "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(found.where("b is not null").select("a", "b"))
    reps = distinct.join(counts, "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    reps = reps.select("unit", "nameless", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "rep").alias("label"))
    nameless = reps.where("nameless is not null").groupBy("label").agg(F.min("nameless").alias("nameless"))
    known = units.join(reps.drop("nameless"), "unit").join(nameless, "label", "left")
    known = known.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "n_links", "label", "nameless")
    out = every.join(known, every["id"].eqNullSafe(known["_id"]) & (every["row"] == known["_row"]), "left")
    component = F.when(F.col("label").isNull(), F.col("id")).when(F.col("nameless").isNull(), F.col("label"))
    kept = F.when(F.col("label").isNull(), True).when(F.col("nameless").isNull(), F.col("id") == F.col("label")).otherwise(F.col("row") == F.col("nameless"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
