"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is a bag of shingles of five words (lower-case A-Z; letters, digits and bytes beyond ASCII); the
weight of a shingle is its count times its inverse document frequency. Frequencies are counted over all
documents in 2^16 hashed slots, so that rare shingles weigh alike and only text that stands in about one
document of a hundred or more weighs less. `SAMPLES` consistent samples of a bag make `BANDS` keys. Documents
that share a key are candidates; a candidate pair is a link if its similarity, computed from both texts, is
`SIMILARITY` or more: the weighted Jaccard similarity, or the plain one of the shingle sets. Links make
classes, named by their smallest id.

A key may be shared by very many documents, so pairs are not listed. Documents with the same bag are one
class from the start and one of them stands for all. Each document is compared to two documents with which it
shares a key; then every pair that shares a key but no class yet is compared. Pairs inside a class need no
test, so no class is missed that all pairs would give.

Random numbers of the samples come from a table of 2^16 draws; which one a shingle gets, and 32 bits that tell
shingles with the same draw apart, come from its hash.

Rows: null, empty and other texts without words are classes of their own. A text of fewer than five words is
one shingle. Repeated rows (same id) are the same document. A null id counts as the smallest number.
Empty tables give no rows. Other columns stay in `distinct_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.anchors import identified
from paddock.llm.common import Words, byte_kinds, chunks, flat, give_back, gram_hashes, mix, numbers, partitions, ragged, saved, with_own_names
from paddock.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS_PER_BAND = 16, 4
SAMPLES = BANDS * ROWS_PER_BAND
#: hashed slots of document frequencies; draws of the sampling table
SLOTS = 2**16
DRAWS = 2**16
#: steps of the logarithm of a weight per unit; weights are rounded to them for sampling
STEPS = 4
#: documents that are compared to one document, or make a block that is compared to another, at once
GROUP = 256

_KINDS = byte_kinds((0x00, 0x2F, 0), (0x3A, 0x40, 0), (0x5B, 0x60, 0), (0x7B, 0x7F, 0))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bags(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of the shingles of a chunk of texts, in the order of row and shingle."""
    words = Words(_LOWER[data], bounds, _KINDS)
    sizes = np.diff(words.rows)
    row = np.repeat(np.arange(len(sizes)), sizes)
    grams = gram_hashes(words.hashes, SHINGLE)
    inside = row[: len(grams)] == row[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    rows, shingles = row[: len(grams)][inside], grams[inside]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        whole = [np.uint64(hash_of(words.hashes[words.rows[r] : words.rows[r + 1]])) for r in short]
        rows, shingles = np.concatenate([rows, short]), np.concatenate([shingles, np.array(whole, np.uint64)])
    order = np.lexsort((shingles, rows))
    rows, shingles = rows[order], shingles[order]
    if len(rows) == 0:
        return rows, shingles, np.zeros(0, np.int64)
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (shingles[1:] != shingles[:-1])])
    heads = np.flatnonzero(new)
    return rows[heads], shingles[heads], np.diff(np.append(heads, len(rows)))


def hash_of(values: np.ndarray) -> int:
    out = np.array([len(values)], np.uint64)
    for v in values:
        out = mix(out, np.array([v], np.uint64))
    return int(out[0])


def slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(48)).astype(np.int64)


def inverse_frequencies(own: DataFrame) -> np.ndarray:
    """ln(1 + documents / documents in the slot), for each slot; own: doc_id, text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in chunks(batches, "text"):
            _, shingles, _ = bags(*flat(batch.column("text")))
            total[:SLOTS] += np.bincount(slot(shingles), minlength=SLOTS)
            total[SLOTS] += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["slot", "n"])

    out = np.zeros(SLOTS + 1)
    for at, n in own.mapInArrow(counted, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():  # SLOTS + 1 rows
        out[at] = n
    return np.log1p(out[SLOTS] / np.maximum(out[:SLOTS], 1))


@cache
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.gamma(2.0, 1.0, DRAWS), np.log(rng.gamma(2.0, 1.0, DRAWS)), rng.random(DRAWS)


@lru_cache(maxsize=64)
def _table(step: int) -> np.ndarray:
    """ln a of every draw for a weight of exp(step / STEPS), as an ordered number in the high 32 bits."""
    r, log_c, beta = _draws()
    t = np.floor(step / STEPS / r + beta)
    bits = (log_c - r * (t - beta + 1)).astype(np.float32).view(np.uint32)
    ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000))
    return ordered.astype(np.uint64) << np.uint64(32)


@lru_cache(maxsize=2)
def _tables(steps: tuple[int, ...]) -> np.ndarray:
    return np.concatenate([_table(step) for step in steps])


_MULTIPLIERS = np.random.default_rng(13).integers(0, 2**63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(rows: np.ndarray, shingles: np.ndarray, counts: np.ndarray, weight_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and their SAMPLES consistent samples."""
    step = np.rint(STEPS * np.log(counts * weight_of[slot(shingles)])).astype(np.int64)
    kinds, kind = np.unique(step, return_inverse=True)
    tables = _tables(tuple(kinds.tolist()))
    base = kind * DRAWS
    heads = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1])
    out = np.empty((len(heads), SAMPLES), np.uint64)
    for i, multiplier in enumerate(_MULTIPLIERS):
        mixed = shingles * multiplier
        value = tables[base + (mixed >> np.uint64(48)).astype(np.int64)]
        value |= (mixed >> np.uint64(16)) & np.uint64(0xFFFFFFFF)
        out[:, i] = np.minimum.reduceat(value, heads)
    return rows[heads], out


def _signed(own: DataFrame, weight_of: np.ndarray) -> DataFrame:
    """(doc_id, bag, keys): a digest of the bag and the keys of the bands; texts without words have neither."""
    sent = own.sparkSession.sparkContext.broadcast(weight_of)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows, shingles, counts = bags(*flat(batch.column("text")))
            if len(rows) == 0:
                continue
            which, samples = signatures(rows, shingles, counts, sent.value)
            heads = np.searchsorted(rows, which)
            digest = np.add.reduceat(mix(shingles, counts.astype(np.uint64)), heads)
            digest = mix(digest, np.diff(np.append(heads, len(rows))).astype(np.uint64))
            keys = []
            for band in range(BANDS):
                key = np.full(len(which), band, np.uint64)
                for i in range(ROWS_PER_BAND):
                    key = mix(key, samples[:, band * ROWS_PER_BAND + i])
                keys.append(key.view(np.int64))
            flat_keys = np.stack(keys, 1).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers(batch.column("doc_id"))[which]),
                    pa.array(digest.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat_keys) + 1, BANDS), pa.int32()), pa.array(flat_keys)),
                ],
                names=["doc_id", "bag", "keys"],
            )

    return own.mapInArrow(sign, "doc_id long, bag long, keys array<long>")


class Bags:
    """The bags of a table of texts, to compare one with many."""

    def __init__(self, column: pa.ChunkedArray, weight_of: np.ndarray) -> None:
        rows, self.shingles, self.counts = bags(*flat(column))
        self.edge = np.searchsorted(rows, np.arange(len(column) + 1))
        self.weight = weight_of[slot(self.shingles)]
        self.sizes = np.diff(self.edge)
        self.totals = np.bincount(rows, weights=self.counts * self.weight, minlength=len(column))

    def similarity(self, one: int, many: np.ndarray) -> np.ndarray:
        """The larger of weighted and plain Jaccard similarity of one bag with each of many."""
        own = slice(self.edge[one], self.edge[one + 1])
        mine, counts = self.shingles[own], self.counts[own]
        if len(mine) == 0:
            return np.zeros(len(many))
        at = ragged(self.edge[many], self.sizes[many])
        of = np.repeat(np.arange(len(many)), self.sizes[many])
        theirs = self.shingles[at]
        place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        hit = np.flatnonzero(mine[place] == theirs)
        common = np.bincount(of[hit], minlength=len(many))
        shared = np.bincount(of[hit], weights=np.minimum(self.counts[at[hit]], counts[place[hit]]) * self.weight[at[hit]], minlength=len(many))
        plain = common / (self.sizes[one] + self.sizes[many] - common)
        return np.maximum(plain, shared / (self.totals[one] + self.totals[many] - shared))


def _linked(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "linked": pa.array(linked, pa.bool_())})


def _with_one(pairs: DataFrame, texts: DataFrame, weight_of: np.ndarray, similarity: float) -> DataFrame:
    """(a, b, linked) of pairs (a, b). All b of an a meet in groups of at most some GROUP rows, each with one
    copy of the text of a."""
    spark = pairs.sparkSession
    sent = spark.sparkContext.broadcast((weight_of, similarity))
    sizes = pairs.groupBy("a").count()
    salted = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / GROUP)).cast("int"))
    salted = saved(salted.select("a", "b", "part"), "pairs")
    bucket = F.pmod(F.xxhash64("a", "part"), F.lit(4 * partitions(spark))).alias("bucket")
    members = salted.join(texts, salted["b"] == texts["doc_id"]).select(bucket, "a", "b", "part", "text")
    leaders = salted.select("a", "part").distinct().join(texts, F.col("a") == F.col("doc_id")).select(bucket, "a", F.lit(None).cast("long").alias("b"), "part", "text")

    def verify(table: pa.Table) -> pa.Table:
        give_back()
        weights, least = sent.value
        table = table.sort_by([("a", "ascending"), ("part", "ascending"), ("b", "ascending")])
        a, part = numbers(table.column("a").combine_chunks()), table.column("part").to_numpy()
        b = numbers(table.column("b").combine_chunks())
        leads = table.column("b").is_null().to_numpy()
        have = Bags(table.column("text"), weights)
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])])
        edge = np.append(np.flatnonzero(new), len(a))
        found = []
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            group = np.arange(x, y)
            rest = group[~leads[x:y]]
            found.append((a[rest], b[rest], have.similarity(int(group[leads[x:y]][0]), rest) >= least))
        return _linked(*(np.concatenate([f[i] for f in found]) for i in range(3)))

    return saved(members.unionByName(leaders).groupBy("bucket").applyInArrow(verify, "a long, b long, linked boolean"), "verified")


def _with_all(rows: DataFrame, texts: DataFrame, weight_of: np.ndarray, similarity: float) -> DataFrame:
    """(a, b, linked) of the links among documents (key, id, label) that share a key but not a label. The documents of
    a key are dealt into blocks of at most some GROUP, and every two blocks meet once. A pair with several common
    keys is compared under the first."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((weight_of, similarity))
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "id", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    bucket = F.pmod(F.xxhash64("key", "low", "high"), F.lit(4 * partitions(spark))).alias("bucket")
    dealt = dealt.join(texts, dealt["id"] == texts["doc_id"]).select(bucket, "key", "id", "label", "block", "low", "high", "keys", "text")

    def verify(table: pa.Table) -> pa.Table:
        give_back()
        weights, least = sent.value
        table = table.sort_by([("key", "ascending"), ("low", "ascending"), ("high", "ascending"), ("id", "ascending")])
        key, doc, label, block, low, high = (table.column(c).to_numpy() for c in ("key", "id", "label", "block", "low", "high"))
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(key), BANDS)
        have = Bags(table.column("text"), weights)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        edge = np.append(np.flatnonzero(new), len(key))
        found = [(doc[:0], doc[:0])]
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            if label[x:y].min() == label[x:y].max():
                continue
            for one in range(x, y):
                # within a block each pair once, between two blocks from the first
                ahead = np.arange(one + 1, y) if low[x] == high[x] else x + np.flatnonzero(block[x:y] == high[x]) if block[one] == low[x] else np.zeros(0, np.int64)
                ahead = ahead[label[ahead] != label[one]]
                same = keys[ahead] == keys[one]
                ahead = ahead[keys[one][same.argmax(1)] == key[x]]
                if len(ahead):
                    near = ahead[have.similarity(one, ahead) >= least]
                    found.append((np.full(len(near), doc[one]), doc[near]))
        a, b = (np.concatenate([f[i] for f in found]) for i in range(2))
        return _linked(a, b, np.ones(len(a), bool))

    return saved(dealt.groupBy("bucket").applyInArrow(verify, "a long, b long, linked boolean"), "verified")


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) of all documents, one row per id; class_id is the smallest id of the class."""
    own = identified(docs, id_col, text_col)
    weight_of = inverse_frequencies(own)
    signed = saved(_signed(own, weight_of), "signed")
    same = saved(signed.groupBy("bag").agg(F.min("doc_id").alias("rep")), "same")
    member_of = signed.select("doc_id", "bag").join(same, "bag").select("doc_id", "rep")

    reps = signed.join(same.select(F.col("rep").alias("doc_id"), "bag"), ["doc_id", "bag"], "left_semi").dropDuplicates(["doc_id"])
    keyed = reps.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
    several = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    held = saved(keyed.join(several.select("key"), "key"), "keyed")  # keys of two representatives or more
    some = reps.select("doc_id", "keys").join(held.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = saved(own.join(some.hint("shuffle_hash"), "doc_id").dropDuplicates(["doc_id"]), "texts")

    # first every document against two others, one of the smallest ids and one of a random order
    heads = held.groupBy("key").agg(F.min("id").alias("low"), F.min(F.struct(F.xxhash64(F.lit(1), "id").alias("order"), "id"))["id"].alias("drawn"))
    near = held.join(heads, "key").groupBy("id").agg(
        F.min(F.when(F.col("low") != F.col("id"), F.col("low"))).alias("low"),
        F.min(F.when(F.col("drawn") != F.col("id"), F.struct(F.xxhash64(F.lit(1), "drawn").alias("order"), "drawn")))["drawn"].alias("drawn"),
    )
    near = near.select("id", F.explode(F.array_distinct(F.array_compact(F.array("low", "drawn")))).alias("other"))
    tested = _with_one(near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), texts, weight_of, similarity)
    labels = components(tested.where("linked").select("a", "b"))

    # then all pairs that share a key and no class yet
    rows = held.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    open_keys = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    rows = saved(rows.join(open_keys.select("key"), "key"), "open")
    rest = _with_all(rows, texts, weight_of, similarity)
    labels = components(tested.unionByName(rest).where("linked").select("a", "b"))
    joined = member_of.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("rep"))
    known = joined.groupBy("doc_id").agg(F.min("rep").alias("class_id"))
    every = own.select("doc_id").distinct()
    return every.join(known, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size, kept (the document that stays of its class)."""
    found = saved(classes(docs, similarity), "classes")
    sizes = found.groupBy("class_id").agg(F.count("*").alias("class_size"))
    out = found.join(sizes, "class_id")
    null = lambda c: F.when(F.col(c) != -(2**63), F.col(c)).alias(c)
    return out.select(null("doc_id"), null("class_id"), "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def distinct_documents(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the documents that stay, one per class, with all their columns."""
    names = docs.columns
    docs = with_own_names(docs, id_col, text_col)
    gone = classes(docs, similarity).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.join(gone.hint("shuffle_hash"), key == F.col("_gone"), "left_anti").toDF(*names)
