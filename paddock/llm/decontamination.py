"""Benchmark decontamination, with built-in functions only.

The windows of all benchmark items (n consecutive words, or a shorter item as a whole) are hashed and sent
to every task as a broadcast hash set in blocks of at most `BLOCK` windows; a larger benchmark is probed block
by block. Texts are cut into words once per block, every window of a text probes the set by its hash, and a
hit counts only if the words themselves are equal. Only hits and one row per text are shuffled.

Rows: a null or empty text has no words. Repeated rows (same id and text) give one result row; the same id
with different texts gives one row per text. A null id is an id. Items with a null id hit like others
(n_hit, contaminated, `clean`), but add nothing to n_items and items_sha256; the SQL counts them as one more in n_items. Empty tables give no rows or no hits.
Other columns of the inputs are ignored, and kept by `clean`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import with_own_names

# ASCII control characters, signs and (after lower-casing) nothing else separate words
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD = rf"[^{SEPARATORS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: windows in one broadcast; a window of ten words takes some 300 bytes there
BLOCK = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _window_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """For a table with `_words`: adds `_hashes`, the hashes of all windows of the first length, then of the
    second and so on. Hashes of 2, 4, 8 ... words are made from those of half as many."""
    size = F.size("_words")
    df = df.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    made = 1
    while 2 * made <= max(lengths):
        half = F.col(f"_h{made}")
        df = df.withColumn(f"_h{2 * made}", F.zip_with(half, F.slice(half, F.lit(made + 1), F.greatest(size, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
        made *= 2
    parts = []
    for n in lengths:
        powers = [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]
        out, done = F.col(f"_h{powers[0]}"), powers[0]
        for p in powers[1:]:
            out = F.zip_with(out, F.slice(F.col(f"_h{p}"), F.lit(done + 1), F.greatest(size, F.lit(0))), lambda a, b: F.xxhash64(a, b))
            done += p
        parts.append(F.slice(out, F.lit(1), F.greatest(size - n + 1, F.lit(0))))
    df = df.withColumn("_hashes", F.concat(*parts))
    return df.drop(*[c for c in df.columns if c.startswith("_h") and c != "_hashes"])


def _located(place: Column, size: Column, lengths: list[int]) -> tuple[Column, Column]:
    """First word and length of the window at a place of `_hashes`."""
    first, length = place, F.lit(lengths[0])
    before: Column = F.lit(0)
    for shorter, longer in zip(lengths[1:], lengths, strict=False):
        before = before + F.greatest(size - longer + 1, F.lit(0))
        first = F.when(place >= before, place - before).otherwise(first)
        length = F.when(place >= before, F.lit(shorter)).otherwise(length)
    return first, length


def windows(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int], int]:
    """Distinct windows (_hash, _window, _items) of all items, their lengths (at most n) and their number."""
    own = items.select(F.col(id_col).cast("string").alias("_item"), words(F.col(text_col)).alias("_words")).where(F.size("_words") > 0)
    own = own.withColumn("_length", F.least(F.size("_words"), F.lit(n)))
    lengths = sorted((r[0] for r in own.select("_length").distinct().collect()), reverse=True)
    if not lengths:
        return own, [], 0
    cut = F.transform(F.sequence(F.lit(1), F.size("_words") - F.col("_length") + 1), lambda i: F.slice("_words", i, F.col("_length")))
    distinct = own.select("_item", F.explode(cut).alias("_window")).groupBy("_window").agg(F.sort_array(F.collect_set("_item")).alias("_items"))
    # the hash of a window is the only window hash of its own words
    parts = [_window_hashes(distinct.where(F.size("_window") == k).withColumn("_words", F.col("_window")), [k]) for k in lengths]
    found = reduce(DataFrame.unionByName, [p.select(F.get("_hashes", F.lit(0)).alias("_hash"), "_window", "_items") for p in parts])
    return found, lengths, found.count()


def hits(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, spans (array of first and end word of each occurrence), items (sorted ids)."""
    found, lengths, count = windows(items, n)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("_words"))
    if not lengths:
        none = F.array().cast("array<struct<b:bigint,e:bigint>>")
        return base.select("doc_id", "text_hash", F.size("_words").cast("long").alias("n_words"), none.alias("spans"), F.array().cast("array<string>").alias("items")).distinct()
    probe = _window_hashes(base, lengths).select("doc_id", "text_hash", "_words", F.size("_words").alias("_size"), F.posexplode_outer("_hashes").alias("_place", "_hash"))
    first, length = _located(F.col("_place"), F.col("_size"), lengths)
    blocks = -(-count // BLOCK)
    parts = []
    for block in range(blocks):
        some = found if blocks == 1 else found.where(F.pmod("_hash", F.lit(blocks)) == block)
        some = F.broadcast(some.withColumnRenamed("_hash", "_wanted"))
        equal = (F.col("_hash") == F.col("_wanted")) & (F.slice("_words", first + 1, length) == F.col("_window"))
        joined = probe.join(some, equal, "left").where(F.col("_window").isNotNull() | F.col("_place").isNull() | (F.col("_place") == 0))
        span = F.when(F.col("_window").isNotNull(), F.struct(first.cast("long").alias("b"), (first + length).cast("long").alias("e")))
        parts.append(joined.select("doc_id", "text_hash", "_size", span.alias("_span"), "_items"))
    together = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "text_hash")
    return together.agg(
        F.max("_size").cast("long").alias("n_words"),
        F.array_sort(F.collect_set("_span")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"),
    )


def covered(spans: Column) -> Column:
    """Number of places inside any of the sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def step(acc: Column, span: Column) -> Column:
        fresh = F.greatest(span["e"] - F.greatest(span["b"], acc["to"]), F.lit(0).cast("long"))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["to"], span["e"]).alias("to"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def report(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return hits(docs, items, n).select(
        "doc_id",
        "n_words",
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, n: int = 10, spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any hit; with `spans` all documents, and the words that are hit go from their
    texts together with the separators that follow them. All columns stay."""
    names = docs.columns
    docs = with_own_names(docs, id_col, text_col)
    found = hits(docs, items, n).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text_hash"), F.col("spans").alias("_spans"))
    same = docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_text_hash"])
    if not spans:
        return docs.join(found.hint("shuffle_hash"), same, "left_anti").toDF(*names)
    lead = F.regexp_extract("text", rf"^[{SEPARATORS}&&[^A-Z]]*", 0)
    units = F.regexp_extract_all(F.substring("text", F.length(lead) + 1, F.length("text")), F.lit(rf"(?:[^{SEPARATORS}]|[A-Z])+[{SEPARATORS}&&[^A-Z]]*"), F.lit(0))
    kept = F.filter(units, lambda _, i: ~F.exists("_spans", lambda s: (i >= s["b"]) & (i < s["e"])))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(kept, "")))
    return docs.join(found.hint("shuffle_hash"), same, "left").withColumn("text", text).select(*docs.columns).toDF(*names)


_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_CLASS}') END AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_CLASS}') AS w FROM benchmark WHERE text IS NOT NULL)
  WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS p FROM i)),
dw AS (
  SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, p, dw.n, item FROM dw JOIN bw USING (k) WHERE dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p + q) AS n_hit FROM (SELECT DISTINCT doc_id, p, unnest(generate_series(0, n - 1)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
