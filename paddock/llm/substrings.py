"""Substring dedup by relative Lempel-Ziv parsing.

The corpus is its own reference. Its windows of 35 words are dealt into blocks by their anchors
(`anchors`), so that every document meets every block that holds one of its anchors. A block is indexed by the hashes of its
windows, and the pieces of documents that fell into it are parsed against it: at each place the longest
factor that also stands elsewhere in the block is taken, otherwise one word is a literal. A factor of at
least 35 words is a duplicate span. The next factor starts with the first window that crosses the end of the
last one, so windows across factor boundaries are checked as well. Pieces that occur as a whole more than once
need no parse.

Rows: a null text has no words. Repeated rows (same id and text) are occurrences of each other, so they lose
what they share; ids otherwise name one text. A null id is an id. Empty tables give no rows; other columns
are ignored, and kept by `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.anchors import Found, Runs, Windows, cuts, identified, kept_units, repeated
from paddock.llm.common import Words, byte_kinds, chunks, flat, gram_hashes, mix, ragged, with_own_names

#: words are everything but white space of ASCII
IS_WORD = byte_kinds((0x09, 0x0D, 0), (0x20, 0x20, 0))
LENGTH = 35


def _word_units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, bounds, IS_WORD)
    return words.hashes, words.rows


def _cut(length: int):
    def values(data: np.ndarray, codes: np.ndarray, bounds: np.ndarray, runs: Found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A run is sent as the hashes of its windows."""
        hashes = gram_hashes(codes, length)
        return _key(hashes, runs.first, runs.count), runs.first, hashes

    return values


def _key(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Equal for runs of equal windows: its first and last window cover a run."""
    return mix(mix(hashes[first], hashes[first + count - 1]), count.astype(np.uint64))


def _parse(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of the runs of a block against the whole block."""
    offsets = runs.offsets
    key = _key(runs.values, offsets[:-1], runs.count)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    group = np.empty(len(key), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    # a run that came without places stands for several occurrences
    weight = np.where(runs.times == 0, 2, runs.times)
    total = np.bincount(group, weights=weight)
    whole = np.flatnonzero((total[group] > 1) & (runs.times > 0))
    of, start = runs.occurrences(whole)
    owner, first, end = [runs.owner[of]], [start], [start + runs.count[of]]

    # the reference block: every distinct run once, with the index of its windows
    distinct = np.unique(group, return_index=True)[1]
    base = offsets[:-1][distinct]
    sizes = runs.count[distinct]
    values = runs.values[ragged(base, sizes)]
    at = np.concatenate([[0], np.cumsum(sizes)])
    index = np.argsort(values, kind="stable")
    same = values[index][1:] == values[index][:-1]
    other = np.full(len(values), -1)
    other[index[1:][same]] = index[:-1][same]
    lead = np.flatnonzero(same)
    other[index[lead]] = index[lead + 1]
    stop = np.repeat(at[1:], sizes)
    for i in np.flatnonzero((total == 1)):
        a, b = int(at[i]), int(at[i + 1])
        if (other[a:b] < 0).all():
            continue
        run = distinct[i]
        begin = int(runs.occurrences(np.array([run]))[1][0])
        p = a
        while p < b:
            q = int(other[p])
            if q < 0:
                p += 1
                continue
            n, most = 1, min(b - p, int(stop[q]) - q)
            while n < most and values[p + n] == values[q + n]:
                n += 1
            owner.append(runs.owner[run : run + 1])
            first.append(np.array([begin + p - a]))
            end.append(np.array([begin + p - a + n]))
            p += n
    return np.concatenate(owner), np.concatenate(first), np.concatenate(end)


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, spans) of a table of doc_id and text."""
    w = Windows(_word_units, length, length // 2 + 1, within=True)
    return repeated(docs, w, _cut(length), "<u8", 0, _parse)


def report(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    own = identified(docs, id_col, text_col)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, bounds = flat(batch.column("text"))
            words = Words(data, bounds, IS_WORD)
            raw = data.tobytes()
            total, removed, digests = [], [], []
            for row, found in enumerate(batch.column("spans").to_pylist()):
                a, b = int(words.rows[row]), int(words.rows[row + 1])
                keep = kept_units(found, b - a)
                if keep is None:
                    kept = raw[bounds[row] : bounds[row + 1]].split()
                else:
                    which = a + np.flatnonzero(keep)
                    kept = [raw[s:e] for s, e in zip(words.starts[which].tolist(), words.ends[which].tolist(), strict=True)]
                total.append(b - a)
                removed.append(b - a - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = own.join(spans(own, length).hint("shuffle_hash"), "doc_id", "left").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns; the words of duplicate spans, each with the white space after it, go from the text."""
    names = docs.columns
    docs = with_own_names(docs, id_col, text_col)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    found = spans(identified(docs, "doc_id", "text"), length).select(F.col("doc_id").alias("_key"), F.col("spans").alias("_spans"))
    joined = docs.join(found.hint("shuffle_hash"), key == F.col("_key"), "left").drop("_key")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, bounds = flat(batch.column("text"))
            words = Words(data, bounds, IS_WORD)
            texts = batch.column("text").to_pylist()
            for row, found in enumerate(batch.column("_spans").to_pylist()):
                a, b = int(words.rows[row]), int(words.rows[row + 1])
                keep = kept_units(found, b - a)
                if keep is None:
                    continue
                raw, origin = data[bounds[row] : bounds[row + 1]].tobytes(), int(bounds[row])
                edge = np.append(words.starts[a:b], bounds[row + 1]) - origin
                texts[row] = (raw[: edge[0]] + b"".join(raw[edge[x] : edge[y]] for x, y in cuts(keep) if keep[x])).decode()
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns(["_spans"])

    return joined.mapInArrow(removed, docs.schema).toDF(*names)


#: the contract's result in DuckDB; windows are compared by a digest of their words
SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY h) > 1),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS i FROM r),
x AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
s AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""
