"""Language identification by rank-order profiles.

A language profile is the list of its most frequent character n-grams (one to three characters, lower case,
everything but letters as one blank), in the order of their counts over a bounded sample of labelled texts. A
document is profiled alike, over the n-grams of all profiles, and compared to each language by the
out-of-place distance: the sum of the differences in rank, with the longest difference for an n-gram
that the language lacks. The nearest language is predicted.

Rows: texts that are null or have no letter are `und` with score 0, as is everything where no language was learned.
Equal distances go to the language that comes first in the alphabet. Repeated rows give repeated results, a null
id is an id. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.common import chunks

#: n-grams in a profile; labelled texts per language that are learned from, at most
PROFILE, SAMPLE_ROWS = 300, 2_000
LONGEST = 3
#: texts whose n-grams are counted at once
ROWS = 1_000


@cache
def _alphabet() -> np.ndarray:
    """For every code point the lower-case letter, or blank."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single blanks of all texts, each text followed by a 0; and the row of each."""
    lengths = np.array([len(t or "") for t in texts], np.int64)
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(texts)), lengths)
    kept = _alphabet()[points]
    blank = kept == 32
    again = np.zeros(len(kept), bool)
    again[1:] = blank[1:] & blank[:-1] & (row[1:] == row[:-1])
    kept, row = kept[~again], row[~again]
    ends = np.searchsorted(row, np.arange(len(texts)), side="right")
    return np.insert(kept, ends, 0), np.insert(row, ends, np.arange(len(texts)))


def grams(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (21 bits a character) inside a text that hold a letter, and where they begin."""
    size = max(len(points) - n + 1, 0)
    code = np.zeros(size, np.uint64)
    valid, letter = np.ones(size, bool), np.zeros(size, bool)
    for i in range(n):
        part = points[i : i + size]
        code = (code << np.uint64(21)) | part.astype(np.uint64)
        valid &= part != 0
        letter |= part > 32
    at = np.flatnonzero(valid & letter)
    return code[at], at


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


@dataclass(frozen=True)
class Profiles:
    """Languages, and for each the ranks of the n-grams of the joint inventory (-1: not in its profile)."""

    languages: list[str]
    inventory: np.ndarray
    ranks: np.ndarray
    multiplier: np.uint64
    bits: int
    slots: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, int, int]]) -> Profiles:
        languages = sorted({r[0] for r in rows})
        inventory = np.unique(np.array([r[1] for r in rows], np.uint64))
        ranks = np.full((len(languages), len(inventory)), -1, np.int32)
        for lang, gram, rank in rows:
            ranks[languages.index(lang), np.searchsorted(inventory, np.uint64(gram))] = rank
        # a multiplier that sends every n-gram of the inventory to a slot of its own
        rng, bits = np.random.default_rng(1), 16
        while True:
            multiplier = rng.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            place = ((inventory * multiplier) >> np.uint64(64 - bits)).astype(np.int64)
            if len(np.unique(place)) == len(inventory):
                break
            bits = min(bits + 1, 26)
        slots = np.full(2**bits, -1, np.int32)
        slots[place] = np.arange(len(inventory))
        return Profiles(languages, inventory, ranks, multiplier, bits, slots)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Number in the inventory, -1 if not there."""
        out = self.slots[((codes * self.multiplier) >> np.uint64(64 - self.bits)).astype(np.int64)]
        return np.where((out >= 0) & (self.inventory[out] == codes), out, -1)

    def nearest(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Predicted language and score of each text."""
        points, row = letters(texts)
        lettered = np.bincount(row[points > 32], minlength=len(texts)) > 0
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        size = len(self.inventory)
        counts = np.zeros(len(texts) * size, np.int64)
        for n in range(1, LONGEST + 1):
            codes, at = grams(points, n)
            number = self.find(codes)
            known = number >= 0
            counts += np.bincount(row[at[known]] * size + number[known], minlength=len(counts))
        counts = counts.reshape(len(texts), size)
        top = np.argsort(-counts, axis=1, kind="stable")[:, :PROFILE]
        there = np.take_along_axis(counts, top, 1) > 0
        place = np.arange(top.shape[1], dtype=np.int32)
        distance = np.empty((len(self.languages), len(texts)))
        for i, ranks in enumerate(self.ranks):
            rank = ranks[top]
            apart = np.where(rank < 0, PROFILE, np.abs(rank - place))
            distance[i] = (apart * there).sum(1)
        best = distance.argmin(0)
        most = np.maximum(there.sum(1) * PROFILE, 1)
        score = np.where(there.any(1), 1 - distance[best, np.arange(len(texts))] / most, 0.0)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return names, np.where(lettered, np.clip(score, 0, 1), 0.0)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from the texts with a language that are not held out."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    sample = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_ROWS)
    chosen = usable.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample.select("id", "lang")), F.col("_id").eqNullSafe(F.col("id"))).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            languages = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(languages)):
                points, _ = letters([t for t, x in zip(texts, languages, strict=True) if x == lang])
                code, n = np.unique(np.concatenate([grams(points, k)[0] for k in range(1, LONGEST + 1)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = chosen.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = top.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE)
    return Profiles.of([(r["lang"], r["gram"], r["rank"]) for r in top.select("lang", "gram", "rank").collect()])  # PROFILE rows a language


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                names, score = sent.value.nearest(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return own.mapInArrow(named, "doc_id long, held_out boolean, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
