"""Document fingerprints by a randomised edit embedding, bit-sampled, with banded search for near copies.

Walks over the characters of a text, the same ones for all texts, stretch it: at every time a walk looks at one
character, and a random bit of (time, character) says whether it goes on to the next. Texts that differ by few edits come into
step again, so their stretched texts differ at few times: edit distance becomes Hamming distance. Times are random bits with period
`PERIOD`, and characters count by `KINDS` hashed kinds.

A fingerprint samples the stretched text of each of `WALKS` walks at `SLOTS` times. A slot is a random permutation of all times of which it takes
the first that lies inside the text: the same time for all texts of a length, and mostly the same for similar lengths. It
keeps 8 bits of a hash of the `GRAM` characters that the walk stands at. The likeness of two fingerprints is the share of equal slots, less
what chance gives. Bands of `BAND` slots are keys, more of them than near copies have different slots, so that any two near copies share one. Links are
verified: each fingerprint against one of its key, then all of a key that are in no class together.

Rows: one for each document; a null text is an empty one. Empty texts have a fingerprint of their own. Repeated rows and null ids are
documents too; the order is by descending id, equal ids by two hashes of the text, null ids last. The next of a lone
document is itself. Texts are whole, of any length. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import give_back, mix, partitions, ragged, saved
from paddock.llm.components import components

#: walks, slots of each, characters of a sample, slots of a band
WALKS, SLOTS, GRAM, BAND = 4, 24, 8, 4
#: period of the random bits, kinds of characters; times that slots know of
PERIOD, KINDS, FARTHEST = 256, 64, 2**48
#: characters of texts that go on side by side, and texts that are not worth it
TOGETHER, FEW = 2_000_000, 12
#: least likeness of near copies, and the number of equal slots that it is reached at
NEAR = 0.8
LEAST = next(n for n in range(WALKS * SLOTS + 1) if (n / (WALKS * SLOTS) - 1 / 256) / (1 - 1 / 256) >= NEAR)
#: fingerprints of a key in a block, in the mean, and pairs that are compared at once
GROUP, PAIRS = 1024, 200_000
_ROW = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


# ---- walks ----------------------------------------------------------------------------------------


@cache
def bits() -> np.ndarray:
    """Does a walk go on from a kind of character at a time (within the period)?"""
    on = np.random.default_rng(13).random((WALKS, KINDS, PERIOD)) < 0.5
    on[..., 0] |= ~on.any(2)
    return on


@cache
def moves() -> np.ndarray:
    """The phase after a character, by walk, kind and phase before it, as one flat table."""
    time = np.arange(PERIOD)
    after = np.where(bits(), time, 2 * PERIOD)
    first = np.minimum.accumulate(np.concatenate([after, after + PERIOD], 2)[..., ::-1], 2)[..., ::-1][..., :PERIOD]
    return ((first + 1) % PERIOD).astype(np.uint8).ravel()


@cache
def slots() -> tuple[np.ndarray, np.ndarray]:
    """The times of all slots, one row for each: a random permutation of all times has the records 1, 1 / u, 1 / u / u', ...; and
    a salt for each."""
    rng = np.random.default_rng(17)
    rows = []
    for _ in range(WALKS * SLOTS):
        row = [1]
        while row[-1] < FARTHEST:
            row.append(int(row[-1] / (1 - rng.random())) + 1)
        rows.append(row)
    out = np.full((len(rows), max(map(len, rows))), np.iinfo(np.int64).max)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out, rng.integers(1, 2**63, len(rows), np.uint64)


def kinds_of(codes: np.ndarray) -> np.ndarray:
    """Hashed kinds of characters."""
    return (mix(codes.astype(np.uint64), np.full(len(codes), 13, np.uint64)) >> np.uint64(58)).astype(np.uint8)


def walked(kinds: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    """The phases of all walks after each character of each text, from its phases at the start on: (characters, walks).
    Texts go on side by side, the longest first; the last `FEW` of them, with a run of their own, one by one."""
    table, base = moves(), np.arange(WALKS, dtype=np.int64) * KINDS * PERIOD
    n = np.array([len(k) for k in kinds], np.int64)
    order = np.argsort(-n, kind="stable")
    flat = np.concatenate([np.zeros(0, np.uint8), *(kinds[k] for k in order)]).astype(np.int64) * PERIOD
    offset = np.cumsum(n[order]) - n[order]
    shared = int(n[order[FEW]]) if len(n) > FEW else 0
    active = np.searchsorted(-n[order], -np.arange(shared), side="left").tolist()  # texts longer than each place
    phase = starts[order].astype(np.int64) + base
    rows = []
    for at, a in enumerate(active):
        here = table[flat[offset[:a] + at][:, None] + phase[:a]]
        rows.append(here)
        phase = here + base
    together = np.concatenate([np.zeros((0, WALKS), np.uint8), *rows])
    row_start = np.cumsum([0, *active[:-1]]) if active else np.zeros(0, np.int64)
    out: list[np.ndarray] = [np.zeros((0, WALKS), np.uint8)] * len(n)
    for lane, k in enumerate(order.tolist()):
        held = together[row_start[: min(n[k], shared)] + lane]
        if n[k] > shared:
            begin = held[-1] if shared else starts[k]
            held = np.concatenate([held, _alone(kinds[k][shared:], begin)])
        out[k] = held
    return out


def _alone(kinds: np.ndarray, start: np.ndarray) -> np.ndarray:
    sides = []
    for table, first in zip(moves().reshape(WALKS, KINDS, PERIOD), start.tolist(), strict=True):
        rows = [row.tobytes() for row in table]
        sides.append(np.frombuffer(bytes(accumulate(kinds.tobytes(), lambda t, c: rows[c][t], initial=first)), np.uint8)[1:])
    return np.stack(sides, 1)


def prints(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Fingerprints from the code points and phases of texts, one row of bytes each."""
    records, salt = slots()
    at = np.zeros((len(texts), WALKS * SLOTS), np.int64)
    place = np.zeros_like(at)
    bounds = np.cumsum([0, *(len(c) for c, _ in texts)])
    for k, (codes, phases) in enumerate(texts):
        if len(codes) == 0:
            continue
        steps = np.diff(phases, axis=0, prepend=np.zeros((1, WALKS), np.uint8))  # wraps around
        times = np.cumsum(np.where(steps == 0, PERIOD, steps), axis=0, dtype=np.int64)
        length = np.repeat(times[-1], SLOTS)
        at[k] = records[np.arange(len(records)), (records <= length[:, None]).sum(1) - 1] - 1
        for w in range(WALKS):
            place[k, w * SLOTS : (w + 1) * SLOTS] = np.searchsorted(times[:, w], at[k, w * SLOTS : (w + 1) * SLOTS], side="right")
    flat = np.concatenate([np.zeros(0, np.uint32), *(c for c, _ in texts)]).astype(np.uint64)
    out = salt ^ at.astype(np.uint64)
    for g in range(GRAM):
        held = bounds[:-1, None] + place + g
        inside = held < bounds[1:, None]
        chars = np.where(inside, flat[np.where(inside, held, 0)] + np.uint64(1), np.uint64(0)) if len(flat) else np.zeros(out.shape, np.uint64)
        out = mix(out, chars)
    return (out >> np.uint64(56)).astype(np.uint8)


class Batch:
    """Texts with their code points, kinds and walks."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.codes = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
        self.kinds = [kinds_of(c) for c in self.codes]
        self.phases = walked(self.kinds, np.zeros((len(texts), WALKS), np.uint8))
        self.prints = prints(list(zip(self.codes, self.phases)))

    def edited(self, following: list[int]) -> tuple[list[str], np.ndarray]:
        """Each text that has a following one (its number), with its last half replaced by the first characters of that,
        as many or all; and the fingerprints. Walks go on from where they are after the first half."""
        cuts = [len(self.texts[k]) - len(self.texts[k]) // 2 for k in range(len(following))]
        tails = [slice(0, len(self.texts[k]) - cut) for k, cut in enumerate(cuts)]
        starts = np.array([self.phases[k][cut - 1] if cut else np.zeros(WALKS, np.uint8) for k, cut in enumerate(cuts)], np.uint8).reshape(-1, WALKS)
        rest = walked([self.kinds[f][t] for f, t in zip(following, tails)], starts)
        texts = [self.texts[k][:cut] + self.texts[f][t] for k, (cut, f, t) in enumerate(zip(cuts, following, tails))]
        join = lambda own, other, k: np.concatenate([own[k][: cuts[k]], other])
        parts = [(join(self.codes, self.codes[f][tails[k]], k), join(self.phases, rest[k], k)) for k, f in enumerate(following)]
        return texts, prints(parts)


def fingerprint(text: str | None) -> bytes:
    return Batch([text or ""]).prints[0].tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal slots, corrected for chance: 0 for unrelated texts, 1 for equal ones."""
    same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


# ---- the operator ---------------------------------------------------------------------------------


_FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), *[pa.binary()] * 3, *[pa.float64()] * 2]


def _rows(ids: list[int | None], batch: Batch, following: list[int]) -> list[tuple]:
    """Result rows of the first texts of a batch, as many as there are following ones."""
    edited, changed = batch.edited(following)
    own = [p.tobytes() for p in batch.prints]
    return [
        (i, len(batch.texts[k]), hashlib.sha256(edited[k].encode()).digest(), own[k], changed[k].tobytes(), likeness(own[k], changed[k].tobytes()), likeness(own[k], own[f]))
        for k, (i, f) in enumerate(zip(ids, following))
    ]


def _batch(rows: list[tuple], more: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [*_TYPES, *[t for _, t in more]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*_FIELDS, *[n for n, _ in more]])


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next document's.

    Texts are compressed, cut into ranges of descending ids and sorted there. The last document of a range meets the first of the next range
    in a second step, of one row per range."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3).compress
        for some in batches:
            packed = pa.array([small(t.encode()) for t in some.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", "h", "m")), packed], names=["doc_id", "h", "m", "packed"])

    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("m")]
    hashed = rows.withColumns({"h": F.xxhash64("text"), "m": F.hash("text")})
    small = hashed.mapInArrow(squeeze, "doc_id long, h long, m int, packed binary")
    ranged = small.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "packed")
    ends = [("part", pa.int64()), ("head", pa.binary()), ("tail", pa.binary())]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, held = TaskContext.get().partitionId(), None, []
        full = lambda blob: zstandard.ZstdDecompressor().decompress(blob).decode()
        size = 0
        for some in batches:
            for doc_id, blob in zip(some.column("doc_id").to_pylist(), some.column("packed").to_pylist(), strict=True):
                head = blob if head is None else head
                held.append((doc_id, full(blob), blob))
                size += len(held[-1][1])
                if size > TOGETHER and len(held) > 1:
                    yield done(held, part)
                    held, size = held[-1:], 0  # its next one is yet to come
        if len(held) > 1:
            yield done(held, part)
        if held:
            doc_id, text, blob = held[-1]
            yield _batch([(doc_id, len(text), None, None, None, None, None, part, head, blob)], ends)
        give_back()

    def done(held: list[tuple], part: int) -> pa.RecordBatch:
        following = list(range(1, len(held)))
        return _batch([(*r, part, None, None) for r in _rows([i for i, _, _ in held[:-1]], Batch([t for _, t, _ in held]), following)], ends)

    found = saved(ranged.mapInArrow(walk, f"{_ROW}, part long, head binary, tail binary"), "walked")
    # one row per range
    parts = sorted(r["part"] for r in found.where("head is not null").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, following long")
    open_ends = found.where("head is not null")
    heads = open_ends.select(F.col("part").alias("following"), F.col("head").alias("after"))
    met = open_ends.select("doc_id", "tail", "part").join(after, "part").join(heads, "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = lambda blob: zstandard.ZstdDecompressor().decompress(blob).decode()
        for some in batches:
            for doc_id, text, after in zip(*(some.column(c).to_pylist() for c in ("doc_id", "tail", "after")), strict=True):
                yield _batch(_rows([doc_id], Batch([full(text), full(after)]), [1]), [])

    return found.where("head is null").select(_FIELDS).unionByName(met.select("doc_id", "tail", "after").mapInArrow(finish, _ROW))


def _linked_labels(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Links (a, b) between the labels of fingerprints (key, own, label) that share a key. The fingerprints of a key are dealt into blocks, and
    every two blocks meet once."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("own"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "own", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    bucket = F.pmod(F.xxhash64("key", "low", "high"), F.lit(4 * partitions(rows.sparkSession))).alias("bucket")
    dealt = dealt.join(firsts.select("own", "fingerprint"), "own").select(bucket, "key", "label", "block", "low", "high", "fingerprint")

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("low", "ascending"), ("high", "ascending"), ("block", "ascending")])
        key, label, block, low, high = (table.column(c).to_numpy() for c in ("key", "label", "block", "low", "high"))
        slots = np.frombuffer(b"".join(table.column("fingerprint").to_pylist()), np.uint8).reshape(len(key), WALKS * SLOTS)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        edge = np.append(np.flatnonzero(new), len(key))
        group = np.cumsum(new) - 1
        # within a block each fingerprint meets those after it, between two blocks those of the first meet the second
        firsts = np.add.reduceat((block == low).astype(np.int64), edge[:-1])
        begin = np.where(low == high, np.arange(len(key)) + 1, (edge[:-1] + firsts)[group])
        size = np.where(block == low, edge[1:][group] - begin, 0)
        done = np.cumsum(size)
        found, at = [np.zeros((0, 2), np.int64)], 0
        while at < len(key):
            stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, side="right")))
            one, other = np.repeat(np.arange(at, stop), size[at:stop]), ragged(begin[at:stop], size[at:stop])
            apart = label[one] != label[other]
            one, other = one[apart], other[apart]
            near = (slots[one] == slots[other]).sum(1) >= LEAST
            found.append(np.unique(np.stack([label[one[near]], label[other[near]]], 1), axis=0))
            at = stop
        links = np.unique(np.concatenate(found), axis=0)
        give_back()
        return pa.table({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})

    return dealt.groupBy("bucket").applyInArrow(verify, "a long, b long")


def near_copies(prints: DataFrame) -> DataFrame:
    """(fingerprint, copy_of): for each distinct fingerprint the smallest id of its class, those that links between near copies reach. First each
    fingerprint is verified against the smallest hash of each of its keys, then all of a key that are in no class together. Fingerprints are
    bytes."""
    firsts = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).withColumn("own", F.xxhash64("fingerprint"))
    firsts = saved(firsts, "prints")
    bands = F.transform(F.sequence(F.lit(0), F.lit(WALKS * SLOTS // BAND - 1)), lambda k: F.xxhash64(k, F.substring("fingerprint", k * BAND + 1, F.lit(BAND))))
    keyed = firsts.select("own", F.explode(bands).alias("key"))
    heads = keyed.groupBy("key").agg(F.min("own").alias("head"), F.max("own").alias("last"), F.count("*").alias("members"))
    heads = heads.where("head < last")
    held = saved(keyed.join(heads.select("key", "head", "members"), "key"), "keyed")
    pairs = held.where("own <> head").select("own", "head").distinct()
    other = firsts.select(F.col("own").alias("head"), F.col("fingerprint").alias("head_print"))
    both = pairs.join(firsts, "own").join(other, "head")
    slot = lambda c, k: F.substring(c, k + 1, F.lit(1))
    same = F.aggregate(F.sequence(F.lit(0), F.lit(WALKS * SLOTS - 1)), F.lit(0), lambda n, k: n + (slot("fingerprint", k) == slot("head_print", k)).cast("int"))
    labels = components(both.where(same >= LEAST).select(F.col("own").alias("a"), F.col("head").alias("b")))

    # keys of two are done
    rows = held.where("members > 2").join(labels.withColumnRenamed("id", "own"), "own", "left").select("key", "own", F.coalesce("label", "own").alias("label"))
    open_keys = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    rows = saved(rows.join(open_keys.select("key"), "key"), "open")
    joined = components(_linked_labels(rows, firsts)).select(F.col("id").alias("label"), F.col("label").alias("class"))
    known = labels.withColumnRenamed("id", "own")
    named = firsts.join(known, "own", "left").withColumn("label", F.coalesce("label", "own")).join(joined, "label", "left")
    named = saved(named.select("fingerprint", "doc_id", F.coalesce("class", "label").alias("class")), "classes")
    least = named.groupBy("class").agg(F.min("doc_id").alias("copy_of"))
    return named.join(least, "class").select("fingerprint", "copy_of")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `compared`, fingerprints in hexadecimal, with `copy_of`, the smallest id of the class that links between near copies join (its own, if it has none)."""
    prints = compared(docs, id_col, text_col)
    named = prints.join(near_copies(prints.select("doc_id", "fingerprint")), "fingerprint")
    return named.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}).select(*_FIELDS, "copy_of")
