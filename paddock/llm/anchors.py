"""Repeated windows across a corpus, found without comparing texts to each other.

A text is a sequence of units (bytes, or hashes of words); a window is `length` consecutive units. Every
window has an anchor: the k-gram with the smallest hash inside it, the first of equals. Equal windows have
equal anchors at the same place, so all their occurrences meet under the anchor's hash. Consecutive windows
with one anchor form a run.

1. `shared`: anchors that occur more than once in the corpus. Each task counts the anchors of many texts
   first and sends every distinct anchor once, so one passage in a third of all texts costs a row per task.
2. `runs`: the runs at shared anchors, with what is needed to compare their windows. Equal runs of one
   chunk of texts are settled there and sent once.
3. `repeated`: the operators compare the runs of a bucket of anchors and return the stretches covered.

All hashes of anchors only choose what is compared; results rest on the comparison in step 3.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import CHUNK, chunks, flat, gram_hashes, numbers, partitions, ragged

#: anchors that a task gathers before it sends them
GATHERED = 2_000_000
#: bytes of an anchor's hash that are sent; the bucket holds more of it, and there are the more buckets
#: the more anchors. Two anchors with equal hashes are only compared in vain.
HASH_BYTES = 4

Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Windows:
    """What is compared: `units` turns bytes and row bounds into unit codes (uint64) and unit bounds."""

    units: Units
    length: int
    gram: int
    within: bool  # does a second occurrence in the same text count?

    @property
    def span(self) -> int:
        return self.length - self.gram + 1


@dataclass
class Found:
    """Runs of a chunk: anchor hash, row, first window, number of windows."""

    anchor: np.ndarray
    row: np.ndarray
    first: np.ndarray
    count: np.ndarray


def minimum(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of every n consecutive values."""
    size = 1
    while 2 * size <= n:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = n - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def find_runs(codes: np.ndarray, bounds: np.ndarray, w: Windows) -> Found:
    """All runs of the texts of a chunk. Long sequences are handled in overlapping parts, which may cut a run
    in two; the windows stay the same."""
    found = []
    n = len(codes)
    for a in range(0, max(n - w.length + 1, 0), CHUNK):
        part = codes[a : a + CHUNK + w.length - 1]
        grams = gram_hashes(part, w.gram)
        keys = grams & np.uint64(0xFFFFFFFF00000000)
        keys |= np.arange(len(grams), dtype=np.uint64)
        at = minimum(keys, w.span)
        at &= np.uint64(0xFFFFFFFF)
        at = at.astype(np.int64)
        valid = np.zeros(len(at) + 1, np.int8)  # +1 where the windows of a text begin, -1 after its last one
        fits = np.flatnonzero(bounds[1:] - w.length >= bounds[:-1])
        np.add.at(valid, np.clip(bounds[:-1][fits] - a, 0, len(at)), 1)
        np.add.at(valid, np.clip(bounds[1:][fits] - w.length + 1 - a, 0, len(at)), -1)
        windows = np.flatnonzero(np.cumsum(valid[:-1]))
        if len(windows) == 0:
            continue
        own = at[windows]
        starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        first = windows[starts]
        found.append(Found(grams[own[starts]], np.searchsorted(bounds, first + a, side="right") - 1, first + a, np.diff(np.append(starts, len(windows)))))
    if not found:
        none = np.zeros(0, np.int64)
        return Found(np.zeros(0, np.uint64), none, none, none)
    return Found(*(np.concatenate([getattr(f, c) for f in found]) for c in ("anchor", "row", "first", "count")))


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(8 * HASH_BYTES)) % np.uint64(buckets)).astype(np.int64)


def low(anchor: np.ndarray) -> np.ndarray:
    return anchor & np.uint64(2 ** (8 * HASH_BYTES) - 1)


def to_bytes(anchor: np.ndarray) -> np.ndarray:
    return anchor.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]


def from_bytes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :HASH_BYTES] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def cuts(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal values."""
    if len(values) == 0:
        return []
    at = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


# ---- step 1 ------------------------------------------------------------------------------------

_QUESTIONS = pa.schema([("bucket", pa.int32()), ("marks", pa.bool_()), ("owners", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("settled", pa.binary())])


def _question_rows(owner: np.ndarray, anchor: np.ndarray, bucket: np.ndarray, settled: np.ndarray, marks: bool) -> pa.RecordBatch:
    """One row per bucket: owners and how many hashes each has, their hashes, and which are settled."""
    order = np.lexsort((owner, bucket))
    owner, bucket, settled, raw = owner[order], bucket[order], settled[order], to_bytes(anchor[order])
    rows = []
    for a, b in cuts(bucket):
        heads = np.concatenate([[a], a + 1 + np.flatnonzero(owner[a + 1 : b] != owner[a : b - 1])])
        rows.append((int(bucket[a]), marks, owner[heads].astype("<i8").tobytes(), np.diff(np.append(heads, b)).astype("<i4").tobytes(), raw[a:b].tobytes(), np.packbits(settled[a:b]).tobytes()))
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _QUESTIONS.types, strict=True)], schema=_QUESTIONS)


def shared(docs: DataFrame, w: Windows, buckets: int) -> DataFrame:
    """(doc_id, hashes): for every text the anchors that occur elsewhere too, packed in one row. What a bucket of anchors
    answers goes in one row to each bucket of texts, and is sorted by text there. With `within`, elsewhere may be in the same text. `docs` has doc_id and text."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, owners, held = [], [], 0
        for batch in chunks(batches, "text"):
            codes, bounds = w.units(*flat(batch.column("text")))
            runs = find_runs(codes, bounds, w)
            anchors.append(runs.anchor)
            owners.append(numbers(batch.column("doc_id"))[runs.row])
            held += len(runs.anchor)
            if held >= GATHERED:
                yield from asked(np.concatenate(anchors), np.concatenate(owners))
                anchors, owners, held = [], [], 0
        if held:
            yield from asked(np.concatenate(anchors), np.concatenate(owners))

    def asked(anchor: np.ndarray, owner: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((owner, anchor))
        anchor, owner = anchor[order], owner[order]
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        fresh = new.copy()
        fresh[1:] |= owner[1:] != owner[:-1]
        several = np.bincount(group) > 1 if w.within else np.add.reduceat(fresh.astype(np.int64), heads) > 1
        own = several[group] & fresh
        # texts of this task that share an anchor know it at once ...
        yield _question_rows(owner[own], anchor[own], owner[own] % buckets, np.ones(int(own.sum()), bool), True)
        # ... and every distinct anchor is sent once, so that other tasks' texts learn of it
        yield _question_rows(owner[heads], anchor[heads], bucket_of(anchor[heads], buckets), several, False)

    def decided(table: pa.Table) -> pa.Table:
        owners, hashes, settled, ready = [], [], [], []
        names = ("marks", "owners", "counts", "hashes", "settled")
        for known, o, c, h, s in zip(*(table.column(x).to_pylist() for x in names), strict=True):
            owner, anchor = np.repeat(np.frombuffer(o, "<i8"), np.frombuffer(c, "<i4")), from_bytes(h)
            if known:
                ready.append((owner, anchor))
                continue
            owners.append(owner)
            hashes.append(anchor)
            settled.append(np.unpackbits(np.frombuffer(s, np.uint8))[: len(anchor)].astype(bool))
        if owners:
            owner, anchor, done = np.concatenate(owners), np.concatenate(hashes), np.concatenate(settled)
            order = np.argsort(anchor, kind="stable")
            ranked = anchor[order]
            group = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]).astype(np.int64)
            many = np.empty(len(anchor), bool)
            many[order] = np.bincount(group)[group] > 1
            ready.append((owner[many & ~done], anchor[many & ~done]))
        owner, anchor = (np.concatenate([r[i] for r in ready]) for i in (0, 1))
        return pa.Table.from_batches([_question_rows(owner, anchor, owner % buckets, np.ones(len(owner), bool), True)])

    def answered(table: pa.Table) -> pa.Table:
        owners, hashes = [np.zeros(0, np.int64)], [to_bytes(np.zeros(0, np.uint64))]
        for o, c, h in zip(*(table.column(x).to_pylist() for x in ("owners", "counts", "hashes")), strict=True):
            owners.append(np.repeat(np.frombuffer(o, "<i8"), np.frombuffer(c, "<i4")))
            hashes.append(np.frombuffer(h, np.uint8).reshape(-1, HASH_BYTES))
        owner, raw = np.concatenate(owners), np.concatenate(hashes)
        order = np.argsort(owner, kind="stable")
        owner, raw = owner[order], raw[order]
        pieces = cuts(owner)
        return pa.table({"doc_id": pa.array([int(owner[a]) for a, _ in pieces], pa.int64()), "hashes": pa.array([raw[a:b].tobytes() for a, b in pieces], pa.binary())})

    packed = "bucket int, marks boolean, owners binary, counts binary, hashes binary, settled binary"
    questions = docs.mapInArrow(gathered, packed)
    answers = questions.groupBy("bucket").applyInArrow(decided, packed)
    return answers.groupBy("bucket").applyInArrow(answered, "doc_id long, hashes binary")


# ---- step 2 ------------------------------------------------------------------------------------


@dataclass
class Runs:
    """Runs as they are compared. Run i has count[i] windows, its values are values[offset[i]:offset[i + 1]];
    it occurs in text owner[i] at the windows starts[place[i]:place[i + 1]] (none: its texts know already).
    """

    owner: np.ndarray
    anchor: np.ndarray
    count: np.ndarray
    times: np.ndarray
    starts: np.ndarray
    values: np.ndarray
    extra: int  # values of a run beyond its number of windows

    @property
    def sizes(self) -> np.ndarray:
        return self.count + self.extra

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def occurrences(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run number and first window of all occurrences of the given runs."""
        place = np.concatenate([[0], np.cumsum(self.times)])[:-1]
        return np.repeat(which, self.times[which]), self.starts[ragged(place[which], self.times[which])]

    def pick(self, which: np.ndarray) -> Runs:
        return Runs(self.owner[which], self.anchor[which], self.count[which], self.times[which], self.occurrences(which)[1], self.values[ragged(self.offsets[:-1][which], self.sizes[which])], self.extra)

    def packed(self) -> tuple[bytes, ...]:
        return (self.owner.astype("<i8").tobytes(), self.anchor.astype("<u8").tobytes(), self.count.astype("<u2").tobytes(), self.times.astype("<i4").tobytes(), self.starts.astype("<i4").tobytes(), _small(self.values))


def _small(values: np.ndarray) -> bytes:
    """Text is compressed, hashes cannot be."""
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes()) if values.dtype == np.uint8 else values.tobytes()


def _large(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data) if kind == "<u1" else data, kind)


_PACKED = ("owner", "anchor", "count", "times", "starts", "values")
_KINDS = ("<i8", "<u8", "<u2", "<i4", "<i4")
_RUN_ROWS = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in _PACKED)])
SPANS = "doc_id long, b int, e int"


def spans_table(owner: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Table:
    """Spans of units, united where they overlap or touch."""
    order = np.lexsort((first, owner))
    owner, first, end = owner[order], first[order].astype(np.int64), end[order].astype(np.int64)
    if len(owner):
        new = np.concatenate([[True], owner[1:] != owner[:-1]])
        group = np.cumsum(new) - 1
        # the furthest end so far inside the text: lift each text above the last one
        lift = group * np.int64(2**33)
        reach = np.maximum.accumulate(end + lift) - lift
        new[1:] |= first[1:] > reach[:-1]
        heads = np.flatnonzero(new)
        owner, first, end = owner[heads], first[heads], reach[np.append(heads[1:], len(reach)) - 1]
    return pa.table({"doc_id": pa.array(owner, pa.int64()), "b": pa.array(first, pa.int32()), "e": pa.array(end, pa.int32())})


def repeated(
    docs: DataFrame,
    w: Windows,
    cut: Callable[[np.ndarray, np.ndarray, np.ndarray, Found], tuple[np.ndarray, np.ndarray, np.ndarray]],
    kind: str,
    extra: int,
    compare: Callable[[Runs], tuple[np.ndarray, np.ndarray, np.ndarray]],
) -> DataFrame:
    """(doc_id, spans): the spans of units of every text that repeated windows cover, in no order.

    `cut` gives a content key, value offsets and values of the runs of a chunk; `compare` gets all runs of a
    bucket and returns owner, first window and last window + 1 of stretches that are covered.
    """
    spark = docs.sparkSession
    buckets = 2 * partitions(spark)
    marks = shared(docs, w, buckets).groupBy("doc_id").agg(F.collect_list("hashes").alias("marks"))
    within = w.within

    def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, text_bounds = flat(batch.column("text"))
            codes, bounds = w.units(data, text_bounds)
            runs = find_runs(codes, bounds, w)
            lists = batch.column("marks")
            known = np.unique(from_bytes(b"".join(lists.flatten().to_pylist())))
            low_part = low(runs.anchor)
            at = np.minimum(np.searchsorted(known, low_part), max(len(known) - 1, 0))
            on = np.flatnonzero(known[at] == low_part) if len(known) else np.zeros(0, np.int64)
            runs = Found(runs.anchor[on], runs.row[on], runs.first[on], runs.count[on])
            if len(on) == 0:
                continue
            owner = numbers(batch.column("doc_id"))[runs.row]
            start = runs.first - bounds[runs.row]
            key, offset, values = cut(data, codes, bounds, runs)
            yield from settle(owner, start, runs, key, offset, values)

    def settle(owner: np.ndarray, start: np.ndarray, runs: Found, key: np.ndarray, offset: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((start, owner, key))
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        size = np.bincount(group)
        if within:
            here = (size > 1)[group]  # covered already
            asking = ~here
        else:
            here = owner[order] != owner[order][heads][group]  # a smaller text of this chunk has it
            asking = ~here
        if here.any():
            done = order[here]
            table = spans_table(owner[done], start[done], start[done] + runs.count[done] + w.length - 1)
            own, b, e = (table.column(c).to_numpy() for c in ("doc_id", "b", "e"))
            bucket = own % buckets
            o = np.argsort(bucket, kind="stable")
            own, b, e, bucket = own[o], b[o], e[o], bucket[o]
            rows = [(int(bucket[x]), own[x:y].astype("<i8").tobytes(), b"", b"", b"", b[x:y].astype("<i4").tobytes(), e[x:y].astype("<i4").tobytes()) for x, y in cuts(bucket)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RUN_ROWS.types, strict=True)], schema=_RUN_ROWS)
        # one run per key, with the occurrences that still ask
        times = np.add.reduceat(asking.astype(np.int64), heads)
        one = order[heads]
        sizes = runs.count[one] + extra
        sent = Runs(owner[one], runs.anchor[one], runs.count[one], times, start[order[asking]], values[ragged(offset[one], sizes)], extra)
        bucket = bucket_of(sent.anchor, buckets)
        rows = []
        by_bucket = np.argsort(bucket, kind="stable")
        for x, y in cuts(bucket[by_bucket]):
            which = by_bucket[x:y]
            which = which[np.argsort(sent.owner[which], kind="stable")]
            rows.append((int(bucket[which[0]]), *sent.pick(which).packed()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RUN_ROWS.types, strict=True)], schema=_RUN_ROWS)

    def compared(table: pa.Table) -> pa.Table:
        owner, first, end, parts = [], [], [], []
        for row in zip(*(table.column(c).to_pylist() for c in _PACKED), strict=True):
            if not row[1]:  # spans that are settled
                owner.append(np.frombuffer(row[0], "<i8"))
                first.append(np.frombuffer(row[4], "<i4"))
                end.append(np.frombuffer(row[5], "<i4"))
            else:
                parts.append([*(np.frombuffer(x, k) for x, k in zip(row, _KINDS, strict=False)), _large(row[5], kind)])
        if parts:
            columns = [np.concatenate([p[i] for p in parts]) for i in range(6)]
            runs = Runs(columns[0], columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4].astype(np.int64), columns[5], extra)
            own, b, e = compare(runs)
            owner.append(own)
            first.append(b)
            end.append(e + w.length - 1)
        return spans_table(np.concatenate(owner), np.concatenate(first), np.concatenate(end))

    asked = docs.join(marks.hint("shuffle_hash"), "doc_id").mapInArrow(run_rows, "bucket int, " + ", ".join(f"{c} binary" for c in _PACKED))
    found = asked.groupBy("bucket").applyInArrow(compared, SPANS)
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("b", "e")).alias("spans"))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (a null id is the smallest number) and text."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text_col).alias("text"))


def kept_units(spans: list[dict] | None, n: int) -> np.ndarray | None:
    """Flags of the units outside all spans; None if there are no spans."""
    if not spans:
        return None
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, [s["b"] for s in spans], 1)
    np.add.at(change, [s["e"] for s in spans], -1)
    return np.cumsum(change[:-1]) == 0
