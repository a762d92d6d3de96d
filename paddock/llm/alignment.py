"""Alignment of two tokenizers' tokens of the same text, and corpus-wide counts of linked ids.

1. Tasks encode texts with both tokenizers and align the arrays of byte ends by skipping diagonal runs: at the
   current shift between the two indexes, stretches of equal ends are found by exponential probing and jumped over; where the
   ends differ, the irregular group is resolved locally, the side that is behind going on until both end together, which gives the new
   shift. Many stretches of the texts do so side by side.
2. A block gathers the texts of a task up to `LINKS` links (a longer text is a block of its own): its distinct id pairs with
   their counts, and each document's pairs as numbers of those. Blocks are written to the shared folder.
3. Pair counts are added up over blocks, the highest of each B id is taken, and a join on the pair
   sends each block the counts of its own pairs, where documents are summed up. A pair has a row per block, so the most
   frequent pair is no hot key, and rows sent grow with blocks and vocabularies, not with tokens.

Rows: one for each document; repeated rows and null ids are documents like others. Texts that are null, empty, or
not given back byte by byte by both tokenizers (with the leading space) have no tokens: zeros and an empty digest. Texts
are whole, of any length. An empty table gives no rows; other columns are ignored. Token ids must be below 100,000.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import CHUNK, chunks, give_back, ragged, saved

#: links of a block, at least; digits of a token id
LINKS, DIGITS = 2_000_000, 5
#: A tokens of a lane, about, and the widest probe
LANE, PROBE = 256, 64
_LOW = 2**32
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# ---- tokenizers ---------------------------------------------------------------------------------


def byte_of_char() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable Latin-1 ones stand for
    themselves, all others for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Ids and token bytes of a byte-level vocabulary file. Where its ids are in the order of its merges, texts are
    encoded by tiktoken with the ids as ranks, which gives the same ids several times as fast."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        back = byte_of_char()
        special = {t["content"] for t in held["added_tokens"]}
        vocabulary = {bytes(back[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max(held["model"]["vocab"].values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token
        self.sizes = np.array([len(t) for t in self.bytes])
        parts = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        self.lossless = [held["model"]["vocab"]["".join(m)] for m in parts] == list(range(256, 256 + len(parts)))  # every byte has an id
        if self.lossless:
            import tiktoken

            encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary
            self.ids = lambda texts: [encode(" " + t) for t in texts]
        else:
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(path)
            coder.encode_special_tokens = True
            self.ids = lambda texts: [coder.encode(" " + t, add_special_tokens=False).ids for t in texts]


class Pieces:
    """Ids and token bytes of a sentencepiece model, which puts a space before the text itself."""

    lossless = False

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in names]
        self.sizes = np.array([len(t) for t in self.bytes])
        self.ids = lambda texts: model.encode(texts, num_threads=1)


class Both:
    """Ids of texts by both tokenizers, one after the other."""

    def __init__(self, byte_level: str, pattern: str, piece_model: str) -> None:
        self.a, self.b = ByteLevel(byte_level, pattern), Pieces(piece_model)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Whether both sides give each text back, and for A and B the ids of those texts and the number of ids of each."""
        got = [coder.ids(texts) for coder in (self.a, self.b)]
        good = np.ones(len(texts), bool)
        for coder, found in zip((self.a, self.b), got):
            if not coder.lossless:
                good &= [b"".join(map(coder.bytes.__getitem__, ids)) == b" " + t.encode() for ids, t in zip(found, texts, strict=True)]
        kept = np.flatnonzero(good).tolist()
        flat = lambda found: np.concatenate([np.zeros(0, np.int64), *(np.array(found[k], np.int64) for k in kept)])
        return good, [(flat(found), np.array([len(found[k]) for k in kept], np.int64)) for found in got]


_LOADED: dict[tuple[str, str, str], Both] = {}


def _loaded(*args: str) -> Both:
    if args not in _LOADED:
        _LOADED[args] = Both(*args)
    return _LOADED[args]


# ---- alignment ----------------------------------------------------------------------------------


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes after the last A token and the last B token of every group, from the ends of both (which reach the same
    last end). Lanes of some `LANE` A tokens, each from a common end to another, go on side by side."""
    if len(a) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.append(a, np.full(1, -1)), np.append(b, np.full(1, -2))  # never equal
    last_a, last_b = len(a) - 1, len(b) - 1

    def resolved(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Behind the next common end of each lane: the side that is behind goes on."""
        i, j = i.copy(), j.copy()
        lanes = np.arange(len(i))
        while len(lanes := lanes[(left := a[i[lanes]]) != (right := b[j[lanes]])]):
            left, right = a[i[lanes]], b[j[lanes]]
            i[lanes] += left < right
            j[lanes] += left > right
        return i + 1, j + 1

    near = np.arange(LANE, last_a, LANE)
    cut_a, cut_b = resolved(near, np.searchsorted(b[:-1], a[near]))
    cut_a, at = np.unique(cut_a, return_index=True)
    i, j = np.append(0, cut_a[cut_a < last_a]), np.append(0, cut_b[at][cut_a < last_a])
    stop = np.append(i[1:], last_a)
    found = []  # (to_a, to_b, length) of one-to-one stretches, and irregular groups as stretches of one
    while len(i):
        shift, at, lanes, step = j - i, i.copy(), np.arange(len(i)), 1
        while len(lanes):  # exponential probing at the lane's shift
            here = at[lanes][:, None] + np.arange(step)
            same = (a[np.minimum(here, last_a)] == b[np.minimum(here + shift[lanes][:, None], last_b)]) & (here < stop[lanes][:, None])
            n = np.where(same.all(1), step, same.argmin(1))
            at[lanes] += n
            lanes = lanes[n == step]
            step = min(2 * step, PROBE)
        ran = at > i
        found.append((at[ran], (at + shift)[ran], (at - i)[ran]))
        more = at < stop
        i, j, stop = at[more], (at + shift)[more], stop[more]
        i, j = resolved(i, j)
        found.append((i, j, np.ones(len(i), np.int64)))
        more = i < stop
        i, j, stop = i[more], j[more], stop[more]
    to_a, to_b, length = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = to_a.argsort(kind="stable")
    to_a, to_b, length = to_a[order], to_b[order], length[order]
    return ragged(to_a - length + 1, length), ragged(to_b - length + 1, length)


def links(ends_a: np.ndarray, ends_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of all overlapping pairs. A one-to-one group is a pair; in others every end of either side
    closes one."""
    size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    single = (size_a == 1) & (size_b == 1)
    irregular_a = ragged((to_a - size_a)[~single], size_a[~single])
    irregular_b = ragged((to_b - size_b)[~single], size_b[~single])
    ends = np.sort(np.concatenate([ends_a[irregular_a], ends_b[irregular_b]]), kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    more_a = irregular_a[np.searchsorted(ends_a[irregular_a], ends)]
    more_b = irregular_b[np.searchsorted(ends_b[irregular_b], ends)]
    return np.concatenate([to_a[single] - 1, more_a]), np.concatenate([to_b[single] - 1, more_b])


@cache
def _digits() -> np.ndarray:
    """Decimal digits of all token ids, right-aligned, with a free place behind."""
    out = np.zeros((10**DIGITS, DIGITS + 1), np.uint8)
    number = np.arange(len(out))
    for k in range(DIGITS):
        part = number // 10 ** (DIGITS - 1 - k)
        out[:, k] = np.where((part > 0) | (k == DIGITS - 1), part % 10 + ord("0"), 0)
    return out


def written(ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All groups as text `a1,a2|b1;`, and the end of each group in it."""
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[to_a - 1], last_b[to_b - 1] = True, True
    group_a = np.cumsum(last_a) - last_a
    group_b = np.cumsum(last_b) - last_b
    # A tokens stand after the B tokens of earlier groups, B tokens after the A tokens up to their group's
    place_a = np.arange(len(ids_a)) + np.append(0, to_b)[group_a]
    place_b = np.arange(len(ids_b)) + to_a[group_b]
    ids, mark = np.zeros(len(ids_a) + len(ids_b), np.int64), np.zeros(len(ids_a) + len(ids_b), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    mark[place_a], mark[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    wide = _digits()[ids]
    size = (wide != 0).sum(1)
    wide[:, DIGITS] = mark
    flat = wide.ravel()
    return flat[flat != 0], np.cumsum(size + 1)[to_a + to_b - 1]


class Block:
    """Aligned documents of a task, up to a number of links."""

    def __init__(self) -> None:
        self.docs: list[dict[str, np.ndarray | pa.Array]] = []
        self.n_links = 0

    def add(self, doc_ids: pa.Array, texts: list[str | None], both: Both) -> None:
        some = np.array([k for k, t in enumerate(texts) if t], np.int64)
        good, ((ids_a, n_a), (ids_b, n_b)) = both.encode([t for t in texts if t])
        row = some[good]
        ends_a, ends_b = np.cumsum(both.a.sizes[ids_a]), np.cumsum(both.b.sizes[ids_b])
        to_a, to_b = aligned(ends_a, ends_b)
        stop_a = np.cumsum(n_a)
        groups = np.searchsorted(to_a, stop_a, side="right")  # texts end where both sides end
        at_a, at_b = links(ends_a, ends_b, to_a, to_b)
        text, ends = written(ids_a, ids_b, to_a, to_b)
        cuts = [0, *ends[groups - 1].tolist()] if len(groups) else [0]
        digest = [""] * len(texts)
        for k, start, stop in zip(row.tolist(), cuts, cuts[1:]):
            digest[k] = hashlib.sha256(text[start : stop - 1]).hexdigest()
        doc = row[np.searchsorted(stop_a, at_a, side="right")] if len(row) else row
        out = {"doc_id": doc_ids, "digest": digest, "doc": doc, "pair": ids_a[at_a] * _LOW + ids_b[at_b]}
        for name, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", np.diff(groups, prepend=0))):
            out[name] = np.zeros(len(texts), np.int64)
            out[name][row] = values
        self.docs.append(out)
        self.n_links += len(at_a)

    def row(self, number: int) -> pa.RecordBatch:
        """The block as one row: distinct pairs and counts, and packed documents."""
        join = lambda name: np.concatenate([d[name] for d in self.docs])
        sizes = [len(d["n_a"]) for d in self.docs]
        doc = np.concatenate([d["doc"] + at for d, at in zip(self.docs, accumulate(sizes, initial=0))])
        pair, index = np.unique(join("pair"), return_inverse=True)
        n_pairs = max(len(pair), 1)
        key, times = np.unique(doc * n_pairs + index, return_counts=True)
        doc, index = key // n_pairs, key % n_pairs
        packed = {
            "doc_id": pa.concat_arrays([d["doc_id"] for d in self.docs]), "digest": pa.array([x for d in self.docs for x in d["digest"]], pa.string()),
            **{name: pa.array(join(name)) for name in ("n_a", "n_b", "n_groups")},
            "n_pairs": pa.array(np.bincount(doc, minlength=sum(sizes))),
        }
        inner = pa.RecordBatch.from_arrays(list(packed.values()), names=list(packed))
        # differences of sorted numbers, and counts, are mostly small
        step = np.diff(index, prepend=0)
        step[np.flatnonzero(np.diff(doc, prepend=-1))] = index[np.flatnonzero(np.diff(doc, prepend=-1))]
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]), pa.array([pair], pa.list_(pa.int64())), pa.array([np.bincount(index, times, len(pair)).astype(np.int64)], pa.list_(pa.int64())),
                pa.array([inner.serialize().to_pybytes()], pa.binary()), pa.array([squeeze(step.astype("<u4").tobytes())], pa.binary()),
                pa.array([squeeze(times.astype("<u4").tobytes())], pa.binary()),
            ],
            names=["block", "pairs", "counts", "docs", "steps", "times"],
        )


_INNER = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_pairs", pa.int64())])
_BLOCK = "block long, pairs array<long>, counts array<long>, docs binary, steps binary, times binary"


def summed(packed: pa.Table, answers: pa.Table) -> pa.Table:
    """The result rows of one block, from its packed documents and the corpus counts of its pairs."""
    total, best = np.zeros(len(answers), np.int64), np.zeros(len(answers), bool)
    at = answers["at"].to_numpy()
    total[at], best[at] = answers["total"].to_numpy(), answers["best"].to_numpy()
    parts = []
    for r in packed.select(["docs", "steps", "times"]).to_pylist():
        docs = pa.ipc.read_record_batch(r["docs"], _INNER)
        unpack = zstandard.ZstdDecompressor().decompress
        step, times = (np.frombuffer(unpack(r[c]), "<u4").astype(np.int64) for c in ("steps", "times"))
        n = docs.column("n_pairs").to_numpy()
        stops = np.cumsum(n)
        run = np.append(0, np.cumsum(step))
        index = run[1:] - np.repeat(run[stops - n], n)

        def of_docs(values: np.ndarray, stops=stops, n=n) -> pa.Array:
            run = np.append(0, np.cumsum(values))
            return pa.array(run[stops] - run[stops - n])

        named = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")}
        named |= {"n_links": of_docs(times), "n_best": of_docs(times * best[index]), "count_sum": of_docs(times * total[index]), "groups_sha256": docs.column("digest")}
        parts.append(pa.table(named))
    return pa.concat_tables(parts)


def report(docs: DataFrame, byte_level: str, piece_model: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", links_of_block: int = LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document. A is the byte-level
    vocabulary file with the pattern of its words, B the sentencepiece model."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _loaded(byte_level, pattern, piece_model)
        first, made, block = TaskContext.get().partitionId() * 2**24, 0, Block()
        for part in chunks(batches, "text", CHUNK):
            block.add(part.column("doc_id"), part.column("text").to_pylist(), both)
            if block.n_links >= links_of_block:
                yield block.row(first + made)
                made, block = made + 1, Block()
        if block.docs:
            yield block.row(first + made)
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = saved(rows.mapInArrow(gather, _BLOCK), "aligned")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "pair")).select("block", "at", "pair.pairs", "pair.counts")
    totals = saved(pairs.groupBy("pairs").agg(F.sum("counts").alias("total")), "pair-counts")
    b_id = F.col("pairs").bitwiseAND(_LOW - 1)
    highest = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("highest"))
    known = totals.withColumn("b", b_id).join(highest, "b").select("pairs", "total", (F.col("total") == F.col("highest")).alias("best"))
    answers = pairs.select("block", "at", "pairs").join(known, "pairs").select("block", "at", "total", "best")
    packed = blocks.select(F.col("block").alias("own"), "docs", "steps", "times")
    return packed.groupBy("own").cogroup(answers.groupBy("block")).applyInArrow(summed, _RESULT)
