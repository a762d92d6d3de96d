"""Packing of token pieces by a configuration linear program over the length histogram.

1. Every text is tokenised once; its tokens plus an end id are cut into pieces of at most `capacity`.
   The pieces (id, piece, start, length, checksum) are written to the shared folder.
2. The histogram of lengths, at most `capacity` numbers, goes to the driver. The configuration program
   (minimise the number of sequences, every length covered as often as it occurs) is solved there with prices of lengths that follow
   multiplicative weights and a knapsack dynamic program, bounded by the counts, that finds the configuration of the highest price.
   Whole configurations are taken in three ways: straight from the pricing (full ones only, as prices of covered lengths fall from
   pass to pass), and from the program's solution rounded down, covering every length or as played. The fewest sequences count; the program is
   spared only where the pricing alone meets the bound by volume, so that no plan can have fewer.
3. What stays over, sequences that cannot be filled to the end, is packed by best fit, on counts.
4. Pieces are numbered within their length, in bounded blocks, and look up sequence and offset in the plan,
   whose size depends on capacity and rounds, not on the input.

Rows: a null or empty text is one piece that holds the end id; repeated rows are packed each. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.common import chunks, mix, powers, ragged, saved

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: the game of lengths and configurations: games, steps of each, rate, and gap to the bound that ends it
ROUNDS, STEPS, RATE, GAP = 8, 3_000, 0.5, 1e-4
#: passes that price what is left, and how much a price falls where a pass has covered all
PASSES, FALL = 40, 0.1
#: rows of one length that a task numbers at once, in the mean
BLOCK = 65_536
#: slots for words whose ids a task remembers, and the ids kept for them; bounds on its memory
SLOTS, POOL = 2**20, 2**23

# Texts of these characters only are split here: for them lower-casing and splitting agree with the
# tokenizer's own. All other texts go through the tokenizer as a whole.
_PLAIN = re.compile(r"[\t\n\r !-~¡°·«»¿À-ÖØ-öø-įĲ-ſ‐-‧‰-⁞€]*")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def _classes() -> np.ndarray:
    out = np.full(2**16, _OTHER, np.uint8)
    out[[9, 10, 13, 32]] = _SPACE
    out[48:58] = _DIGIT
    out[97:123] = _LETTER
    out[0xDF:0x180] = _LETTER
    out[0xF7] = _OTHER
    return out


_CLASS = _classes()
_CODE = np.random.default_rng(9).integers(1, 2**64, 2**16, np.uint64, endpoint=False)


class Tokens:
    """Ids of texts. Splits plain texts into the tokenizer's words, which it encodes one by one, and looks
    the ids of words up that it has met before."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(SLOTS, np.uint64)
        self.place = np.zeros(SLOTS, np.int64)
        self.size = np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(2**16, "<u4"), 0

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes in the pool of the ids of new words."""
        places, sizes = [], []
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, owner = np.asarray(got.ids, "<u4"), np.asarray(got.word_ids)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(ids)]])
            if len(cuts) != len(part) + 1:
                raise ValueError("words and ids do not match")
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), "<u4")])
            self.pool[self.used : self.used + len(ids)] = ids
            places.append(cuts[:-1] + self.used)
            sizes.append(np.diff(cuts))
            self.used += len(ids)
        return np.concatenate(places), np.concatenate(sizes)

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, and the number of ids of each."""
        lowered = [t.lower() for t in texts]
        chars = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-16-le"), np.uint16)
        ends_of_rows = np.cumsum([len(t) + 1 for t in lowered])
        kind = _CLASS[chars]
        first = kind != _SPACE
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        self._contractions(chars, kind, first)
        starts = np.flatnonzero(first)
        if len(starts) == 0:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        filled = np.flatnonzero(kind != _SPACE)
        begin = np.searchsorted(filled, starts)
        lengths = np.diff(np.append(begin, len(filled)))
        within = np.arange(len(filled)) - np.repeat(begin, lengths)
        hashes = mix(np.add.reduceat(_CODE[chars[filled]] * powers(int(lengths.max()))[within], begin), lengths.astype(np.uint64))
        slots = (hashes >> np.uint64(44)).astype(np.int64)
        place, size = self.place[slots], self.size[slots].astype(np.int64)
        missed = np.flatnonzero(self.known[slots] != hashes)
        if len(missed):
            new, where, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            at = missed[where]
            words = [chars[a : a + n].tobytes().decode("utf-16-le") for a, n in zip(starts[at], lengths[at], strict=True)]
            places, sizes = self._learn(words)
            place[missed], size[missed] = places[back], sizes[back]
            self.known[slots[at]], self.place[slots[at]], self.size[slots[at]] = new, places, sizes
        ids = self.pool[ragged(place, size)]
        totals = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, np.concatenate([[0], ends_of_rows]))]
        if self.used > POOL:
            self.forget()
        return ids, np.diff(totals)

    @staticmethod
    def _contractions(chars: np.ndarray, kind: np.ndarray, first: np.ndarray) -> None:
        """'s 't 're 've 'm 'll 'd are words where the apostrophe stands alone before letters."""
        p = np.flatnonzero(first & (chars == ord("'")))
        p = p[kind[p + 1] == _LETTER]
        if len(p) == 0:
            return
        one, two = chars[p + 1], chars[np.minimum(p + 2, len(chars) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        p, n = p[short | long], np.where(short, 1, 2)[short | long]
        first[p + 1] = False
        rest = p + 1 + n
        first[rest[kind[rest] == _LETTER]] = True

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after the other, and the number of ids of each."""
        texts = [t or "" for t in texts]
        plain = np.array(["<|" not in t and _PLAIN.fullmatch(t) is not None for t in texts], bool)
        ids, counts = self.plain([t for t, ok in zip(texts, plain, strict=True) if ok]) if plain.any() else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        if plain.all():
            return ids, counts
        own = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
        parts = [next(own) if ok else self.whole(t) for t, ok in zip(texts, plain, strict=True)]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


_LOADED: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """The pieces of every text: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(tokenizer)
        for batch in chunks(batches, "text"):
            ids, counts = coder.encode(batch.column("text").to_pylist())
            total = counts + 1
            stops = np.cumsum(total)
            full = np.full(int(stops[-1]), end_id, "<u4")
            full[np.delete(np.arange(len(full)), stops - 1)] = ids
            per_row = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), per_row)
            piece = ragged(np.zeros(len(total), np.int64), per_row)
            start = piece * capacity
            length = np.minimum(capacity, total[row] - start)
            at = (stops - total)[row] + start
            crc = [zlib.crc32(full[a : a + n].tobytes()) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


# ---- the plan, on the histogram -----------------------------------------------------------------


class Knapsack:
    """Dynamic program over prices: the highest total price for every room, no length more often than it occurs."""

    def __init__(self, prices: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> None:
        self.lengths = lengths.tolist()
        self.items: list[tuple[int, int]] = []  # (length index, copies): powers of two and the remainder of each length
        for k, (size, n) in enumerate(zip(self.lengths, counts.tolist(), strict=True)):
            open_, step = min(n, capacity // size), 1
            while open_ > 0:
                self.items.append((k, min(step, open_)))
                open_, step = open_ - step, 2 * step
        self.value = np.zeros(capacity + 1)
        self.taken = np.zeros((capacity + 1, len(self.items)), bool)
        for i, (k, n) in enumerate(self.items):
            size = self.lengths[k] * n
            more = self.value[: capacity + 1 - size] + prices[k] * n
            better = more > self.value[size:] + 1e-12
            self.taken[size:, i] = better
            self.value[size:][better] = more[better]

    def best(self, room: int) -> dict[int, int]:
        """The configuration of the highest price in this room: copies of each length index."""
        one: dict[int, int] = {}
        i = len(self.items)
        while i > 0 and len(hit := np.flatnonzero(self.taken[room, :i])):
            i = int(hit[-1])
            k, n = self.items[i]
            one[k] = one.get(k, 0) + n
            room -= self.lengths[k] * n
        return one


def _game(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray, np.ndarray, float]:
    """The configuration program by multiplicative weights: configurations, how often each is used as played, the share of each length that
    this covers, and a proven lower bound on the number of sequences.

    Lengths and configurations play a game. Prices of lengths that are covered too often fall, weights of configurations that are
    worth much rise; both foresee the last change, so their averages close in fast. Between the games the
    knapsack program adds the best configurations at the average prices."""
    scale = float((lengths * counts).sum()) / capacity
    # how often the counts allow a configuration: weights begin in proportion, so that rare lengths are not covered many times over
    able = lambda some: np.array([min(counts[k] / n for k, n in c.items()) for c in some])
    pool = [{k: int(min(counts[k], capacity // lengths[k]))} for k in range(len(lengths))]
    known = {tuple(sorted(c.items())) for c in pool}
    price, weight, bound = lengths * counts / float((lengths * counts).sum()), able(pool) / able(pool).sum(), 0.0
    for _ in range(ROUNDS):
        table = Knapsack(price * scale / counts, lengths, counts, capacity)
        bound = max(bound, scale / table.value[capacity])
        tops = [table.best(capacity)]
        for k in range(len(lengths)):
            one = table.best(capacity - int(lengths[k]))
            if one.get(k, 0) < counts[k]:
                tops.append(one | {k: one.get(k, 0) + 1})
        new = [c for c in tops if (key := tuple(sorted(c.items()))) not in known and not known.add(key)]
        if new:
            pool += new
            weight = np.append(weight * 0.9, 0.1 * able(new) / able(new).sum())
        key = np.concatenate([np.fromiter(c.keys(), np.int64) for c in pool])
        copies = np.concatenate([np.fromiter(c.values(), np.float64) for c in pool]) * scale / counts[key]
        size = np.array([len(c) for c in pool])
        owner, first = np.repeat(np.arange(len(pool)), size), np.cumsum(size) - size
        covers = lambda w: np.bincount(key, copies * w[owner], len(counts))  # noqa: B023, E731
        log_price, log_weight = np.log(price), np.log(weight)
        mean_price, mean_weight = np.zeros_like(price), np.zeros_like(weight)
        cover = worth = None
        for step in range(1, STEPS + 1):
            p, w = (np.exp(x - x.max()) for x in (log_price, log_weight))
            p, w = p / p.sum(), w / w.sum()
            mean_price += step * p
            mean_weight += step * w
            last_cover, last_worth = cover, worth
            cover, worth = covers(w), np.add.reduceat(copies * p[key], first)
            log_price -= RATE * (2 * cover - (cover if last_cover is None else last_cover))
            log_weight += RATE * (2 * worth - (worth if last_worth is None else last_worth))
        price, weight = np.maximum(mean_price / mean_price.sum(), 1e-300), np.maximum(mean_weight / mean_weight.sum(), 1e-300)
        cover = covers(weight)
        if scale / cover.min() <= bound * (1 + GAP):
            break
    return pool, weight * scale, cover, bound


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray, float]:
    """Configurations, how often each is used so that every length is covered, and a proven lower bound on the number of sequences."""
    pool, used, cover, bound = _game(lengths, counts, capacity)
    return pool, used / cover.min(), bound


def _rounded(pool: list[dict[int, int]], used: np.ndarray, left: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of configurations, rounded down, that use no length more often than it is left."""
    out = []
    for i in np.argsort(-used, kind="stable"):
        times = min(int(used[i] + 1e-6), *(int(left[k] // n) for k, n in pool[i].items()))
        if times > 0:
            out.append((pool[i], times))
            for k, n in pool[i].items():
                left[k] -= n * times
    return out


def _full(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole configurations without room to spare, by pricing what is left: a pass solves the knapsack program
    once and completes each length, the longest first, by the best configuration beside it, as often as the counts allow. Then the
    prices of lengths fall by how much of them was covered."""
    log_price, out = np.log(lengths / capacity), []
    for _ in range(PASSES):
        some = np.flatnonzero(left)
        start = left[some].copy()
        table = Knapsack(np.exp(log_price[some]), lengths[some], start, capacity) if len(some) else None
        made = len(out)
        for k in range(len(some) - 1, -1, -1):
            if left[some[k]] == 0:
                continue
            one = table.best(capacity - int(lengths[some[k]]))
            one = {int(some[j]): n for j, n in (one | {k: one.get(k, 0) + 1}).items()}
            times = min(int(left[j] // n) for j, n in one.items())
            if times > 0 and sum(int(lengths[j]) * n for j, n in one.items()) == capacity:
                out.append((one, times))
                for j, n in one.items():
                    left[j] -= n * times
        if len(out) == made:
            break
        covered = 1 - left[some] / start
        log_price[some] -= FALL * (covered - covered.mean())
    return out


def _best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing on counts: the longest length opens a sequence, the longest that fits goes in
    next; the same filling is repeated as long as the counts allow."""
    left = counts.copy()
    plan = []
    while left.any():
        room, one = capacity, {}
        spare = left.copy()
        while True:
            fits = np.flatnonzero((spare > 0) & (lengths <= room))
            if len(fits) == 0:
                break
            k = int(fits[-1])
            n = min(int(spare[k]), room // int(lengths[k]))
            one[k] = one.get(k, 0) + n
            spare[k] -= n
            room -= n * int(lengths[k])
        times = min(int(left[k] // n) for k, n in one.items())
        plan.append((one, times))
        for k, n in one.items():
            left[k] -= n * times
    return plan


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations (copies of each length index) and how many sequences use each; every length is
    used exactly as often as it occurs."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    if len(lengths) == 0:
        return []

    def whole(start: list[tuple[dict[int, int], int]], left: np.ndarray) -> list[tuple[dict[int, int], int]]:
        out = start + _full(lengths, left, capacity)
        return out + _best_fit(lengths, left, capacity)

    size = lambda some: sum(times for _, times in some)
    best = whole([], counts.copy())
    if size(best) > -(-int((lengths * counts).sum()) // capacity):
        pool, used, cover, _ = _game(lengths, counts, capacity)
        for share in (cover.min(), 1.0):
            left = counts.copy()
            best = min(whole(_rounded(pool, used / share, left), left), best, key=size)
    return best


def layout(lengths: np.ndarray, planned: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Runs of places, sorted by (length, first rank): ranks first .. first + times - 1 of that length lie at
    `offset` in the sequences sequence, sequence + 1, ..."""
    runs, sequence, seen = [], 0, {}
    for one, times in planned:
        offset = 0
        for k, copies in sorted(one.items(), reverse=True):
            size = int(lengths[k])
            for _ in range(copies):
                runs.append((size, seen.get(size, 0), sequence, offset))
                seen[size] = seen.get(size, 0) + times
                offset += size
        sequence += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return {name: table[:, i] for i, name in enumerate(("length", "first", "sequence", "offset"))}


# ---- the operator ---------------------------------------------------------------------------------


def pack(cut: DataFrame, capacity: int, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces."""
    spark = cut.sparkSession
    # at most `capacity` lengths
    histogram = sorted((int(r[0]), int(r[1])) for r in cut.groupBy(length_col).count().collect())
    lengths, counts = np.array([h[0] for h in histogram], np.int64), np.array([h[1] for h in histogram], np.int64)
    runs = layout(lengths, plan(lengths, counts, capacity))
    sent = spark.sparkContext.broadcast(runs)

    blocks = max(1, int(counts.max(initial=0)) // BLOCK)
    keyed = cut.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    sizes = keyed.groupBy(length_col, "_block").count()
    before = Window.partitionBy(length_col).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(length_col, "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(length_col, "_block").orderBy(*order)
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1).join(sizes, [length_col, "_block"])
    ranked = ranked.withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_block", "_before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        width = np.int64(2**40)
        keys = found["length"] * width + found["first"]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in (length_col, "_rank"))
            at = np.searchsorted(keys, size * width + rank, side="right") - 1
            out = batch.drop_columns(["_rank"])
            out = out.append_column("sequence_id", pa.array(found["sequence"][at] + rank - found["first"][at], pa.int64()))
            yield out.append_column("offset", pa.array(found["offset"][at], pa.int64()))

    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*cut.columns, "_rank").mapInArrow(place, schema)


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = saved(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces")
    return pack(cut, capacity)
