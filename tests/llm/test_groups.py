"""Sharding, packing, near duplicates, embeddings and the pipeline."""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paddock.llm import decontamination, embeddings, minhash, packing, quality, sharding, substrings
from paddock.llm.components import components
from tests.llm.conftest import documents, invented

PATH = public_tokenizers.path("word_bpe_49k.json")


def by_links(ids, linked):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


# ---- sharding -----------------------------------------------------------------------------------


def test_sharding(docs, no_docs, cases):
    rows = sharding.sharded(docs).collect()
    assert len(rows) == len(cases)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    text = dict(cases)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8)
    assert sharding.sharded(no_docs).count() == 0


def test_movement_stays_in_the_subtree(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    before = sharding.assign(ids, sharding.tree(8), into="a")
    both = sharding.assign(before, sharding.tree(8, weights={5: 3.0}), into="b")
    moved = both.where("a <> b").groupBy("a", "b").count().collect()
    assert moved and all(r.b // 4 == 1 for r in moved)  # only into the region of shard 5
    assert all(r.b == 5 or r.a // 4 == 0 or r.a // 2 != r.b // 2 for r in moved)
    share = both.where("b = 5").count() / 4000
    assert 0.24 < share < 0.36  # three tenths
    assert both.groupBy("a").count().agg(F.min("count")).first()[0] > 400


# ---- packing ------------------------------------------------------------------------------------


@pytest.mark.parametrize("capacity", [2048, 16])
def test_packing(docs, cases, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.packed(docs, PATH, capacity).collect()
    want = []
    for i, t in cases:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= capacity
    assert len(filled) <= 1.05 * sum(filled.values()) / capacity + 2


def test_packing_nothing(no_docs):
    assert packing.packed(no_docs, PATH).count() == 0


def test_tokens_are_the_tokenizers():
    coder = packing.Tokens(PATH)
    texts = ["Don't I'LL we've 'tis ''s o'clock's", "ÀÉÎ ß ẞ Straße Ÿ ſ ŉ Ⱥ ǰ İ", "¿Qué? «x» 12.5€ a_b…—x²", "<|endoftext|> a", "日本 é", "\x1c\x85\xa0a b", "", "'", "a'", "x 're've", None]
    ids, counts = coder.encode(texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == coder.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_plan_uses_every_length_once():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(np.minimum(rng.lognormal(4, 1, 3000).astype(int) + 1, 500), return_counts=True)
    used = np.zeros(len(lengths), int)
    plan = packing.plan(lengths, counts, 512)
    for one, times in plan:
        assert sum(lengths[k] * n for k, n in one.items()) <= 512
        for k, n in one.items():
            used[k] += n * times
    assert (used == counts).all()
    assert sum(t for _, t in plan) <= 1.005 * (lengths * counts).sum() / 512 + 1


@pytest.mark.parametrize(("lengths", "counts", "optimum"), [
    ([342, 410, 511, 683, 1024], [3000] * 5, 4500),  # best fit alone needs 4575
    ([682, 1366], [500, 400], 400 + 34), ([2048], [9], 9), ([1], [5000], 3), ([1024, 1025], [10, 10], 15),
])
def test_configuration_program(lengths, counts, optimum):
    """Fractional solutions cover every length and lie at a proven bound; the plan is rounded from them."""
    lengths, counts = np.array(lengths), np.array(counts)
    pool, used, bound = packing.fractional(lengths, counts, 2048)
    covered = np.zeros(len(lengths))
    for one, x in zip(pool, used):
        assert sum(lengths[k] * n for k, n in one.items()) <= 2048
        for k, n in one.items():
            covered[k] += n * x
    assert (covered >= counts - 1e-6).all() and bound <= optimum + 1e-6
    assert used.sum() <= bound * 1.002
    assert sum(t for _, t in packing.plan(lengths, counts, 2048)) == optimum


@pytest.mark.parametrize("more", [0, 1, 60])
def test_one_rule_for_any_number_of_lengths(more):
    """Lengths that fill no sequence are planned by the program, however many there are."""
    lengths = np.concatenate([np.array([342, 410, 511, 683, 1024]), np.arange(1500, 1500 + more)])
    counts = np.concatenate([np.full(5, 3000), np.ones(more, int)])
    planned = packing.plan(lengths, counts, 2048)
    used = np.zeros(len(lengths), int)
    for one, times in planned:
        assert sum(lengths[k] * n for k, n in one.items()) <= 2048
        for k, n in one.items():
            used[k] += n * times
    assert (used == counts).all()
    # the optimum of the five alone, and the others in sequences of their own
    assert sum(t for _, t in planned) <= 4500 + more
    many = packing.plan(np.arange(680, 780), np.full(100, 300), 2048)
    assert sum(t for _, t in many) <= 14_700  # pricing and best fit alone need 14,775; no plan has fewer than 14,685


def test_knapsack_is_bounded():
    rng = np.random.default_rng(8)
    for _ in range(30):
        m = rng.integers(1, 5)
        lengths, counts, prices = np.sort(rng.choice(np.arange(1, 12), m, replace=False)), rng.integers(1, 4, m), rng.random(m)
        table = packing.Knapsack(prices, lengths, counts, 20)
        best = max(sum(p * n for p, n in zip(prices, some)) for some in np.ndindex(*(counts + 1)) if (lengths * some).sum() <= 20)
        one = table.best(20)
        assert table.value[20] == pytest.approx(best) == pytest.approx(sum(prices[k] * n for k, n in one.items()))
        assert all(n <= counts[k] for k, n in one.items()) and sum(lengths[k] * n for k, n in one.items()) <= 20


# ---- near duplicates ----------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(rows):
    own = {-(2**63) if i is None else i: shingles(t) for i, t in rows}
    near = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.8
    return by_links(own, [(i, j) for i, j in itertools.combinations(own, 2) if near(own[i], own[j])])


def test_near_duplicates(docs, no_docs, cases):
    want = brute_classes(cases)
    rows = minhash.report(docs).collect()
    null = lambda i: -(2**63) if i is None else i
    assert {null(r.doc_id): null(r.class_id) for r in rows} == want
    assert all(r.class_size == list(want.values()).count(null(r.class_id)) for r in rows)
    kept = minhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert {null(r.doc_id) for r in kept.select("doc_id").collect()} == set(want.values())
    assert minhash.report(no_docs).count() == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    """More near copies than a group holds, most of them not similar enough to the first one."""
    monkeypatch.setattr(minhash, "GROUP", 8)
    base = invented(5, 1, 2000, 3000)[0].split() + [f"b{i}" for i in range(160)]
    rng = np.random.default_rng(4)
    texts = []
    for i in range(60):
        w = list(base[-160:])
        for p in rng.choice(len(w), 3, replace=False):
            w[p] = f"e{i}x{p}"
        texts.append((i, " ".join(w)))
    texts += [(1000 + i, t) for i, t in enumerate(invented(6, 20))]
    got = {r.doc_id: r.class_id for r in minhash.report(documents(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_samples_agree_as_often_as_bags_are_similar():
    rng = np.random.default_rng(8)
    weights = np.ones(minhash.SLOTS)
    agree = []
    for _ in range(40):
        common = rng.integers(0, 2**63, 300).astype(np.uint64)
        a = np.sort(np.concatenate([common, rng.integers(0, 2**63, 75).astype(np.uint64)]))
        b = np.sort(np.concatenate([common, rng.integers(0, 2**63, 75).astype(np.uint64)]))
        one = np.ones(375, np.int64)
        sa, sb = (minhash.signatures(np.zeros(375, np.int64), x, one, weights)[1][0] for x in (a, b))
        agree.append((sa == sb).mean())
    assert abs(np.mean(agree) - 300 / 450) < 0.03


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201)]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- embeddings ---------------------------------------------------------------------------------


def vectors(seed=0, groups=30, noise=0.02, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    rows, i = [], 0
    for g, c in enumerate(centres):
        for _ in range(1 + g % 7):
            rows.append((i, (c + rng.normal(size=size) * noise * (1 + g % 4)).tolist(), g))
            i += 1
    rows += [(i + k, rows[3][1], 1) for k in range(5)]
    return rows


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 4)
    good = vectors()
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] * 16, 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [], 1), (None, [-1.0] * 16, 2)]
    rows = good + odd + [good[0]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.report(frame).collect()}
    usable = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in good} | {905: np.array([1, 2]) / 5**0.5, 906: np.array([2, 4]) / 20**0.5}
    linked = [(a, b) for a, b in itertools.combinations(usable, 2) if len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= 0.9]
    top = by_links([r[0] for r in rows if r[0] is not None], linked)
    degree = dict.fromkeys(top, 0)
    for a, b in linked:
        degree[a] += 1
        degree[b] += 1
    want = {i: (degree[i], top[i], top[i] == i) for i in top} | {None: (0, None, True)}
    found = sum(v[0] for v in got.values())
    assert found >= 0.9 * 2 * len(linked)
    assert got == want
    assert embeddings.report(frame.where("false")).count() == 0
    assert embeddings.report(frame.where("vec_id in (900, 901)")).count() == 2


def test_traversal_goes_by_ascending_sums():
    x = np.array([v for _, v, _ in vectors()], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embeddings.fit(x, centroids=8)
    a, b = index.halves(x)
    at, cell = index.visits(x)
    got = set(zip(at.tolist(), cell.tolist(), strict=True))
    limit = np.maximum(index.reach, a.min(1) + b.min(1))
    want = {(i, j * b.shape[1] + k) for i in range(len(x)) for j in range(a.shape[1]) for k in range(b.shape[1]) if a[i, j] + b[i, k] <= limit[i]}
    assert got == want


def test_hot_group_does_not_hide_other_links():
    """A third of the vectors are near copies of each other; the links of the others are found as well."""
    rng = np.random.default_rng(3)
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    base = unit(rng.normal(size=(3000, 64)))
    aside = rng.normal(size=(1000, 64))
    aside = unit(aside - (aside * base[:1000]).sum(1)[:, None] * base[:1000])
    x = np.concatenate([base, 0.93 * base[:1000] + (1 - 0.93**2) ** 0.5 * aside, unit(base[-1] + rng.normal(size=(2000, 64)) * 0.02)])
    index = embeddings.fit(x, centroids=embeddings.centroids_for(len(x)))
    own = index.cells(x)
    visited = index.visited(x[:1000], own[3000:4000]) | index.visited(x[3000:4000], own[:1000])
    assert visited.mean() >= embeddings.RECALL
    at, cell = index.links_visits(x[:50])
    assert set(zip(at.tolist(), cell.tolist(), strict=True)) == {(i, c) for i in range(50) for c in range(len(index.first) * len(index.second)) if index.visited(x[i : i + 1], np.array([c]))[0]}


def test_null_ids_inside_groups(spark):
    """Null-id vectors link like others and stay apart by their vectors; the group holds together."""
    at = lambda *v: [float(x) for x in v]
    rows = [(1, at(10, 0, 0, 0)), (2, at(10, 1, 0, 0)), (None, at(10, 2, 0, 0)), (None, at(10, 2, 1, 0)), (None, at(10, 2, 1, 0)), (None, at(0, 0, 0, 1)), (7, at(0, 0, 1, 0)), (8, at(0, 0, 2, 0)), (None, None)]
    out = embeddings.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id) for r in out), key=str)
    assert got == sorted([(1, 3, None), (2, 3, None), (0, 3, None), (0, 3, None), (0, 0, None), (0, 0, None), (7, 1, 7), (8, 1, 7)], key=str)
    assert sorted((r.vec_id or 0, r.n_links) for r in out if r.kept) == [(0, 0), (0, 0), (0, 3), (7, 1)]


# ---- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path, cases, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, " ".join(f"w{i}" for i in range(20))), (2, cases[2][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    have, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        have = stage(spark, have, folder)
        if name != "best_fit_packing":
            assert have.columns == docs.columns
            have = have.cache()
        seen[name] = have
    first = quality.selected(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert seen["quality_classifier"].count() == first.count()
    rows = [(r.doc_id, r.text) for r in seen["quality_classifier"].select("doc_id", "text").collect()]
    stay = set(brute_classes(rows).values())
    assert {-(2**63) if r.doc_id is None else r.doc_id for r in seen["near_dedup"].select("doc_id").collect()} == stay
    assert seen["substring_dedup"].count() == len(stay)
    assert seen["benchmark_decontamination"].where("doc_id = 2").count() == 0
    left = seen["benchmark_decontamination"]
    assert decontamination.report(left, spark.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").count() == 0
    assert substrings.report(seen["substring_dedup"]).agg(F.sum("n_removed")).first()[0] == 0
    packed = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in seen["best_fit_packing"].collect()]
    again = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pieces(left, PATH, 2048).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(packed, key=key) == sorted(again, key=key)
    total = corpus_pipeline.run(spark, folder)
    assert total.count() == len(packed)
