"""Fingerprints against a plain walk, step by step, and the search for near copies."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from paddock.llm import fingerprints as fp
from paddock.llm.common import mix
from tests.llm.conftest import documents, invented


def plain(text):
    """Walks one time after the other over the text, and keeps where they are at each time."""
    kinds = fp.kinds_of(np.array([ord(c) for c in text], np.uint32))
    records, salt = fp.slots()
    out = []
    for w in range(fp.WALKS):
        stood, i, time = [], 0, 0
        while i < len(text):
            stood.append(i)
            i += fp.bits()[w, kinds[i], time % fp.PERIOD]
            time += 1
        for s in range(w * fp.SLOTS, (w + 1) * fp.SLOTS):
            at = max((int(r) - 1 for r in records[s] if r <= len(stood)), default=0)
            value = salt[s : s + 1] ^ np.uint64(at)
            for g in range(fp.GRAM):
                place = (stood[at] if stood else 0) + g
                value = mix(value, np.array([ord(text[place]) + 1 if place < len(text) else 0], np.uint64))
            out.append(int(value[0]) >> 56)
    return bytes(out)


def expected(rows):
    text = [(i, t or "") for i, t in rows]
    out = []
    for k, (i, t) in enumerate(text):
        after = text[(k + 1) % len(text)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = plain(t), plain(edited), plain(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), fp.likeness(a, b), fp.likeness(a, c)))
    return out


TEXTS = ["", None, "x", "ab", "same", "same", "日本語 🙂 text é", "word " * 200, *invented(1, 25), "y" * 3000]


def test_rows(spark):
    r = random.Random(3)
    ids = r.sample(range(-50, 500), len(TEXTS))
    rows = [*zip(ids, TEXTS), (None, "no id")]
    got = fp.report(documents(spark, rows).repartition(5)).collect()
    want = expected(sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0))))
    assert sorted((tuple(g)[:-1] for g in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("together", [1, 3000])
def test_batches(spark, together, monkeypatch):
    """Lanes and batches do not change the result."""
    texts = [t or "" for t in TEXTS]
    monkeypatch.setattr(fp, "FEW", together % 7)
    got = fp.Batch(texts)
    assert [p.tobytes() for p in got.prints] == [plain(t) for t in texts]


def test_few_rows(spark, no_docs):
    assert fp.report(no_docs).count() == 0
    one = fp.report(documents(spark, [(7, "abcd")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0 and one["copy_of"] == 7
    twice = fp.report(documents(spark, [(7, "abcd"), (7, "abcd"), (None, None)])).collect()
    assert [r["n_chars"] for r in twice].count(4) == 2 and len(twice) == 3


def test_likeness():
    base = " ".join(invented(9, 30))
    other = " ".join(invented(10, 30))
    near = base[:400] + "some more words" + base[400:]
    own = fp.fingerprint(base)
    assert fp.likeness(own, own) == 1.0
    assert fp.likeness(own, fp.fingerprint(other)) < 0.1
    assert fp.likeness(own, fp.fingerprint(near)) > 0.5
    half = base[: len(base) // 2] + other[: len(base) // 2]
    assert 0.3 < fp.likeness(own, fp.fingerprint(half)) < 0.7


def test_near_copies(spark):
    """Copies and texts with one small edit get the id of the first; strangers keep their own."""
    base = [" ".join(invented(s, 20)) for s in range(20, 30)]
    rows = [(10 * k + j, t if j < 3 else t + " tail") for k, t in enumerate(base) for j in range(4)]
    got = {r["doc_id"]: r["copy_of"] for r in fp.report(documents(spark, rows).repartition(4)).collect()}
    assert got == {10 * k + j: 10 * k for k in range(10) for j in range(4)}


@pytest.mark.parametrize(("group", "pairs"), [(1024, 200_000), (4, 7)])
def test_no_link_is_left_out(spark, group, pairs, monkeypatch):
    """Fingerprints that share keys but are far from the head of each, and near copies at the threshold, against all pairs."""
    monkeypatch.setattr(fp, "GROUP", group)
    monkeypatch.setattr(fp, "PAIRS", pairs)
    rng = np.random.default_rng(4)
    total = fp.WALKS * fp.SLOTS
    rows = []
    for _ in range(4):
        base = rng.integers(0, 256, total).astype(np.uint8)
        for _ in range(8):  # they share a quarter with the base, in three families
            far = base.copy()
            far[total // 4 :] = rng.integers(0, 256, total - total // 4)
            rows += [far, far.copy(), far.copy()]
            rows[-1][-1] ^= 1
            spread = far.copy()  # as many slots differ as may, spread over all bands
            spread[rng.permutation(np.arange(0, total, 5))[: total - fp.LEAST]] ^= 1
            rows.append(spread)
    rows = [r.tobytes() for r in rows]
    ids = rng.permutation(len(rows)).tolist()
    links = [(ids[i], ids[j]) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and fp.likeness(a, b) >= fp.NEAR]
    top = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    frame = spark.createDataFrame([(i, bytearray(r)) for i, r in zip(ids, rows)], "doc_id long, fingerprint binary")
    got = {bytes(r["fingerprint"]): r["copy_of"] for r in fp.near_copies(frame).collect()}
    assert got == {r: top[i] for i, r in zip(ids, rows)}
