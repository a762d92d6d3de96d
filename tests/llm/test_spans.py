"""Substring operators and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from paddock.llm import decontamination, substrings, suffixes
from paddock.llm.anchors import minimum, spans_table
from tests.llm.conftest import documents

NULL = -(2**63)


def lowest(i):
    return NULL if i is None else i


def brute_words(rows, length):
    # a repeated row is an occurrence of its own
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[p : p + length]) for _, w in split for p in range(len(w) - length + 1))
    out = set()
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p : p + length])] > 1:
                gone[p : p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.add((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_bytes(rows, length):
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            first[k] = min(first.get(k, 2**63), lowest(i))
    out = set()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < lowest(i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.add((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_words(docs, cases):
    got = {tuple(r) for r in substrings.report(docs).collect()}
    assert got == brute_words(cases, 35)


def test_repeated_bytes(docs, cases):
    got = {tuple(r) for r in suffixes.report(docs).collect()}
    assert got == brute_bytes(cases, 50)


@pytest.mark.parametrize("seed", [1, 2])
def test_periodic_bytes(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), "".join(rng.choice(["a", "b", "é", "\0"], p=[0.97, 0.01, 0.01, 0.01]) for _ in range(rng.integers(0, 260)))) for i in rng.permutation(60)]
    got = {tuple(r) for r in suffixes.report(documents(spark, rows)).collect()}
    assert got == brute_bytes(rows, 50)


def test_texts_without_repeats(docs, cases):
    kept = substrings.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(cases)
    want = {(i, h) for i, _, _, h in brute_words(cases, 35)}
    assert {(r.doc_id, hashlib.sha256(" ".join((r.text or "").split()).encode()).hexdigest()) for r in kept.select("doc_id", "text").collect()} == want


def test_no_documents(no_docs):
    assert substrings.report(no_docs).count() == 0
    assert suffixes.report(no_docs).count() == 0
    assert substrings.without_repeats(no_docs).count() == 0


def test_expansion_groups_rows_by_prefix():
    text = np.array([ord(c) for c in "abcab"] + [0] + [ord(c) for c in "xabca"] + [0], np.int16)
    order, interval = suffixes.expand(text, 0, 3)
    groups = {}
    for row, at in enumerate(order):
        groups.setdefault(interval[row], set()).add(int(at))
    # "abca" and "bca" twice each, nothing else
    assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == [[0, 7], [1, 8]]


def test_minimum_and_spans():
    values = np.random.default_rng(0).integers(0, 99, 50)
    for n in (1, 2, 3, 7, 16):
        assert (minimum(values, n) == [values[i : i + n].min() for i in range(51 - n)]).all()
    t = spans_table(np.array([1, 1, 1, 2]), np.array([5, 0, 3, 0]), np.array([9, 3, 4, 2]))
    assert list(zip(*(c.to_pylist() for c in t.columns), strict=True)) == [(1, 0, 4), (1, 5, 9), (2, 0, 2)]


ITEMS = [(1, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "W3-w4 w5 w6 w7 w8 w9 w10 w11 w12"), (3, "two words"), (4, None), (5, ""), (None, "one"), (7, "one"), (8, "absent from every text")]


def brute_hits(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = cut(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    out = set()
    for i, t in rows:
        w = cut(t)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[k]
        out.add((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination(spark, docs, cases, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_hits(cases, ITEMS)
    assert any(r[5] for r in want)
    assert {tuple(r) for r in decontamination.report(docs, items).collect()} == want
    monkeypatch.setattr(decontamination, "BLOCK", 2)  # the set in several blocks
    assert {tuple(r) for r in decontamination.report(docs, items).collect()} == want


def test_clean_texts(spark, docs, cases):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    dirty = {r[0] for r in brute_hits(cases, ITEMS) if r[5]}
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(lowest, (r.doc_id for r in kept.select("doc_id").collect()))) == sorted(lowest(i) for i, _ in cases if i not in dirty)
    cut = decontamination.clean(docs, items, spans=True)
    assert cut.count() == len(cases)
    assert cut.where("doc_id = 106").first().text == "" and cut.where("doc_id = 100").first().text is None
    assert not any(r.contaminated for r in decontamination.report(cut.where("doc_id >= 400"), items.where("item_id <= 2")).collect())


def test_without_items(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(docs, none).where("contaminated").count() == 0
    assert decontamination.report(no_docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_items_with_a_null_id_hit_as_in_sql(spark):
    """All but n_items, where the SQL counts the null id as one more (`test_contamination` does not)."""
    import duckdb

    text = [" ".join(f"w{i}" for i in range(12)), " ".join(f"v{i}" for i in range(11))]
    docs, items = [(1, text[0]), (2, f"{text[0]} {text[1]}"), (3, "other words")], [(None, text[0]), (None, text[0] + " x"), (7, text[1])]
    got = decontamination.report(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", items)
    but = lambda rows: {(*r[:3], *r[4:]) for r in rows}
    assert but(map(tuple, got)) == but(con.execute(decontamination.SQL).fetchall())
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in got} == {1: (12, 0, True), 2: (23, 1, True), 3: (0, 0, False)}


@pytest.mark.parametrize("trial", range(60))
def test_intervals(trial):
    """Rows are in one interval exactly if they share a prefix of the minimum length without a separator."""
    r = random.Random(trial)
    pieces = ["".join(r.choice("ab" if trial % 2 else "abcdef") for _ in range(r.randrange(0, 40))) for _ in range(r.randrange(1, 12))]
    pieces += pieces[:2] if trial % 3 == 0 else []
    least = r.choice([1, 2, 3, 5, 8, 13, 20])
    text = np.array([x for p in pieces for x in [*(ord(c) - 96 for c in p), 0]], np.int16)
    order, interval = suffixes.expand(text, 0, least)
    found = {}
    for row, start in enumerate(order.tolist()):
        prefix = tuple(text[start : start + least].tolist())
        found.setdefault(prefix if len(prefix) == least and 0 not in prefix else start, set()).add(int(interval[row]))
    assert all(len(x) == 1 for x in found.values())
    assert len({next(iter(x)) for x in found.values()}) == len(found)
