"""Alignment of two tokenizers against a plain version: two pointers and counts in dictionaries."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from paddock.llm import alignment
from tests.llm.conftest import documents, invented

BYTE_LEVEL, PIECES = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n", "  two  spaces \n\t tab ", "▁ is no space", "a▁b", "<|endoftext|> <s></s> <0x41> [UNK]", "été 日本語テスト 🙂🙂 ‍ é", "don't can't 'll 123456789",
    "x" * 5000, "ab " * 4000, "   " * 500, "\x00\x01 control \x7f", "a\r\n b　c d e", "one", "one", "ﬁ ﬂ Å",
]


def plain(rows):
    a, b = Tokenizer.from_file(BYTE_LEVEL), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    back = alignment.byte_of_char()
    names = {i: t for t, i in json.load(open(BYTE_LEVEL, encoding="utf-8"))["model"]["vocab"].items()}
    piece = lambda i: bytes([i - 3]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for _, text in rows:
        raw = b" " + (text or "").encode()
        x = [(i, bytes(back[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        y = [(i, piece(i)) for i in b.encode(text)] if text else []
        if not text or b"".join(t for _, t in x) != raw or b"".join(t for _, t in y) != raw:
            docs.append(([], [], [], []))
            continue
        spans = []
        for side in (x, y):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        both = {e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}
        groups, start = [], 0
        for end in sorted(both):
            groups.append(tuple([i for i, s, e in side if start <= s and e <= end] for side in spans))
            start = end
        pairs, first = [], 0
        for i, s, e in spans[0]:
            while spans[1][first][2] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < e:
                pairs.append((i, spans[1][k][0]))
                k += 1
        counts.update(pairs)
        docs.append((x, y, groups, pairs))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for (doc_id, _), (x, y, groups, pairs) in zip(rows, docs):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc_id, len(x), len(y), len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return sorted(out, key=str)


def rows():
    texts = [*ODD, *invented(4, 30), *[invented(5, 1)[0]] * 15]
    r = random.Random(2)
    texts += ["".join(r.choice("ab é\n'1日🙂 ") for _ in range(60)) for _ in range(40)]
    return [(None if k == 3 else k // 2 if k < 8 else k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("links_of_block", [1, 500, 10**6])
def test_report(spark, links_of_block):
    some = rows()
    df = documents(spark, some).repartition(3)
    got = alignment.report(df, BYTE_LEVEL, PIECES, public.PATTERN, links_of_block=links_of_block)
    assert sorted(map(tuple, got.collect()), key=str) == plain(some)


def test_empty(spark, no_docs):
    assert alignment.report(no_docs, BYTE_LEVEL, PIECES, public.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed, monkeypatch):
    """Groups end at the common ends, whatever the lanes and probes."""
    r = random.Random(seed)
    n = r.choice([1, 5, 400, 3000])
    ends = lambda p: np.array(sorted({e for e in range(1, n) if r.random() < p} | {n}))
    a, b = ends(r.random()), ends(r.random())
    monkeypatch.setattr(alignment, "LANE", r.choice([1, 3, 50, 10**6]))
    to_a, to_b = alignment.aligned(a, b)
    both = sorted({*a.tolist()} & {*b.tolist()})
    assert a[to_a - 1].tolist() == both == b[to_b - 1].tolist()
