"""Small documents with the awkward cases that every operator must handle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

# names that operators use themselves
SCHEMA = "doc_id long, text string, lang string, id long, label string, _id long, spans string, marks string, log_weight double, bucket int, rep long, n int"


def documents(spark: SparkSession, texts: list[tuple[int | None, str | None]], langs: dict[int | None, str] | None = None) -> DataFrame:
    rows = [(i, t, (langs or {}).get(i), 1, "x", 2, "s", "m", 0.5, 3, 4, 5) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def invented(seed: int, n: int, words: int = 120, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    some = ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randrange(2, 9))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(some) for _ in range(rng.randrange(5, words))) for _ in range(n)]


def awkward(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Nulls, empty texts, copies, near copies, shared passages, a very long text, repeated rows, a null id."""
    base = invented(seed, 40)
    passage = " ".join(invented(seed + 1, 1, 400)[0].split()[:60]) or "x"
    passage = passage + " " + " ".join(f"w{i}" for i in range(60))
    texts: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    texts += [(100, None), (101, ""), (102, "   \n\t "), (103, "!!! ???"), (104, "one"), (105, "one"), (106, "Two Words"), (107, "two words")]
    texts += [(200 + k, base[3]) for k in range(6)]
    texts += [(300 + k, base[5] + f" tail{k}") for k in range(4)]
    texts += [(400 + k, f"{base[10 + k]} {passage} {base[20 + k]}") for k in range(5)]
    texts += [(500, " ".join(invented(seed + 2, 300))), (501, "again " * 3000), (600, base[7]), (600, base[7]), (None, base[8] + " null id")]
    return texts


@pytest.fixture(scope="session")
def cases() -> list[tuple[int | None, str | None]]:
    return awkward()


@pytest.fixture(scope="session")
def docs(spark: SparkSession, cases) -> DataFrame:
    return documents(spark, cases).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs: DataFrame) -> DataFrame:
    return docs.where("false")
