"""Documents with every awkward case, and plain brute-force helpers."""

import random
import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row int, id string, size int, name string"


def odd_texts() -> list:
    random.seed(5)
    vocabulary = ["alpha", "Beta", "gamma,", "delta", "épsilon", "ZETA", "eta.", "thêta", "iota", "kappa", "lambda", "mu"]
    sentence = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    base = sentence(80)
    long = sentence(30_000)
    near = base.split()
    near[40] = "changed"
    return [
        None, "", "   \n\t", "one", "two words", base, base, base.upper(), " ".join(near), sentence(60), sentence(60), long, long + " tail",
        "tab\tand\x0bvertical\x0cfeeds", "日本語 テスト 漢字 🙂", "a<|endoftext|>b don't I'LL 123 %%%", " nbsp　wide", "x" * 3000, "aaaa aaaa aaaa", "ΑΣ ΣΑΣ İstanbul é",
        "Mail anna.B@mail4.example.com or call +1 (076) 555-8046 now. " + sentence(20),
    ]


def rows_of(texts: list) -> list:
    return [(i, t, ("en", "fr", None)[i % 3], f"src{i % 4}" if i % 5 else None, len(t or ""), "k", i, "i", 1, "n") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """All awkward texts, a repeated row, and a row without an id; columns whose names operators use inside."""
    from statuslake.llm.cluster import ship

    ship(spark)
    rows = rows_of(odd_texts())
    return spark.createDataFrame([*rows, rows[5], (None, "no id here at all", None, None, 1, "k", 0, "i", 1, "n")], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
