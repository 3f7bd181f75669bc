import random

import pytest

from plain import SF


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and long texts, ties, copies, near copies, shared lines, repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 120)
    line = "A shared line that is long enough to be counted, Ünïcode too"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, base), (7, base), (8, base.upper()), (9, base + " x"),
            (10, prose(rng, 30_000)), (10, prose(rng, 30_000)), (11, base), (11, base), (None, base), (None, None)]
    for i in range(12, 40):
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w) + f"\n {line if i % 2 else line.lower()}\t\n" + prose(rng, i)))
    rows += [(i, f"{line}\n{prose(rng, 60)}\n\n{line}") for i in range(40, 70)]
    rows += [(i, f"{line}\nmore of this boilerplate line which every page has at its end {'x' * 40}") for i in range(70, 100)]
    rows += [(100, "É é " * 40), (101, "a b c " * 40), (102, "\x00nul\x1f sep " + base)]
    # Near copies whose smallest id fails the word rules, in each of two hosts.
    page = "\n".join(" ".join(f"l{k}w{j}" for j in range(12)) for k in range(4))
    rows += [(i, f"{page}\nx{i}") for i in (103, 104)] + [(i, f"{page}\nmore y{i} z{i}") for i in range(105, 123)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with more columns, some of them named like the operators' own."""
    rows = [(d, t, f"h{(d or 0) % 2}", i, "x") for i, (d, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, h string").repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_words long, h string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(4).cache()


@pytest.fixture(scope="session")
def document_rows(documents):
    return [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
