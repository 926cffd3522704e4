from __future__ import annotations

import random

import pytest

from creditloom.llm.common import importable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, length string"


@pytest.fixture(scope="session")
def texts(spark):
    """Odd texts: null, empty, blank, short, repeated, periodic, near and exact copies, shared passages, a long one."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 7))) for _ in range(300)] + ["the", "of", "and", "is"] * 25
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, passage = prose(220), prose(90)
    out = [None, "", " \n\t ", "one", "One two", "one two", "a b c d e", "A B C D E", "a b c d e f"]
    out += [base, base, base.upper(), base + " tail", base + " " + prose(20), base + " " + prose(200)]
    out += [base[:300] + "ø" + base[300:], passage + " " + prose(60), prose(60) + "\n" + passage, passage]
    out += ["x" * 900, "xy" * 700, "ab cd " * 300, "ab cd " * 300 + prose(30)]
    out += ["Licensed under CC BY-NC 4.0. " + prose(20), "released under teh MIT license " + prose(9)]
    out += [prose(rng.randint(1, 40)) for _ in range(30)] + [prose(300) for _ in range(5)]
    out += [" ".join([prose(3000), passage, "日本語   \x1c it's", prose(3000)])]
    copies = base.split()
    for i in range(25):
        words = list(copies)
        for _ in range(rng.choice([0, 1, 2, 9, 30])):
            words[rng.randrange(len(words))] = f"edit{i}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """``texts`` under ids with gaps, with repeated rows, null ids and extra columns of clashing names and types."""
    importable(spark)
    rows = [(3 * i, t, None, None if i % 5 else "s", None, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[9], rows[0], (None, texts[9], "en", "s", 1, "x", "y", "z"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def empty(spark):
    importable(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain(docs):
    """(doc_id, text) of all rows."""
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def multiset():
    from collections import Counter

    return lambda df, *columns: Counter(tuple(r) for r in df.select(*columns).collect())
