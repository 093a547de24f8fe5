"""Odd rows that every operator is tried on."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, kept boolean, target double"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names the operators' results use."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 6)))
    long = " ".join(word() for _ in range(60_000))
    lines = ["one two three", "four five six", "seven eight nine", "ten"]
    texts = [None, "", " \t\n", "a", "a b c", "\n".join(lines), "x\n" + "\n".join(lines), long, long + " tail", "Dup text here now", "Dup text here now", "é ü 中文 \U0001f600 end"]
    texts += [" ".join(word() for _ in range(40)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t), 7, 0.5, True, 1.0) for i, t in enumerate(texts)]
    rows += [rows[9], (None, "no id here at all", None, None, 1, 1, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
