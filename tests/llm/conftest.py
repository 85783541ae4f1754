import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, pos int, _shard int"


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}" if rnd.random() < 0.9 else rnd.choice(["Ñu", "été", "ÜBER", "a-b", "x.", "“q”"]) for _ in range(n)]


def corpus(seed=7):
    """Odd documents: nulls, empty and very long texts, repeated rows and ids, copies, shared passages and lines."""
    rnd = random.Random(seed)
    shared = " ".join(words(rnd, 70))
    block = "\n".join(" ".join(words(rnd, 6)) for _ in range(9))
    texts = []
    for i in range(40):
        w = words(rnd, rnd.choice([1, 3, 4, 9, 49, 50, 51, 120, 300]))
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = shared.split()
        if i % 9 == 0:
            w = w[: len(w) // 2] + ["\n" + block + "\n"] + w[len(w) // 2 :]
        texts.append(" ".join(w))
    base = " ".join(words(rnd, 200, 5000))
    for i in range(30):  # near copies
        w = base.split()
        for _ in range(i % 4):
            w[rnd.randrange(len(w))] = f"edit{rnd.randrange(99)}"
        texts.append(" ".join(w))
    texts += ["", " \n\t ", "!!! ...", None, "a", "a", "one two three four", base.upper(), "x " * 3000, "\n\n\n", "a  b\r\nc", "漢字 かな 漢字"]
    texts.append(" ".join(words(rnd, 20000)))  # very long
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (rows[5][0], "another text of the same id"), (None, texts[0]), (None, None), (None, "null id")]
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    return corpus()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), "clash", 1, 2) for i, t in odd_rows]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
