"""Vector codes (12) against plain Lloyd rounds on Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from headline_engine.llm import vectorcodes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int, kind int, state string"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, vector, label) -> ({(vec_id, vector): (code, error)}, books)."""
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v), l) for i, v, l in rows
            if v is not None and len(v) and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    ids = sorted({i for i, _, _ in kept if i is not None})
    size = len(min((i, v) for i, v, _ in kept if i is not None)[1])
    kept = [r for r in kept if len(r[1]) == size]
    ids = sorted({i for i, _, _ in kept if i is not None})[:entries]
    w = size // parts
    cut = lambda v, q: v[q * w : q * w + w]
    books = [[cut(min(v for j, v, _ in kept if j == i), q) for i in ids] for q in range(parts)]
    near = lambda p, c: min((sum((a - b) ** 2 for a, b in zip(p, e)), k) for k, e in enumerate(c))
    for r in range(rounds + 1):
        got = [[near(cut(v, q), books[q]) for q in range(parts)] for _, v, _ in kept]
        if r == rounds:
            break
        for q in range(parts):
            for k in range(len(books[q])):
                mine = [cut(v, q) for (_, v, _), g in zip(kept, got) if g[q][1] == k]
                if mine:
                    books[q][k] = tuple(sum(col) // len(mine) for col in zip(*mine))
    by = {}
    for (_, _, l), g in zip(kept, got):
        by[l] = by.get(l, 0) + sum(d for d, _ in g)
    text = ",".join(str(x) for c in books for e in c for x in e)
    return sorted(((i is None, i or 0, "".join(f"{k:02x}" for _, k in g), sum(d for d, _ in g), by[l]) for (i, _, l), g in zip(kept, got))), hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "clash", 1, 2, "s") for i, v, l in rows], SCHEMA).repartition(4)


def got(df):
    out = df.collect()
    assert len({r["codebooks_sha256"] for r in out}) <= 1
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in out), (out[0]["codebooks_sha256"] if out else None)


def vectors(n, dim, seed, spread=0.2):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(12, dim))
    v = (centre[rnd.integers(0, 12, n)] + spread * rnd.normal(size=(n, dim))).astype(np.float32)
    return [(int(i), v[i].tolist(), int(i % 5)) for i in range(n)]


def test_codes_equal_plain_rounds(spark):
    rows = vectors(700, 8, 1)
    assert got(V.report(spark, frame(spark, rows))) == plain(rows)


def test_ties_odd_rows_and_hot_copies(spark):
    rows = [(i * 3 - 50, [float(x) / 2 for x in ((i * 7) % 5, (i * 3) % 4, i % 3, -(i % 2))], None if i % 7 == 0 else i % 3) for i in range(300)]  # many ties
    rows += [(1000 + i, rows[0][1], 9) for i in range(300)]
    rows += [(5, None, 1), (6, [1.0, None, 0.0, 0.0], 1), (7, [1.0, float("nan"), 0.0, 0.0], 1), (8, [float("inf"), 0.0, 0.0, 0.0], 1), (9, [], 1),
             (11, [1.0, 2.0, 3.0], 1), (12, [1.0] * 8, 1), (2013, [3e38, 0.0, 0.0, 0.0], 1), (None, [0.5, 0.5, 0.5, 0.5], 2), rows[4], rows[4]]
    want = plain([r for r in rows if r[0] != 2013])  # too large for a long
    assert got(V.report(spark, frame(spark, rows))) == want


def test_fewer_vectors_than_entries_and_none(spark):
    rows = vectors(5, 4, 3)
    assert got(V.report(spark, frame(spark, rows))) == plain(rows)
    assert V.report(spark, frame(spark, rows).limit(0)).count() == 0
    assert got(V.report(spark, frame(spark, rows[:1]))) == plain(rows[:1])


@pytest.mark.parametrize("first", [2, 8, 32])
def test_any_list_length_gives_the_same_codes(spark, first):
    df = frame(spark, vectors(500, 16, 4, 0.05))
    a = V.compress(df, first_b=first, rounds=6)
    b = V.compress(df, first_b=4, rounds=6)
    assert (a.books == b.books).all()
    assert a.frame.select("vec_id", "code", "error").exceptAll(b.frame.select("vec_id", "code", "error")).count() == 0


def test_bounds_spare_searches_and_lists_adapt(spark):
    got = V.compress(frame(spark, vectors(4000, 16, 5, 0.05)), rounds=8)
    first, last = got.depths[0], got.depths[-1]
    assert first[-1] == first.sum() == 4 * 4000  # the first round searches all
    assert last[0] > 0.5 * last.sum() and last[-1] < 0.25 * last.sum()
    assert len(set(got.lists)) > 1


def test_large_integers_are_exact():
    rnd = np.random.default_rng(6)
    x, c = rnd.integers(-(1 << 27), 1 << 27, (50, 4)), rnd.integers(-(1 << 27), 1 << 27, (9, 4))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in c] for p in x]
    assert V.squared(x, c).tolist() == want
    assert V.largest(4) >= 1 << 27


def test_next_b():
    d = np.zeros(V.MOST_B + 2, np.int64)
    d[0], d[3], d[6], d[-1] = 9000, 990, 10, 1
    assert V.next_b(8, d) == 4 and V.next_b(5, d) == 3 and V.next_b(2, d) == 2
    d[-1] = 500
    assert V.next_b(8, d) == 8
    d[-1] = 5000
    assert V.next_b(8, d) == 16 and V.next_b(32, d) == 32
