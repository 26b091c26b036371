"""Vector codes against SQL, plain Lloyd rounds by brute force, and awkward vectors."""

import hashlib
import math

import numpy as np
import pytest
from tests.compare import same

from docloom.llm import compression, sql
from docloom.llm import queries as llm


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label) in any order; plain Lloyd with Python's whole numbers."""
    good = [(i, [math.floor(256 * x) for x in v], b) for i, v, b in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    width = len(good[0][1]) // parts if good else 0
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def away(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned():
        return [[min(range(len(books[p])), key=lambda e, p=p: (away(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        at = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                held = [c[p] for c, a in zip(cut, at, strict=True) if a[p] == e]
                if held:
                    books[p][e] = tuple(sum(x) // len(held) for x in zip(*held, strict=True))
    at = assigned()
    errors = [sum(away(c[p], books[p][a[p]]) for p in range(parts)) for c, a in zip(cut, at, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    of_label = {}
    for (_, _, b), e in zip(good, errors, strict=True):
        of_label[b] = of_label.get(b, 0) + e
    fit = lambda x: x if abs(x) < 2**63 else None
    return sorted(
        ((i, "".join(f"{x:02x}" for x in a), fit(e), fit(of_label[b]), digest) for (i, _, b), a, e in zip(good, at, errors, strict=True)), key=repr
    )


def check(spark, rows, **parameters):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert sorted(map(tuple, compression.compress(df, **parameters).collect()), key=repr) == brute_codes(rows, **parameters)


def test_codes_match_sql(spark, sf_dir):
    same(spark, sf_dir, llm.op13_codes, sql.OP13)


def test_codes_of_ties_repeats_and_nulls(spark):
    """Few different values, so that distances tie; repeated rows and ids, null ids and labels, unusable vectors."""
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.integers(-3, 3, 32) / 256).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(300)]
    rows += rows[:20] + [(7, rows[3][1], 1), (None, rows[4][1], 2), (None, rows[4][1], 2)]
    rows += [(900, None, 1), (901, [], 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] * 32, 1), (904, [None] * 32, 1), (905, [0.5] * 16, 1), (906, [0.5] * 31, 1)]
    check(spark, rows)
    check(spark, rows, parts=4, entries=7, rounds=4)


def test_codes_of_few_rows_and_none(spark):
    rng = np.random.default_rng(2)
    check(spark, [(int(i), rng.normal(size=16).tolist(), 1) for i in range(5)])
    check(spark, [(1, [0.1] * 16, None)])
    assert compression.compress(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0
    with pytest.raises(ValueError):
        compression.compress(spark.createDataFrame([], "vec_id long, embedding array<double>, label int"), entries=300)


def test_codes_of_large_components_are_exact(spark):
    """Squares beyond 64 bits, and sums of errors that no long holds."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-(2**40), 2**40, 16) * 2.0**s).tolist(), i % 2) for i, s in enumerate([0] * 40 + [-20] * 40 + [-44] * 40)]
    check(spark, rows, entries=8)


def test_clashing_columns(spark):
    rows = [(i, [i / 7 + j for j in range(16)], i % 2) for i in range(40)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    clashing = plain.selectExpr("*", *(f"1 AS {c}" for c in ("vector", "code", "error", "sum", "moved", "rows", "kind")))
    assert sorted(compression.compress(clashing).collect()) == sorted(compression.compress(plain).collect())


def test_heaps_pop_only_what_drift_has_reached():
    """With small drift most parts are never compared again, and the result is that of comparing all."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (20, 32))
    vectors = np.concatenate([c + rng.integers(-30, 30, (100, 32)) for c in centres])
    start = vectors[rng.permutation(len(vectors))[:64]].astype(object)
    books = compression.Codebooks(start.reshape(64, 16, 2).transpose(1, 0, 2), np.zeros((16, 64)))
    heaps, popped = compression.assign(vectors, books), []
    for _ in range(12):
        at = heaps.assigned()
        shape = (16, 64, 3)
        moved = np.array(compression._moved(vectors, None, at, books), dtype=object).reshape(shape)
        books = books.updated(moved[:, :, 0], moved[:, :, 1:])
        heaps, n = compression.reassign(vectors, heaps, books)
        popped.append(n)
        assert (heaps.assigned() == compression.assign(vectors, books).assigned()).all()
    assert popped[-1] < popped[0] and popped[-1] < vectors.shape[0] * 16 / 4
