"""Vector codes against a brute-force version."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from codeweft.llm.vector_codes import encode_vectors, fit_codebooks, largest, nearest, search_order, vector_codes

SHAPE = "vec_id long, embedding array<float>, label int, code string, error int"


def brute(rows, rounds=4, parts=4, entries=256):
    """(vec_id, label, code, error) and the codebooks' digest, by definition."""
    kept = sorted((i, [int(np.floor(np.float64(x) * 1024)) for x in v], label) for i, v, label in rows)
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    find = lambda v, p: min((apart(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        met = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                met[p][find(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(met[p][e]) for c in zip(*met[p][e])] if e in met[p] else old for e, old in enumerate(books[p])] for p in range(parts)]
    out = []
    for i, v, label in kept:
        best = [find(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def vectors(n, dim, seed):
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.choice((r.gauss(0, 0.2), 0.25, -0.5)))) for _ in range(dim)], r.choice((None, 0, 1))) for i in range(n)]
    return [*rows, *[(n + i, v, 1) for i, v, _ in rows[: n // 3]]]  # a third again: ties


def test_against_brute_force(spark):
    rows = vectors(280, 24, 1)
    dirty = [(1000, None, 0), (1001, [None] * 24, 0), (1002, [float("nan")] + [0.0] * 23, 0), (1003, [float("-inf")] + [0.0] * 23, 1)]
    odd = [(1004, [0.5] * 20, 1), (1005, [], 0), (1006, [1e30] + [0.0] * 23, 0), (1007, [-1e30] * 24, 0)]
    table = spark.createDataFrame([(*r, "x", 7) for r in rows + dirty + odd], SHAPE).repartition(3)
    got = {r.vec_id: r for r in vector_codes(table).collect()}
    want, digest = brute(rows)
    assert set(got) == {r[0] for r in rows} | {1004, 1005, 1006, 1007}
    total = defaultdict(int)
    for _, label, _, error in want:
        total[label] += error
    for i, label, code, error in want:
        assert tuple(got[i]) == (i, label, code, error, total[label], digest)
    for i in (1004, 1005, 1006, 1007):  # can't be coded with these codebooks
        assert got[i].code is None and got[i].error is None


def test_nearest_matches_whole_distances():
    r = np.random.default_rng(5)
    for width, reach in ((1, 3), (3, 2), (16, 700), (33, 2**22)):
        block, book = r.integers(-reach, reach, (700, width)), r.integers(-reach, reach, (256, width))
        whole = ((block[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        entries, apart = nearest(block, book)
        assert (entries == whole.argmin(axis=1)).all() and (apart == whole.min(axis=1)).all()


def test_order_of_dimensions():
    assert search_order(np.array([[0, 5, 1], [0, -5, 2], [0, 9, 1]])).tolist() == [1, 2, 0]
    assert (2 * largest(64)) ** 2 * 64 < 2**63


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert vector_codes(empty).collect() == [] and fit_codebooks(empty) is None
    # Nothing that can be cut into four parts: rows stay, codes are null.
    short = spark.createDataFrame([(1, [1.0, 2.0], 0, "", 0), (2, [], None, "", 0)], SHAPE)
    assert {r.vec_id: r.code for r in vector_codes(short).collect()} == {1: None, 2: None}
    # Repeated and null ids are vectors of their own; columns pass.
    some = spark.createDataFrame([(None, [0.0, 0.0, 0.0, 4.0], 1, "a", 1), (3, [1.0, 2.0, 3.0, 4.0], 1, "b", 2), (3, [1.0, 2.0, 3.0, 4.0], 1, "c", 3)], SHAPE)
    books = fit_codebooks(some, rounds=1)
    assert [b[:, 0].tolist() for b in books.books] == [[1024, 1024, 0], [2048, 2048, 0], [3072, 3072, 0], [4096, 4096, 4096]]
    coded = encode_vectors(some, books)
    assert coded.columns == ["vec_id", "embedding", "label", "code", "error"]
    assert sorted((r.vec_id or 0, r.code, r.error) for r in coded.collect()) == [(0, "02020200", 0), (3, "00000000", 0), (3, "00000000", 0)]
