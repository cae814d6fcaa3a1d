"""Vector codes against plain k-means over Python integers."""

import hashlib
import math

import numpy as np
import pytest

from lodestone.llm import ballcode

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x string"


def brute(rows, parts=8, entries=16, rounds=6):
    """{(id, vector): ...} is no key where rows repeat, so a sorted list of (id, code, error, label_error, digest)."""
    kept = [(i, v, c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    ints = [[math.floor(4096 * float(np.float32(x))) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[r[p * width : (p + 1) * width] for p in range(parts)] for r in ints]
    books = [[r[p] for r in cut[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(r[p], books[p])[1] for r in cut]
            for j in range(len(books[p])):
                mine = [r[p] for r, a in zip(cut, at, strict=True) if a == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[nearest(r[p], books[p]) for p in range(parts)] for r in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, c), e in zip(kept, errors, strict=True):
        by_label[c] = by_label.get(c, 0) + e
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), e, by_label[c], digest) for (i, _, c), f, e in zip(kept, found, errors, strict=True)), key=repr)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, c, "c", "x") for i, v, c in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, ballcode.code_report(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(ballcode, "BLOCK_ROWS", 37)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    rows = [(int(i), [float(x) for x in (centres[rng.integers(12)] + rng.normal(size=24) * 0.1).astype(np.float32)], int(rng.integers(4)) or None) for i in rng.permutation(400)]
    assert run(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rng = np.random.default_rng(4)
    grid = [(100 + i, [float(x) for x in rng.integers(-2, 3, 11) / 4096], i % 3) for i in range(60)]  # many ties and equal entries
    rows = grid + grid[:5] + [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan")] * 11, 1), (4, [float("inf")], None), (5, [], None), (6, [0.5], None), (None, [1e3] * 11, None), (None, [-1e3] * 11, 2), (7, [0.25] * 19, 2)]
    assert run(spark, rows) == brute(rows)
    few = [(3, [0.1, -0.1], 1), (2, [5.0, 1.0], None), (9, [0.1, 0.1], 1)]
    assert run(spark, few) == brute(few)
    huge = [(i, [3e38 * (-1) ** i] * 8, 1) for i in range(20)]
    assert len(run(spark, huge)) == 20
    assert run(spark, [(1, None, 1)]) == [] == run(spark, [])


@pytest.mark.parametrize("seed", range(20))
def test_balls_equal_full_search(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-9, 9, (500, 2 + seed % 3))
    book = rng.integers(-9, 9, (16, x.shape[1]))
    home, d = ballcode.assign_all(x, book)
    radius = np.array([d[home == a].max(initial=0) for a in range(16)])
    for _ in range(6):
        new = book + (rng.random((16, 1)) < 0.3) * rng.integers(-2, 3, book.shape)
        moved = (new != book).any(axis=1)
        at, radius = ballcode.assign_balls(x, home, new, moved, radius)
        want, d = ballcode.assign_all(x, new)
        assert (at == want).all() and all(radius[a] >= d[at == a].max(initial=0) for a in range(16))
        home, book = at, new
