"""Operators on vectors: product codes and whitening, against plain versions."""

import hashlib

import numpy as np
import pytest

from readqc.llm import vector_codes, whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string, n string"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, v, label) to codes by comparing all parts with all entries."""
    rows = sorted(((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in rows]).reshape(len(rows), parts, -1)
    books = x[:entries].swapaxes(0, 1).copy()
    for last in [*[False] * rounds, True]:
        far = np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(-1) for p in range(parts)], 1)
        code, least = far.argmin(2), far.min(2).sum(1)
        if not last:
            for p in range(parts):
                for e in set(code[:, p]):
                    books[p, e] = np.floor_divide(x[code[:, p] == e, p].sum(0), (code[:, p] == e).sum())
    by_label = {}
    for r, e in zip(rows, least):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return sorted(((r[0], r[2], "".join(f"{c:02x}" for c in cs), int(e), by_label[r[2]], digest) for r, cs, e in zip(rows, code, least)), key=str)


def coded(df, **options):
    return sorted((tuple(r) for r in vector_codes.encode(df, **options).collect()), key=str)


def test_codes_plain(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert coded(df) == plain_codes([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_codes_odd_rows(spark):
    """Ties (coarse components), copies, shared and null ids, null labels, unusable vectors, clashing names, a hot label."""
    rng = np.random.default_rng(5)
    good = [(int(i) if i % 9 else None, [float(x) for x in rng.integers(-3, 3, 32) / 256], [None, 7, 7, 7][i % 4]) for i in range(400)]
    good += [(5, good[7][1], 7)] * 40
    bad = [(1000, None), (1001, []), (1002, [1.0] * 31 + [None]), (1003, [float("nan")] * 32), (1004, [float("inf")] * 32), (1005, [0.5] * 16)]
    rows = [(i, v, lab, "v", "code", "n") for i, v, lab in good] + [(i, v, 1, None, None, None) for i, v in bad]
    assert coded(spark.createDataFrame(rows, SCHEMA).repartition(7)) == plain_codes(good)
    assert coded(spark.createDataFrame(rows[:20], SCHEMA)) == plain_codes(good[:20])


def test_codes_empty_and_wrong(spark):
    out = vector_codes.encode(spark.createDataFrame([(1, None, 1, "", "", "")], SCHEMA))
    assert out.count() == 0 and out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vector_codes.encode(spark.createDataFrame([(1, [1.0] * 17, 1, "", "", "")], SCHEMA))


def test_exponion_scans_less_and_finds_the_nearest():
    """The search visits a part of the entries only, from any start, and equals the full comparison with ties."""
    rng = np.random.default_rng(0)
    books = rng.integers(-40, 40, (2, 64, 3))
    books[0, 9] = books[0, 4]
    x = np.concatenate([rng.integers(-40, 40, (500, 3)), books[0]])
    lists = vector_codes.Lists(books)
    far = ((x[:, None] - books[0][None]) ** 2).sum(-1)
    for start in (0, 9, 63):
        best, least = lists.nearest(x, np.full(len(x), start))
        assert (best == far.argmin(1)).all() and (least == far.min(1)).all()
    u = far.min(1)
    assert (lists.apart[far.argmin(1)] <= 4 * u[:, None]).mean() < 0.5


def plain_whitening(rows, most=16):
    """{vec_id: [(component, n, deviation, whitened, explained)]} of (vec_id, v), signs as they come."""
    x = {i: [int(np.floor(64 * float(np.float32(c)))) + 10**6 for c in v] for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, s = len(fit), [int(c) for c in fit.sum(0)]
    centred = fit - fit.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    out = {}
    for i, v in x.items():
        deviation = sum((n * c - t) ** 2 for c, t in zip(v, s))
        y = np.array([(n * c - t) / n for c, t in zip(v, s)])
        out[i] = [(k + 1, n, deviation, float(y @ axes[:, j] / np.sqrt(values[j])), float(values[j] / values.sum())) for k, j in enumerate(order)]
    return out


def same_whitening(got, want):
    assert len(got) == sum(map(len, want.values()))
    signs = {}
    for r in got:
        k, n, deviation, whitened, explained = want[r.vec_id][r.component - 1]
        assert (r.component, r.n, r.deviation) == (k, n, deviation)
        assert abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-9
        if abs(whitened) > 1e-3:
            signs.setdefault(k, np.sign(r.whitened * whitened))
        assert abs(r.whitened * signs.get(k, 1) - whitened) < 1e-6


def test_whitening_plain(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    same_whitening(whitening.whiten(df).collect(), plain_whitening([(r.vec_id, r.embedding) for r in df.collect()]))


def test_whitening_odd_rows(spark):
    """Many copies weigh once; unusable vectors and clashing names; fewer dimensions than components."""
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(size=6) * [1, 2, 3, 4, 5, 6]]) for i in range(300)]
    copies = [(1000 + i, good[5][1]) for i in range(900)]
    bad = [(5000, None), (5001, []), (5002, [1.0, None] * 3), (5003, [float("nan")] * 6), (5004, [float("-inf")] * 6), (5005, [1.0] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "v", "code", "n") for i, v in good + copies + bad], SCHEMA).repartition(5)
    same_whitening(whitening.whiten(df).collect(), plain_whitening(good + copies))
    shared = spark.createDataFrame([(i, v, 1, "", "", "") for i, v in [(None, good[0][1]), (3, good[1][1]), (3, good[2][1]), (3, good[2][1])]], SCHEMA)
    out = whitening.whiten(shared).collect()
    assert len(out) == 4 * 2 and {r.n for r in out} == {3}  # three distinct vectors span two directions


def test_whitening_without_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25], 1, "", "", "") for i in range(9)], SCHEMA)).count() == 0


def test_deviation_beyond_64_bits():
    x = np.array([[10**6 + 2**20, 10**6], [10**6, 10**6]])
    n, s = 10**6, np.array([10**12, 10**12])
    assert whitening._deviation(x, n, s) == [None, 0] and whitening._deviation(x, 10**3, s // 10**3) == [(2**20 * 10**3) ** 2, 0]


def test_moments_merge():
    y = np.random.default_rng(1).normal(size=(500, 4)) + 1e6
    whole, parts = whitening.Moments.of(y), whitening.Moments.of(y[:3]) + whitening.Moments.of(y[3:200]) + whitening.Moments.of(y[200:])
    assert parts.n == 500 and np.allclose(parts.mean, whole.mean) and np.allclose(parts.outer, whole.outer)
