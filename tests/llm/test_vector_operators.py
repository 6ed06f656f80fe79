"""Whitening and compression of embeddings, against plain versions."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm.compression import compress, digest, nearest, walsh
from millrace.llm.eigen import below, leading, leading_values, tridiagonal
from millrace.llm.vectors import halves, joined
from millrace.llm.whitening import deviations, whiten

NAN, INF = float("nan"), float("inf")
ROWS = "vec_id long, embedding array<float>, label int, x string, _id int"


def vectors(n, width, seed=1, spread=None):
    pick = random.Random(seed)
    spread = spread or [1 / (1 + i) for i in range(width)]
    return [[pick.gauss(0, s) for s in spread] for _ in range(n)]


def frame(spark, rows, schema=ROWS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], schema)


def whole(vector):
    return [math.floor(256 * float(np.float32(c))) for c in vector]


# --- eigenvalues


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_leading_pairs_of_random_matrices(n):
    a = np.random.Generator(np.random.PCG64(n)).standard_normal((n, n))
    a = a @ a.T
    values, axes = leading(a, 4)
    expected = np.linalg.eigvalsh(a)[::-1][:4]
    assert np.allclose(values, expected, rtol=1e-13, atol=1e-13 * expected[0])
    assert np.allclose(a @ axes, axes * values, atol=1e-12 * expected[0])
    assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-12)


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 5, 1, 1], [3, 3 + 1e-12, 1, 1, 1, 1], [1, 0, 0, 0, 0, 0], [0] * 6, [1e-30] * 6, [1e9, 1e9, 1e-9, 0, 0, 0]])
def test_equal_and_close_eigenvalues_have_orthogonal_vectors(spectrum):
    q, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(3)).standard_normal((6, 6)))
    for a in ((q * spectrum) @ q.T, np.diag(np.array(spectrum, float))):
        values, axes = leading(a, 4)
        assert np.allclose(values, sorted(spectrum, reverse=True)[:4], rtol=1e-9, atol=1e-14 * max(spectrum))
        assert np.allclose(axes.T @ axes, np.eye(4), atol=1e-9)
        assert np.allclose(a @ axes, axes * values, atol=1e-10 * max(max(spectrum), 1e-300))


def test_tridiagonal_form_and_counts():
    a = np.random.Generator(np.random.PCG64(9)).standard_normal((12, 12))
    a = a + a.T
    d, e, q = tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    assert np.allclose(q @ t @ q.T, a) and np.allclose(q @ q.T, np.eye(12))
    expected = np.linalg.eigvalsh(a)
    assert below(d, e, np.array([-100.0, expected[4] + 1e-9, 100.0])).tolist() == [0, 5, 12]
    assert np.allclose(leading_values(d, e, 12), expected[::-1])


# --- whitening


def test_whitening_agrees_with_a_plain_version(spark):
    data = vectors(300, 8)
    rows = [(i, v, 0) for i, v in enumerate(data)] + [(i, data[0], None) for i in range(500, 650)]  # a third are copies
    odd = [(None, data[3], 1), (7, data[7], 1), (900, None, 0), (901, [*data[1][:7], None], 0), (902, [*data[1][:7], NAN], 0), (903, [-INF, *data[1][1:]], 0)]
    found = whiten(frame(spark, rows + odd)).collect()
    x = {i: whole(v) for i, v, _ in rows} | {None: whole(data[3])}
    fit = np.array(sorted({tuple(v) for v in x.values()}), float)
    n, mean = len(fit), fit.mean(0)
    spread = (fit - mean).T @ (fit - mean) / n
    values, axes = np.linalg.eigh(spread)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(found) == 4 * (len(rows) + 2) and {r.component for r in found} == {1, 2, 3, 4}
    signs = {}
    total = [sum(int(v[i]) for v in fit) for i in range(8)]
    for r in found:
        k, own = r.component - 1, x[r.vec_id]
        expected = (np.array(own) - mean) @ axes[:, k] / math.sqrt(values[k])
        sign = signs.setdefault(k, 1 if r.whitened * expected > 0 else -1)
        assert r.whitened == pytest.approx(sign * expected, rel=1e-9, abs=1e-9)
        assert r.n == n and int(r.deviation) == sum((n * a - s) ** 2 for a, s in zip(own, total))
        assert r.explained == pytest.approx(values[k] / np.trace(spread), rel=1e-9)
        assert r.identity_error < 1e-9


def test_whitening_of_few_equal_ragged_and_no_vectors(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None, 0), (2, [], 0)])).collect() == []
    one = whiten(frame(spark, [(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0)])).collect()
    assert [(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [
        (i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)
    ]
    two = whiten(frame(spark, [(1, [1.0, 0.0, 0.0], 0), (2, [0.0, 0.0, 0.0], 0), (3, [0.0], 0)])).collect()
    assert sorted((r.vec_id, r.component, r.whitened) for r in two if r.component == 1) == [(1, 1, 1.0), (2, 1, -1.0), (3, 1, -1.0)]
    assert all(r.whitened is None and r.explained == 0 for r in two if r.component > 1)
    assert {r.identity_error for r in two} == {0.0}


def test_sums_beyond_a_long_stay_exact(spark):
    big = np.array([[1 << 62, -(1 << 63)], [(1 << 63) - 1, 5]])
    sums = [int(big[0, 0]) + int(big[1, 0]), int(big[0, 1]) + 5]
    assert deviations(big, 2, sums) == [sum((2 * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in big]
    small = np.array([[3, -4, 100], [0, 7, -90]])
    for sums in ([10**15, -(10**14), 7], [0, 0, 0]):
        assert deviations(small, 10**12, sums) == [sum((10**12 * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in small]
    high, low = halves(big.reshape(-1))
    assert [joined(h, v) for h, v in zip(high, low)] == big.reshape(-1).tolist()
    rows = whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.n for r in rows} == {3} and all(r.deviation is None or r.deviation > 0 for r in rows)


# --- compression


def plain_nearest(part, book):
    distance = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in book]
    return distance.index(min(distance)), min(distance)


def plain_compression(rows, parts, entries, rounds):
    """rows: (id, label, whole numbers of one length)."""
    size = len(rows[0][2]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, _, v in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))[:entries]
    books = [[list(cut[i][p]) for i in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[plain_nearest(c[p], books[p])[0]].append(c[p])
            for e, m in members.items():
                books[p][e] = [sum(x) // len(m) for x in zip(*m)]
    out, by_label = [], defaultdict(int)
    for (i, label, _), c in zip(rows, cut):
        near = [plain_nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for e, _ in near), sum(d for _, d in near)))
        by_label[label] += out[-1][3]
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return sorted(((*r, by_label[r[1]]) for r in out), key=str), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("width", "parts", "entries"), [(16, 4, 8), (12, 4, 5), (16, 16, 64), (10, 2, 256)])
def test_compression_agrees_with_a_plain_version(spark, width, parts, entries):
    data = vectors(150, width, seed=width, spread=[0.05] * width)
    rows = [(i, v, i % 3 if i % 7 else None) for i, v in enumerate(data)] + [(1000 + i, data[5], 9) for i in range(80)]
    rows += [(None, data[9], 1), (3, data[3], 2), (3, data[4], 2), (2000, [0.0] * width, 0)]
    odd = [(5000, None, 0), (5001, [NAN, *data[0][1:]], 0), (5002, [None, *data[0][1:]], 0), (5003, [INF, *data[0][1:]], 0)]
    coded, books = compress(frame(spark, rows + odd), parts=parts, entries=entries)
    expected, sha = plain_compression([(i, label, whole(v)) for i, v, label in rows], parts, entries, 2)
    assert sorted((tuple(r) for r in coded.collect()), key=str) == expected
    assert digest(books) == sha


def test_compression_of_few_ragged_and_no_vectors(spark):
    coded, books = compress(frame(spark, []))
    assert coded.collect() == [] and books.size == 0 and digest(books) == hashlib.sha256(b"").hexdigest()
    coded, books = compress(frame(spark, [(1, [], 0)]))
    assert [tuple(r) for r in coded.collect()] == [(1, 0, "00" * 16, 0, 0)]
    coded, books = compress(frame(spark, [(2, [1.0], 0), (1, [1.0, 0.5, 0.25], None)]), parts=2)
    assert books.shape == (2, 2, 2)
    assert sorted(tuple(r) for r in coded.collect()) == [(1, None, "0000", 0, 0), (2, 0, "0101", 0, 0)]
    with pytest.raises(ValueError, match="256"):
        compress(frame(spark, []), entries=257)


def test_walsh_rows_are_orthogonal_and_in_order_of_sequency():
    for m in (1, 2, 8, 32):
        h = walsh(m)
        assert (h @ h.T == m * np.eye(m, dtype=int)).all()
        assert [(r[1:] != r[:-1]).sum() for r in h] == list(range(m))


def test_nearest_entry_with_ties_and_huge_numbers():
    entries = np.array([[5, 5, 5], [1, 2, 3], [1, 2, 3], [0, 0, 0]])
    parts = np.array([[1, 2, 3], [0, 1, 1], [3, 3, 4], [4, 4, 4], [0, 0, 0]])
    for scale in (1, 1 << 58):
        index, distance = nearest(parts * scale, entries * scale)
        plain = [plain_nearest([int(x) * scale for x in p], [[int(x) * scale for x in e] for e in entries]) for p in parts]
        assert list(zip(index.tolist(), [int(d) for d in distance])) == plain


def test_errors_beyond_a_long_are_null(spark):
    rows = [(1, [1e300], 0), (2, [-1e300], 0), (3, [0.0], 1)]
    coded, _ = compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=1, parts=1, rounds=0)
    found = {r.vec_id: r for r in coded.collect()}
    assert found[1].error == 0 and found[2].error is None and found[3].error is None and found[1].label_error is None
