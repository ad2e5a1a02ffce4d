import numpy as np
import pytest

from keystrata.llm import ann

SHAPE = "vec_id long, embedding array<float>, vector string, found int"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "v", 1) for i, x in rows], SHAPE)


def brute(rows, top):
    keep = {}
    for i, x in rows:
        if i is not None and x is not None and len(x) == 8 and all(c is not None and np.isfinite(c) for c in x) and any(x):
            keep[i] = np.array(x, np.float32).astype(float)
    out = {}
    for q in keep:
        if q % 5 == 0:
            score = {i: 0.0 for i in keep if i != q}
            for i in score:
                for a, b in zip(keep[q], keep[i]):
                    score[i] += a * b
            best = sorted(score, key=lambda i: (-score[i], i))[:top]
            out[q] = [(r + 1, i, score[i]) for r, i in enumerate(best)]
    return out


def found(df, **more):
    out = {}
    for r in ann.nearest(df, "vec_id % 5 = 0", **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_exact_where_the_shortlist_holds_all(spark):
    rng = np.random.default_rng(1)
    same = [float(x) for x in rng.normal(size=8).astype(np.float32)]
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(90)] + [(i, same) for i in range(100, 140)]
    rows += [(200, None), (205, [0.0] * 8), (210, [float("nan")] + [1.0] * 7), (215, [float("inf")] + [1.0] * 7), (220, [1.0] * 5), (None, same), (225, [None] + [1.0] * 7)]
    assert found(frame(spark, rows), top=6, rerank=200, block=32, query_block=7) == brute(rows, 6)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_large_small_and_mixed_magnitudes(spark, most):
    """Finite vectors of any magnitude are candidates; fewer than `top` give all of them."""
    rng = np.random.default_rng(5)
    draw = lambda i, scale: (i, [float(x) for x in (rng.normal(size=8) * scale).astype(np.float32)])
    for scales in ([1e20] * 5, [1e-30] * 5, [1e37, 1e-37, 1.0, 1e20, 1e-20]):
        rows = [draw(i, s) for i, s in enumerate(scales)]
        got = found(frame(spark, rows), most_broadcast=most)
        assert got == brute(rows, 20) and {len(x) for x in got.values()} == {4}
    rows = [draw(i, 10.0 ** rng.integers(-37, 37)) for i in range(300)] + [draw(i, 1.0) for i in range(300, 600)] + [draw(-i, 3.0) for i in range(1, 20)]
    got, want = found(frame(spark, rows), top=10, block=64, rerank=32, most_broadcast=most), brute(rows, 10)
    assert sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want) >= 0.98 * 10 * len(want)


def test_doubles_that_overflow_are_ranked(spark):
    rows = [(0, [1e300] * 8), (5, [1e300] * 8), (7, [1.0] * 8), (8, [-1e300] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(df, "vec_id = 0").orderBy("rank").collect()] == [(0, 5), (0, 7), (0, 8)]


def test_recall_at_several_thousand(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 32)) * rng.gamma(4.0, size=(6000, 1))
    rows = [(i, [float(v) for v in y]) for i, y in enumerate(x.astype(np.float32))]
    x = x.astype(np.float32).astype(float)
    near = x[::50] @ x.T
    near[np.arange(120), np.arange(0, 6000, 50)] = -np.inf
    want = {q * 50: set(np.argsort(-near[q], kind="stable")[:20].tolist()) for q in range(120)}
    for most in (1 << 25, 0):
        got = {}
        for r in ann.nearest(frame(spark, rows), "vec_id % 50 = 0", most_broadcast=most).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        recall = sum(len(got[q] & want[q]) for q in want) / (20 * len(want))
        print("recall", recall)
        assert recall >= 0.95


def test_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8))
    rows = [(i, [float(x) for x in (centres[i % 20] + 0.4 * rng.normal(size=8)).astype(np.float32)]) for i in range(1500)]
    got, want = found(frame(spark, rows), top=10), brute(rows, 10)
    assert sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_many_copies_do_not_crowd_the_shortlist(spark):
    rng = np.random.default_rng(7)
    same = [float(x) for x in rng.normal(size=8).astype(np.float32)]
    rows = [(i, same if i % 3 else [float(x) for x in (same + 0.3 * rng.normal(size=8)).astype(np.float32)]) for i in range(900)]
    got, want = found(frame(spark, rows), top=10, rerank=128), brute(rows, 10)
    assert sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want) >= 0.95 * 10 * len(want)


def test_few_repeated_and_empty(spark):
    rows = [(0, [1.0] * 8), (5, [2.0] * 8), (5, [2.0] * 8), (7, [1.0] * 8)]
    assert found(frame(spark, rows)) == {0: [(1, 5, 16.0), (2, 7, 8.0)], 5: [(1, 0, 16.0), (2, 7, 16.0)]}
    assert found(frame(spark, [])) == {} and found(frame(spark, [(0, None)])) == {}


def test_parallel_error_falls():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    score_aware, plain = ann.Quantizer.fit(x), ann.Quantizer.fit(x, threshold=0.0)
    assert plain.eta == 1 and score_aware.eta == max(1, 15 * 0.04 / 0.96) or score_aware.eta >= 1
    strong = ann.Quantizer.fit(x, threshold=0.6)

    def parallel(model):
        code = model.codes(x)
        back = np.stack([model.centres[m][code[:, m]] for m in range(code.shape[1])], 1).reshape(len(x), -1)[:, :16]
        return np.mean((((x - back) * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2)

    assert parallel(strong) < 0.7 * parallel(plain)


def test_scan_equals_decoding():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 10))
    model = ann.Quantizer.fit(x)
    code, q = model.codes(x), rng.normal(size=(5, 10))
    back = np.stack([model.centres[m][code[:, m]] for m in range(code.shape[1])], 1).reshape(len(x), -1)[:, :10]
    assert model.scan(q, model.packed(x)) == pytest.approx(q @ back.T, abs=1e-4)


def test_shortlist_ties():
    assert ann.shortlist(np.array([[1.0, 2.0, 2.0, 2.0, 0.0]]), 2).tolist() == [[1, 2]]
    assert ann.shortlist(np.array([[1.0, 2.0]]), 5).tolist() == [[0, 1]]
