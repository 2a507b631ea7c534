import numpy as np
import pytest

from docquarry.functions.vector import walsh_hadamard
from docquarry.operators import vectors as X
from docquarry.queries import _QUERY

RNG = np.random.default_rng(1)
POINTS = RNG.standard_normal((400, 32))
POINTS /= np.linalg.norm(POINTS, axis=1)[:, None]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(POINTS)], "vec_id long, embedding array<float>")


def best(query, k, metric):
    s = POINTS @ query if metric != "l2" else -np.linalg.norm(POINTS - query, axis=1)
    return set(np.argsort(-s, kind="stable")[:k].tolist())


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_recall(table, metric):
    q = X.Quantizer(32)
    coded, bytes_ = X.quantized(table, q).cache(), X.with_int8(table).cache()
    hits = {"exact": 0, "int8": 0, "codes": 0}
    for query in POINTS[:5] + 0.05:
        want = best(query, 10, metric)
        for name, df in (("exact", X.exact(table, query, 10, metric=metric)), ("int8", X.int8_search(bytes_, query, 10, metric)), ("codes", X.quantized_search(coded, q, query, 10, metric))):
            hits[name] += len(want & {r.vec_id for r in df.collect()})
    assert hits["exact"] == 50 and hits["int8"] >= 49 and hits["codes"] >= 45


def test_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, None)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in X.exact(df, [1.0, 0.0], 9).collect()] == [(0, 1.0), (2, 1.0), (1, 0.0)]
    with pytest.raises(ValueError):
        X.exact(df, [1.0, 0.0], 1, metric="nope")


def test_quantizer():
    r = X.rotation(16, 3)
    assert np.allclose(r @ r.T, np.eye(16))
    for bits in (1, 2, 3, 4):
        codes = RNG.integers(0, 1 << bits, (5, 33)).astype(np.uint8)
        assert (X.unpack_bits(X.pack_bits(codes, bits), bits, 33) == codes).all()
    q = X.Quantizer(32, 4)
    data = q.quantize(POINTS)
    assert ((q.dequantize(data) - POINTS) ** 2).sum(1).max() < 0.1
    assert np.abs(q.dots(data, POINTS[0]) - POINTS @ POINTS[0]).max() < 0.25
    assert np.allclose(q.symmetric_squares(data, data[::-1]), ((q.dequantize(data) - q.dequantize(data[::-1])) ** 2).sum(1))


def test_hadamard():
    assert np.allclose(walsh_hadamard(walsh_hadamard(POINTS)), POINTS)
    with pytest.raises(ValueError):
        walsh_hadamard(np.ones((1, 3)))


def test_clusters(table):
    c = X.Clusters(table, 8)
    assert {r.vec_id for r in c.search(POINTS[3], 5, probes=8).collect()} == best(POINTS[3], 5, "cosine")
    assert c.search(POINTS[3], 1, probes=1).first().vec_id == 3


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_clusters_find_what_all_pairs_find(spark, data, metric):
    """The registered table, with the default search."""
    df = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").cache()
    rows = df.orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    c, hits = X.Clusters(df), 0
    for query in [np.array(_QUERY), *x[:8]]:
        lengths = np.linalg.norm(x, axis=1) * np.linalg.norm(query)
        s = {"cosine": x @ query / lengths, "dot": x @ query, "l2": -np.linalg.norm(x - query, axis=1)}[metric]
        want = {ids[i] for i in np.argsort(-s, kind="stable")[:10]}
        hits += len(want & {r.vec_id for r in c.search(query.tolist(), 10, metric=metric).collect()})
    assert hits >= 0.9 * 90


def test_clusters_pass_over_far_cells(spark):
    """Cells that are far apart: few are looked into and nothing is lost, vectors without length included."""
    rng = np.random.default_rng(12)
    centers = rng.standard_normal((8, 16)) * 20
    points = np.concatenate([c + rng.standard_normal((40, 16)) for c in centers] + [np.zeros((3, 16))])
    c = X.Clusters(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>"), 8)
    for metric in ("cosine", "dot", "l2"):
        for query in (points[5], -points[90], points[200] + 0.1):
            lengths = np.linalg.norm(points, axis=1) * np.linalg.norm(query)
            s = {"cosine": np.where(lengths > 0, points @ query / np.where(lengths > 0, lengths, 1), 0), "dot": points @ query, "l2": -np.linalg.norm(points - query, axis=1)}[metric]
            assert [r.vec_id for r in c.search(query.tolist(), 50, metric=metric).collect()] == np.lexsort((np.arange(len(s)), -s))[:50].tolist()
    assert len(c.cells(points[5].tolist(), 10, "l2")) < 4
