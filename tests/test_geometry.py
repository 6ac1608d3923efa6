import numpy as np
from lumengrid.operators import geometry as G


def test_planted_angles():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(20, 6)))[0]
    degrees = np.array([0.0001, 20.0, 75.0])
    u = q[:, :3]
    v = q[:, :3] * np.cos(np.radians(degrees)) + q[:, 3:] * np.sin(np.radians(degrees))
    v = v @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
    assert np.allclose(G.principal_angles(u, v), degrees, atol=1e-7)
    assert np.allclose(G.principal_angles(u, u), 0, atol=1e-6)


def test_spectrum_and_alignment_equal_the_matrix_of_items():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(15, 8)), rng.normal(size=(15, 8))
    x = a / np.linalg.norm(a, axis=1, keepdims=True)
    h = np.eye(15) - 1 / 15
    g = h @ x @ x.T @ h
    values = np.linalg.eigvalsh(g)[::-1]
    u, s = G.spectrum(a)
    assert np.allclose(values[:8], s) and abs(G.participation(s) - np.trace(g) ** 2 / (g**2).sum()) < 1e-9
    basis = G.spectrum(b)[0][:, :4]
    assert abs(G.alignment(G.centred(a), basis, s) - np.trace(basis.T @ g @ basis) / values[:4].sum()) < 1e-9
    assert abs(G.alignment(G.centred(a), u, s) - 1) < 1e-9  # all of the variance lies in all dimensions
    assert G.dimensions(np.array([6.0, 3.0, 1.0]), 0.9) == 2 and G.dimensions(np.array([1.0, 0.0]), 0.95) == 1


def test_rotation_is_found():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 5))
    b = a @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    assert abs(G.turned(*G.common_space(a, b, 50)) - 1) < 1e-9
    assert G.turned(*G.common_space(a, rng.normal(size=(30, 5)), 50)) < 0.6


def items(spark, same, n=24, d=12, seed=3):
    rng = np.random.default_rng(seed)
    code = rng.normal(size=(n, 3)) @ rng.normal(size=(3, d))
    rows = []
    for i in range(n):
        for c in (0, 1):
            centre = code[i] if same or c == 0 else rng.normal(size=d) * 2
            rows += [("u", f"{i:02}", c, (centre + rng.normal(size=d) * 0.2).tolist()) for _ in range(3)]
    rows += [("u", "half", 0, [1.0] * d), ("u", "zero", 0, [0.0] * d), ("u", "zero", 1, [1.0] * d), ("u", "00", 1, None), ("u", "00", 1, [1.0]), ("few", "a", 0, [1.0] * d), ("few", "a", 1, [1.0] * d)]
    df = spark.createDataFrame(rows, "unit string, item string, c int, v array<double>")
    return G.item_means(df, "unit", "item", "c", "v", d)


def test_subspaces_against_their_nulls(spark):
    got = {r.unit: r for r in G.subspaces(items(spark, True), 39, 19, chunk=10).collect()}
    r = got["u"]
    assert r.n_items == 24 and r.align > 0.9 and r.p_align == r.p_turn == 1 / 40 and r.turn > 0.9 and r.null_align < r.align
    assert max(r.angles) < 30 and abs(r.k - 3) <= 1
    assert got["few"].drop_reason == "fewer than three items" and got["few"].align is None
    other = {r.unit: r for r in G.subspaces(items(spark, False), 39, 19, chunk=10).collect()}["u"]
    assert other.p_align > 0.05 and other.p_turn > 0.05 and other.p_below_a < 0.2


def test_stability_and_gate(spark):
    at = items(spark, True)
    r = [x.r for x in G.stability(at, 30, chunk=7).collect() if x.unit == "u"]
    assert len(r) == 30 and min(r) > 0.5 and len(set(r)) > 20
    assert all(abs(x) <= 1 for x in r)
    reasons = {x.unit: x.drop_reason for x in G.gate(at, 12).collect()}
    assert reasons == {"u": None, "few": "too few items"}
    assert G.pairs_needed(0.2) == 194 and {x.drop_reason for x in G.gate(at, 3).collect()} == {"too few coordinates"}
    assert (G.ranks(np.array([3.0, 1.0, 3.0, 2.0])) == np.array([3.5, 1.0, 3.5, 2.0])).all()


def test_scaling_rebuilds_distances(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 3)) * [5, 2, 1]
    pairs = [(i, j, float(np.linalg.norm(x[i] - x[j]))) for i in range(30) for j in range(i)]
    at, values = G.classical_scaling(spark.createDataFrame(pairs + [(0, 1, None), (3, 3, 9.0)], "i int, j int, d double"), 3)
    y = {r.item: np.array(r.y) for r in at.collect()}
    assert max(abs(np.linalg.norm(y[i] - y[j]) - d) for i, j, d in pairs) < 1e-5
    assert np.allclose(values, np.linalg.eigvalsh(np.cov(x.T) * 29)[::-1], rtol=1e-6)
    assert G.classical_scaling(spark.createDataFrame([], "i int, j int, d double"), 2)[0].collect() == []


def test_no_rows(spark):
    none = items(spark, True).filter("false")
    assert G.subspaces(none, 3, 3).collect() == [] and G.stability(none, 3).collect() == [] and G.gate(none, 12).collect() == []
