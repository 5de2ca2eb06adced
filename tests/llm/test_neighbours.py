import numpy as np

from skerry.llm import neighbours

SCHEMA = "id long, chunk_id string, vec array<float>, rank int, block string"


def made(n=1500, seed=0, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype("f4")
    for i in range(0, n, 5):
        x[i + 1] = x[i] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.4])
    return x * rng.choice([1, 1, 3, 0.1], size=(n, 1))


def frame(spark, x, extra=()):
    data = [(i, f"c{i}", [float(f) for f in v], 1, "x") for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(data, SCHEMA)


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((u @ u.T).astype(float), 6)
    np.fill_diagonal(s, -9)
    return s


def odd(n, vector):
    nan = [float("nan")] * 64
    return [(n, "null", None, 1, ""), (n + 1, "zero", [0.0] * 64, 1, ""), (n + 2, "short", [1.0] * 3, 1, ""), (n + 3, "nan", nan, 1, ""), (n + 4, "hole", [None] + [1.0] * 63, 1, ""), (None, "no id", vector, 1, ""), (0, "c0", vector, 1, "")]


def test_close_pairs(spark, rows):
    x = made()
    df = frame(spark, x, odd(len(x), [float(f) for f in x[0]]))
    s = cosines(x)
    true = set()
    for i in range(len(x)):
        for j in np.argsort(-s[i])[:5]:
            if s[i, j] >= 0.9:
                true.add((min(i, j), max(i, j)))
    got = {tuple(r) for r in rows(neighbours.close_pairs(df))}
    assert len(true) > 100 and got == {tuple(map(int, p)) for p in true}


def test_recall_is_nine_tenths(spark):
    x = made(4000, 1)
    got = neighbours.similar(frame(spark, x), every=100).toPandas()
    s = cosines(x)
    hit = sum(len(set(np.argsort(-s[i])[:5]) & set(g["other_id"])) for i, g in got.groupby("id"))
    assert hit / (5 * 40) >= 0.9
    assert all(abs(s[r.id, r.other_id] - r.cosine) < 1e-5 and r.chunk_id == f"c{r.id}" and r.other_chunk_id == f"c{r.other_id}" for r in got.itertuples())


def test_equal_directions_and_a_hot_list(spark):
    """A third of all rows point the same way; their list is split, and ties go to the least ids."""
    x = made(900, 2)
    x[:300] = x[0] * np.linspace(1, 2, 300)[:, None].astype("f4")
    got = neighbours.similar(frame(spark, x), k=3, cell=50, part=40).toPandas()
    tied = got[got["id"] < 300]
    assert (tied["cosine"] > 0.9999).all() and tied.groupby("id").size().eq(3).all()
    assert set(tied[tied["id"] == 7]["other_id"]) == {0, 1, 2}


def test_few_and_none(spark):
    x = made(5, 3)
    assert neighbours.similar(frame(spark, x)).count() == 20
    assert neighbours.similar(frame(spark, x[:1])).count() == 0
    assert neighbours.close_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tables_give_the_products():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 64)).astype("f4")
    c = neighbours.kmeans(x, 8, 5, rng)
    own = neighbours.nearest(x, c, 1)[:, 0]
    index = neighbours.Index(c, np.zeros((8, 1, 8), "f4"))
    r, scale = index.rest(x, own)
    assert np.allclose(scale[:, :1] * index.axes[own] + scale[:, 1:] * r, x, atol=1e-4)
    index.books = np.stack([neighbours.kmeans(r[:, j * 8 : j * 8 + 8], 64, 5, rng) for j in range(8)])
    codes = index.codes(r)
    decoded = index.decoded(codes, scale, own)
    for i in range(20):
        axis = index.axes[own[i]]
        q = x[-1 - i]
        t = index.tables((q - (q @ axis) * axis)[None])[0]
        assert np.isclose((q @ axis) * scale[i, 0] + scale[i, 1] * sum(t[j][codes[i, j]] for j in range(8)), q @ decoded[i], atol=1e-3)
    assert ((x - decoded) ** 2).sum() < 0.6 * ((x - x.mean(0)) ** 2).sum()
    assert np.allclose((decoded * index.axes[own]).sum(1), scale[:, 0], atol=1e-4)


def test_pairs_within_a_dense_cluster(spark, rows, monkeypatch):
    """A third of all rows lie close together, over a third of the lists: nine tenths of the pairs are found."""
    real = neighbours.fit_index
    monkeypatch.setattr(neighbours, "fit_index", lambda unit, dim, n: real(unit, dim, n * 18))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4500, 64)).astype("f4")
    c = rng.normal(size=64)
    x[:1500] = c / np.linalg.norm(c) + rng.normal(size=(1500, 64)) * np.sqrt((1 / 0.93 - 1) / 64)
    s = cosines(x)
    true = {(int(min(i, j)), int(max(i, j))) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    got = {tuple(r) for r in rows(neighbours.close_pairs(frame(spark, x)))}
    assert len(true) > 5000 and len(got & true) >= 0.9 * len(true)


def test_lists_that_no_query_visits(spark):
    x = made(9000, 6)
    got = neighbours.similar(frame(spark, x), every=9000, probes=2, cell=100).toPandas()
    assert len(got) == 5 and set(got["id"]) == {0} and str(got["other_chunk_id"][0]) == f"c{got['other_id'][0]}"


def test_layout_changes_no_result(spark, rows):
    x = made(1200, 7)
    a = neighbours.similar(frame(spark, x), every=3)
    b = neighbours.similar(frame(spark, x), every=3, cell=100, part=50, rerank=400, kept=40)
    wide = neighbours.similar(frame(spark, x), every=3, rerank=400, kept=40)
    assert rows(b) == rows(wide)
    same = len(set(rows(a)) & set(rows(wide)))
    assert same >= 0.99 * wide.count()


def test_cells_hold_few_rows():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 60, 200)
    sizes[7] = 950
    first, span = neighbours.cells(rng.normal(size=(200, 8)).astype("f4"), sizes, 300)
    held = np.zeros(int((first + span).max()))
    for i in range(200):
        held[first[i] : first[i] + span[i]] += sizes[i] / span[i]
    assert span[7] == 4 and held.max() <= 300 and len(held) < 2 * sizes.sum() / 300 + 5
    row, cell, at, lists = neighbours._visits(np.array([[7, 3], [3, 5]]), first, span)
    assert len(row) == len(cell) == len(at) - 1 and sorted(lists[at[0] : at[-1]].tolist()).count(7) == 4
