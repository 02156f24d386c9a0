import math

import numpy as np

from docsmith.llm import embeddings

from .test_simhash import components


def test_links_and_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 32)
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, 2):
        for _ in range(60):
            rows.append((rng.standard_normal(16), label))
        for size in (3, 10, 80):
            centre = rng.standard_normal(16)
            rows += [(centre + 0.12 * rng.standard_normal(16) * rng.random(), label) for _ in range(size)]
    rows += [(rows[0][0], 0)] * 5 + [(rows[0][0], 1), (rows[0][0], None), (np.zeros(16), 0), (np.zeros(16), 0), (np.array([math.nan] + [1.0] * 15), 0), (rows[5][0] * 3.0, 0)]
    data = [(i * 3, [float(np.float32(v)) for v in x], label, "extra") for i, (x, label) in enumerate(rows)]
    data += [(9001, None, 1, "x"), (9002, [1.0, None], 1, "x"), (9003, [], 1, "x"), (9004, [1.0, 2.0], 1, "x"), (9005, [1.0, 2.0], 1, "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, key string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(data)
    n = len(data)
    links = []
    for i, (_, x, a, _) in enumerate(data):
        for j, (_, y, b, _) in enumerate(data[:i]):
            if a is None or a != b or not x or not y or None in x or None in y or len(x) != len(y):
                continue
            x64, y64 = np.array(x), np.array(y)
            size = np.sqrt(x64 @ x64) * np.sqrt(y64 @ y64)
            if size > 0 and np.isfinite(size) and (x64 @ y64) / size >= 0.93:
                links.append((i, j))
    degree = np.bincount(np.array(links).ravel(), minlength=n)
    want = components(n, links)
    found = sum(min(got[data[i][0]].n_links, degree[i]) for i in range(n))
    assert found >= 0.99 * degree.sum()
    for i in range(n):
        r = got[data[i][0]]
        assert r.n_links <= degree[i]
        assert r.kept == (r.component_id == r.vec_id)
    assert np.mean([got[data[i][0]].component_id == data[want[i]][0] for i in range(n)]) > 0.99
    assert got[9001].n_links == got[9002].n_links == 0 and got[9004].n_links == 1


def test_blocks_of_a_component_count_as_one(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(8) + 0.1 * rng.standard_normal((50, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, 0, x[i].tolist(), 1 + i % 3) for i in range(50)], "id long, root long, vec array<double>, weight long")
    want = (x @ x.T >= 0.99).astype(int) @ np.array([1 + i % 3 for i in range(50)]) - np.array([1 + i % 3 for i in range(50)])
    for block in (7, 64):
        got = {r.id: r.n for r in embeddings.count_links(df, 0.99, block).collect()}
        assert [got.get(i, 0) for i in range(50)] == want.tolist()


def test_null_and_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    df = spark.createDataFrame([(1, a, 0), (1, b, 0), (2, a, 0), (None, a, 0), (3, b, 0), (3, b, 0)], "vec_id long, embedding array<float>, label int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embeddings.near_duplicates(df).collect())
    assert got == [("1", 1, "1", True), ("1", 2, "1", True), ("2", 1, "1", False), ("3", 2, "1", False), ("3", 2, "1", False), ("None", 0, "None", True)]


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_two_tight_groups_joined_by_weak_links():
    rng = np.random.default_rng(7)
    for size in (10, 20, 50, 300):
        axes = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
        centres = [axes[0], 0.944 * axes[0] + np.sqrt(1 - 0.944**2) * axes[1]]
        x = np.concatenate([c + 0.0005 * rng.standard_normal((size, 32)) for c in centres] + [rng.standard_normal((40, 32))])
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= 0.93
        i, j = embeddings.descend(x, 0.93)
        assert (i < j).all() and near[i, j].all()
        true = np.argwhere(np.triu(near, 1)).tolist()
        assert components(len(x), list(zip(i.tolist(), j.tolist()))) == components(len(x), true)


def test_isolated_pairs_of_a_deep_label_beside_a_large_group(spark, monkeypatch):
    # cells of 8 in a label of 1,600: as deep as a label of 400,000 has with cells of 2,048
    monkeypatch.setattr(embeddings.graph_links, "__defaults__", (4, 8, 1))
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal((600, 48))
    side -= np.einsum("ij,ij->i", side, x)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    y = 0.935 * x + np.sqrt(1 - 0.935**2) * side
    group = rng.standard_normal(48) + 0.02 * rng.standard_normal((400, 48))
    data = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([x, y, group]))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert np.mean([got[k].component_id == got[600 + k].component_id for k in range(600)]) >= 0.97
    assert len({got[k].component_id for k in range(1200, 1600)}) == 1
