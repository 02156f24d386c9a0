import random
import re

import numpy as np
import pytest

xxhash = pytest.importorskip("xxhash")

from docsmith.llm import queries, simhash  # noqa: E402
from docsmith.llm.graph import connected_components  # noqa: E402


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_whole_operator_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = []
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.randint(1, 250))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 10)):
            other = list(words)
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append("\t".join(other).upper())
    texts += ["", None, " \n ", "Éa b\xa0c d e", "one", texts[0], texts[0], "x " * 3000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(3)
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    want = components(len(fps), links)
    assert len(got) == len(texts)
    for i, f in enumerate(fps):
        assert got[i].fingerprint == f"{f:016x}"
        assert got[i].component_id == want[i]


def test_links_of_planted_clusters(spark):
    rng = random.Random(8)
    fps = set()
    for _ in range(300):
        fps.add(rng.getrandbits(64))
    for _ in range(8):
        x = rng.getrandbits(64)
        for _ in range(60):
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)
    links = simhash.fingerprint_links(df).collect()
    at = {x: i for i, x in enumerate(signed)}
    x = np.array(fps, np.uint64)
    true = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 4).tolist()]
    for r in links:
        assert bin(fps[at[r.u]] ^ fps[at[r.v]]).count("1") <= 4
    assert components(len(fps), [(at[r.u], at[r.v]) for r in links]) == components(len(fps), true)


def test_registered_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op4_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    ids = sorted(got)
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    root = components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if bin(fps[ids[i]] ^ fps[ids[j]]).count("1") <= 4])
    assert {i: (got[i].fingerprint, got[i].component_id) for i in ids} == {i: (f"{fps[i]:016x}", ids[root[k]]) for k, i in enumerate(ids)}


def test_components_of_long_paths_and_empty_tables(spark):
    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[1001] == got[1000] == 1000
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0


def wide(x):
    return int.from_bytes(x, "big")


def test_similar_documents_at_the_edge_of_the_radius(spark):
    # pairs at 15 to 23 of 128 bits, where a join that draws bits at random loses some
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghijkl", k=5)) for _ in range(2000)]
    texts = ["", None, "one", " One\n"]
    while len(texts) < 1000:
        words = rng.choices(vocabulary, k=120)
        other = list(words)
        for at in rng.sample(range(120), rng.randint(2, 5)):
            other[at] = rng.choice(vocabulary)
        one, two = (wide(simhash.wide_fingerprint(" ".join(w).encode(), 5)) for w in (words, other))
        if 15 <= (one ^ two).bit_count() <= 25:
            texts += [" ".join(words), " ".join(other)]
    fps = [wide(simhash.wide_fingerprint((t or "").encode(), 5)) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 23]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert [got[i] for i in range(len(texts))] == components(len(fps), links)


def test_wide_links_of_planted_clusters(spark):
    rng = random.Random(22)

    def moved(x, bits):
        for b in rng.sample(range(128), bits):
            x ^= 1 << b
        return x

    fps = {0, rng.getrandbits(128)}
    for _ in range(400):
        x = rng.getrandbits(128)
        fps |= {x, moved(x, rng.randint(18, 25))}
    # a path of steps at the radius, and a dense group
    x = y = rng.getrandbits(128)
    for _ in range(60):
        x = moved(x, 23)
        fps |= {x, *(moved(y, rng.randint(1, 14)) for _ in range(6))}
    fps = rng.sample(sorted(fps), len(fps))
    rows = np.array([[x & (1 << 64) - 1, x >> 64] for x in fps], np.uint64)
    at = {tuple(r): i for i, r in enumerate(rows.view(np.int64).tolist())}
    apart = np.bitwise_count(rows[:, None] ^ rows[None]).sum(axis=-1, dtype=np.int64)
    want = components(len(fps), [(i, j) for i, j in np.argwhere(apart <= 23).tolist() if j < i])
    df = spark.createDataFrame(rows.view(np.int64).tolist(), "a long, b long").repartition(5)
    links = [(at[r.ua, r.ub], at[r.va, r.vb]) for r in simhash.similar_links(df, 23).collect()]
    assert all(apart[i, j] <= 23 for i, j in links)
    assert components(len(fps), links) == want
    # the same where all cells count as large
    cells = simhash.pa.Table.from_batches(simhash._wide_cells(8)([simhash.pa.record_batch({"a": rows[:, 0].view(np.int64), "b": rows[:, 1].view(np.int64)})])).sort_by("cell")
    found = simhash._links(["a", "b"], simhash.within_radius(23), simhash._wide_span(8, 23, 1))(cells.to_batches())
    links = [(at[r["ua"], r["ub"]], at[r["va"], r["vb"]]) for batch in found for r in batch.to_pylist()]
    assert all(apart[i, j] <= 23 for i, j in links)
    assert components(len(fps), links) == want
