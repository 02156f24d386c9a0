import random
from collections import Counter

import numpy as np
import pytest

from docsmith.llm import suffix_dedup
from docsmith.llm.family import CONTESTED, FIRST, REPEATED, Family, batch_entries


def brute(texts, length):
    seen = Counter()
    raw = [(t or "").encode() for t in texts]
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] += 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(gone)
    return raw, out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (8, 30, 45, 60, 200)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.append(p[a : a + rng.randint(100, 500)])
            parts.append(word() * rng.randint(0, 3))
        texts.append("".join(parts))
    texts += [texts[3], texts[3], "", None, "a" * 199, "b" * 200, "c" * 201, "d" * 700, "xyz" * 150, ("k" * 70 + "mno" * 60) * 2, "é" * 120, texts[5] + texts[5]]
    same = "".join(rng.choices("pqrst", k=260))
    texts += [same[:230] + "1" * 30, "2" * 30 + same[:215], same[10:] + "z", same[:199], "q" + same[60:]]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_every_byte_against_brute_force(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, batch int").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    raw, gone = brute(texts, 200)
    assert len(got) == len(texts)
    for i, (r, g) in enumerate(zip(raw, gone)):
        row = got[i]
        mine = bytearray(len(r))
        for a, b in zip(row.starts, row.ends):
            mine[a:b] = b"\1" * (b - a)
        assert mine == g, (i, texts[i])
        assert len(row.starts) == sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        assert bytes(row.kept) == bytes(x for x, y in zip(r, g) if not y)
        assert row.n_bytes == len(r)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_family_marks_what_a_count_would():
    rng = np.random.default_rng(1)
    for _ in range(40):
        family, every = Family(), []
        for owner in range(int(rng.integers(1, 12))):
            n = int(rng.integers(0, 30))
            key, sub = rng.integers(0, 40, n).astype(np.uint64), rng.integers(0, 3, n).astype(np.uint64)
            every += zip(key.tolist(), sub.tolist())
            family.add(*batch_entries(key, sub, np.zeros(n, np.uint8)), owner)
        level, pairs = family.all(), Counter(every)
        assert len(family.levels) <= 1
        for k, s, m in zip(level.key.tolist(), level.sub.tolist(), level.mark.tolist()):
            assert bool(m & REPEATED) == (pairs[k, s] > 1)
            assert bool(m & CONTESTED) == any(a == k and b != s for a, b in pairs)
        assert int((level.mark & FIRST > 0).sum()) == len(pairs)


def test_levels_stay_few():
    family = Family()
    for owner in range(100):
        key = np.arange(owner * 7, owner * 7 + 7, dtype=np.uint64)
        family.add(key, np.zeros(7, np.uint64), np.zeros(7, np.uint8), owner)
        assert len(family.levels) <= 8


def test_documents_added_by_several_calls(spark, tmp_path):
    texts = corpus(5)
    rows = [(i, t) for i, t in enumerate(texts)]
    parts = [rows[:20], rows[20:23], [], rows[23:60], rows[60:]]
    for part in parts:
        # a new object each time: all that is known is in the folder
        index = suffix_dedup.SuffixIndex(spark, str(tmp_path / "index"), shards=3)
        index.add(spark.createDataFrame(part, "doc_id long, text string"))
    assert index.calls == len(parts)
    raw, gone = brute(texts, 200)
    want = {i: bytes(x for x, y in zip(r, g) if not y) for i, (r, g) in enumerate(zip(raw, gone))}
    assert {r.id: bytes(r.kept) for r in index.removals().collect()} == want
    assert {r.id: bytes(r.kept) for r in index.removals(last_only=True).collect()} == {i: want[i] for i, _ in parts[-1]}
    # half way, only what had been added counts
    half = suffix_dedup.SuffixIndex(spark, str(tmp_path / "half"), shards=3)
    half.add(spark.createDataFrame(parts[0], "doc_id long, text string"))
    half.add(spark.createDataFrame(parts[1], "doc_id long, text string"))
    raw, gone = brute(texts[:23], 200)
    assert {r.id: bytes(r.kept) for r in half.removals().collect()} == {i: bytes(x for x, y in zip(r, g) if not y) for i, (r, g) in enumerate(zip(raw, gone))}


@pytest.mark.parametrize("length", [1, 30])
def test_short_lengths(spark, length):
    texts = corpus(7)[:30] + ["", None, "ab", "ß"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw, gone = brute(texts, length)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df, length=length).collect()}
    assert got == {i: bytes(x for x, y in zip(r, g) if not y) for i, (r, g) in enumerate(zip(raw, gone))}


def test_registered_query(spark, tmp_path):
    import hashlib

    from docsmith.llm import queries

    texts = corpus(9)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    name = next(n for n in queries.queries() if n.startswith("op2_"))
    rows = {r.doc_id: r for r in queries.queries()[name](spark, str(tmp_path)).collect()}
    raw, gone = brute(texts, 200)
    assert len(rows) == len(texts)
    for i, (r, g) in enumerate(zip(raw, gone)):
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        kept = bytes(x for x, y in zip(r, g) if not y)
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (len(r), sum(g), spans, hashlib.sha256(kept).hexdigest())
