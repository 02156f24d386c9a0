import random
import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from docsmith.llm import queries  # noqa: E402
from docsmith.llm.packing import CAPACITY, pack, solve, token_ids  # noqa: E402
from docsmith.llm.token_counts import count_tokens, token_counts  # noqa: E402

PARTS = ["a", "b", "'s", "'", "re", "'re", "ll", " ", "  ", "\n", "\t", "　", "\xa0", "é", "1", "٣", "!", "中", "文", "😀", "the", "é", " 's", "'S", "x" * 40, "Straße", "ΑΣ ", "<|endoftext|>", "<|startoftext|>", "İ", "12 3", "It's we'LL"]


def fuzz(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(n)] + ["", None, "a" * 5000, " " * 3000, "中" * 3000, "ab" * 1000, "<|endoftext|>"]


def test_counts_equal_the_library(spark):
    texts = fuzz(400)
    path = P.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in count_tokens(df, path).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(lib.encode(t or "", add_special_tokens=False).ids), repr(t)
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 512)


def test_reset_of_the_machine_changes_nothing():
    from docsmith.llm.bpe_fst import Transducer
    from docsmith.llm.pretokens import spaced

    path = P.path("byte_bpe_50k.json")
    small, large = Transducer(path, max_states=50), Transducer(path)
    for t in [x for x in fuzz(60) if x]:
        data = np.frombuffer(t.encode(), np.uint8)
        segment = np.zeros(len(data), bool)
        segment[0] = True
        start = spaced(data, segment)
        assert (small.run(data.astype(np.uint16), start)[1] == large.run(data.astype(np.uint16), start)[1]).all()


def ids_of(lib, text):
    return [*lib.encode(text or "", add_special_tokens=False).ids, 0]


def test_packing_equals_the_library_and_is_gapless(spark):
    texts = fuzz(300) + ["word " * 5000]
    path = P.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = pack(df, path).collect()
    seen, bins = {}, {}
    for r in rows:
        ids = ids_of(lib, texts[r.doc_id])[r.start : r.start + r.length]
        assert r.start == r.piece * CAPACITY and len(ids) == r.length
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32, repr(texts[r.doc_id])
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(ids_of(lib, t)) for i, t in enumerate(texts)}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= CAPACITY


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df, P.path("word_bpe_49k.json")).count() == 0
    assert count_tokens(df, P.path("byte_bpe_50k.json")).count() == 0


def optimum(lengths, capacity):
    best = [len(lengths)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= lengths[k] and rooms[i] not in rooms[:i]:
                go(k + 1, rooms[:i] + [rooms[i] - lengths[k]] + rooms[i + 1 :])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best[0]


def test_solver_is_valid_and_close_to_the_optimum():
    rng, extra = random.Random(2), 0
    for _ in range(150):
        capacity = rng.randint(5, 25)
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 9))), reverse=True)
        counts = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, int)
        placed, bins = solve(counts, capacity)
        rooms, ranks = {}, {}
        for length, rank, n, first, offset in placed.tolist():
            for k in range(n):
                rooms.setdefault(first + k, []).append((offset, length))
                ranks.setdefault(length, []).append(rank + k)
        assert {k: sorted(v) for k, v in ranks.items()} == {int(k): list(range(counts[k])) for k in np.flatnonzero(counts)}
        for own in rooms.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(rooms) == bins >= optimum(lengths, capacity)
        extra += bins - optimum(lengths, capacity)
    assert extra <= 3


def points():
    return [chr(c) for c in range(0x20, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]


def test_ids_of_every_code_point_equal_the_library():
    path = P.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    marks = [c for c in points() if unicodedata.category(c) in ("Mn", "Mc")]
    rng = random.Random(4)
    texts = [f"a{c}b{c}1 {c}\u0301x" for c in points()] + ["e" + "".join(rng.choices(marks, k=3)) + "o" for _ in range(20000)]
    for k in range(0, len(texts), 50000):
        part = texts[k : k + 50000]
        ids, at = token_ids(pa.array(part), path)
        for i, own in enumerate(lib.encode_batch(part, add_special_tokens=False)):
            assert ids[at[i] : at[i + 1]].tolist() == own.ids, part[i]


def test_counts_of_every_code_point_equal_the_library():
    path = P.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    texts = [f"a{c}b{c}1 {c}  {c}x" for c in points()]
    for k in range(0, len(texts), 50000):
        part = texts[k : k + 50000]
        _, n = token_counts(pa.array(part), path)
        assert n.tolist() == [len(own.ids) for own in lib.encode_batch(part, add_special_tokens=False)]


def test_registered_queries(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    bpe = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in queries.op8_token_counts(spark, "/root/testdata/sf0.001").collect():
        n = len(bpe.encode(docs[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode()), n, n > 512)
    lib, got = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    for r in queries.op9_best_fit_packing(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(docs)
    for doc, own in got.items():
        ids = ids_of(lib, docs[doc])
        assert [(r.piece, r.start, r.length) for r in sorted(own, key=lambda r: r.piece)] == [(k, k * CAPACITY, min(CAPACITY, len(ids) - k * CAPACITY)) for k in range(-(-len(ids) // CAPACITY))]
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own)


def test_long_pretokens_over_many_chunks():
    path = P.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = ["".join(rng.choices("etaoinshrdlu", k=n)) for n in (255, 256, 257, 511, 512, 513, 5000, 60000)]
    texts += ["a" * 20000, "ab" * 9000, "abc " * 500 + "x" * 3000 + " y " + "z" * 700, "中" * 9000, "the" * 5000]
    texts += ["".join(rng.choices(["ing", "tion", "a", "qq", "zx", "er"], k=1500)) + " " + "b" * rng.randint(200, 900) for _ in range(20)]
    _, n = token_counts(pa.array(texts), path)
    assert n.tolist() == [len(own.ids) for own in lib.encode_batch(texts, add_special_tokens=False)]
    path = P.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    ids, at = token_ids(pa.array(texts), path)
    for i, own in enumerate(lib.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == own.ids
