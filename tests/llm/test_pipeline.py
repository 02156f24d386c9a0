import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from docsmith.llm import simhash  # noqa: E402

from .test_line_dedup import brute as brute_lines  # noqa: E402
from .test_quality_model import corpus  # noqa: E402
from .test_simhash import components  # noqa: E402
from .test_suffix_dedup import brute as brute_bytes  # noqa: E402


def documents():
    rng = random.Random(2)
    rows = [t for _, t, _ in corpus(240)]
    good = [t for k, t in enumerate(rows) if k % 6 > 2]
    passage = " ".join("".join(rng.choices("qrstuv", k=5)) for _ in range(70))
    rows += [good[0], good[0], good[1].replace("river", "stream", 1), good[2] + " " + passage, passage + " " + good[3], good[4] + "\n" + good[5]]
    return rows + ["", None]


def similar_pairs(texts):
    """All pairs of texts within the radius."""
    fps = [int.from_bytes(simhash.wide_fingerprint((t or "").encode(), 5), "big") for t in texts]
    apart = simhash.bits_apart(0.8)
    radius = int(128 * apart + np.sqrt(128 * apart * (1 - apart)))
    return [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= radius]


def test_stages_against_brute_force(spark):
    texts = documents()
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.quality(spark, df, "").cache()
    assert kept.schema == df.schema
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(240) if i % 6 > 2} <= ids and not {i for i in range(240) if i % 6 <= 2} & ids and not {246, 247} & ids
    one = corpus_pipeline.lines(spark, kept, "").cache()
    assert one.columns == df.columns
    # lines are told apart by the text of every kept document
    want = brute_lines(sorted((r.doc_id, r.text) for r in kept.collect()))
    got = {r.doc_id: r for r in one.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) and r.source == f"s{i % 3}" for i, r in got.items())
    two = corpus_pipeline.near_duplicates(spark, one, "").cache()
    order = sorted(got)
    root = components(len(order), similar_pairs([got[i].text for i in order]))
    rows = {r.doc_id: r for r in two.collect()}
    assert sorted(rows) == [order[k] for k in range(len(order)) if root[k] == k]
    three = corpus_pipeline.suffixes(spark, two, "").cache()
    raw, gone = brute_bytes([rows[i].text for i in sorted(rows)], 200)
    want = {i: bytes(x for x, y in zip(r, g) if not y).decode(errors="ignore") for i, r, g in zip(sorted(rows), raw, gone)}
    assert {r.doc_id: r.text for r in three.collect()} == want
    lib = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    packed = corpus_pipeline.packing(spark, three, "").collect()
    assert sum(r.length for r in packed) == sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in want.values())
    rooms = {}
    for r in packed:
        rooms[r.sequence_id] = rooms.get(r.sequence_id, 0) + r.length
    assert max(rooms.values()) <= 2048 and np.ceil(sum(rooms.values()) / 2048) <= len(rooms)


def test_repeated_ids_nulls_and_clashing_names(spark):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(40)) for _ in range(9)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (2, texts[4]), (None, None), (None, ""), (3, texts[5] + " more"), (4, texts[5] + " less"), (5, texts[6]), (5, texts[6] + " end")]
    names = "doc_id long, text string, __id string, own string, kept string, n_bytes string, `a.b` string, kept_own string, component_id string, h string, n_lines string, column_0 string, carried_0 string, id string, batch int, rest string"
    df = spark.createDataFrame([(i, t, *["x"] * 12, 7, "y") for i, t in rows], names)
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns and out.schema["batch"].dataType == df.schema["batch"].dataType
    got = sorted((str(r.doc_id), r.text or "") for r in out.collect())
    # brute force: rows equal in id and text are one document; of a group the one with the least id and hash stays
    distinct = sorted({(i, t or "") for i, t in rows}, key=str)
    root = components(len(distinct), similar_pairs([t for _, t in distinct]))
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append((str(distinct[k][0]), distinct[k][1]))
    assert len(got) == len(groups) == len(set(got)) == 8
    for members in groups.values():
        assert sum(x in members for x in got) == 1
    assert ("1", texts[0]) in got and ("1", texts[1]) in got and ("None", texts[2]) in got and ("None", texts[3]) in got and ("3", texts[5] + " more") in got
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, df, "")
        if name != "best-fit packing":
            assert done.columns == df.columns
            assert all(r["a.b"] == "x" and r.batch == 7 for r in done.collect())
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_near_copies_are_found(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    texts, copies = [], 0
    for k in range(150):
        own = rng.choices(words, k=rng.randint(60, 300))
        texts.append(" ".join(own))
        if k % 3 == 0:
            for at in rng.sample(range(len(own)), max(1, len(own) // 60)):
                own[at] = rng.choice(words)
            texts.append(" ".join(own))
            copies += 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, df, "").count()
    assert 150 <= kept <= 150 + copies // 10
