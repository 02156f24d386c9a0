import hashlib
import random

import numpy as np
import pytest

from docsmith.llm import line_dedup, queries
from docsmith.llm.edit_distance import within

from .test_sentence_pieces import structured
from .test_simhash import components


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, edits, letters):
    text = list(text)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(text) + 1)
        if kind == 0:
            text.insert(at, rng.choice(letters))
        elif text and kind == 1:
            del text[min(at, len(text) - 1)]
        elif text:
            text[min(at, len(text) - 1)] = rng.choice(letters)
    return "".join(text)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_banded_distance_against_the_full_table(k):
    rng = random.Random(k)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choices("abc", k=rng.randint(0, 30)))
        pairs.append((a, edited(rng, a, rng.randint(0, k + 2), "abc")))
    text = "".join(a + b for a, b in pairs) or "x"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = np.array([[len(a), len(b)] for a, b in pairs])
    start = (np.cumsum(size.ravel()) - size.ravel()).reshape(-1, 2)
    got = within(points, start[:, 0], size[:, 0], start[:, 1], size[:, 1], k)
    assert got.tolist() == [distance(a, b) <= k for a, b in pairs]


def brute(rows, threshold=2, per_edit=20):
    """Rows are (id, text) with distinct ids."""
    where = [(i, k, line) for i, t in rows for k, line in enumerate((t or "").split("\n")) if line.strip()]
    distinct = sorted({line for _, _, line in where})
    # all pairs, by the distance that is held against the full table above
    points = np.frombuffer("".join(distinct).encode("utf-32-le"), np.uint32)
    size = np.array([len(x) for x in distinct], np.int64)
    start = np.cumsum(size) - size
    links = []
    for i in range(1, len(distinct)):
        limit = np.minimum(threshold, np.minimum(size[:i], size[i]) // per_edit)
        near = within(points, np.full(i, start[i]), np.full(i, size[i]), start[:i], size[:i], threshold, limit)
        links += [(i, int(j)) for j in np.flatnonzero(near)]
    root = dict(zip(distinct, components(len(distinct), links)))
    first = {}
    for i, k, line in where:
        first[root[line]] = min(first.get(root[line], (i, k)), (i, k))
    out = {}
    for i, t in rows:
        kept = [line for k, line in enumerate((t or "").split("\n")) if not line.strip() or first[root[line]] == (i, k)]
        out[i] = "\n".join(kept)
    return out


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdé😀", k=rng.randint(1, 6)))
    lines = [" ".join(word() for _ in range(rng.randint(3, 25))) for _ in range(60)]
    hot = "all rights reserved by the makers of this page"
    texts = []
    for _ in range(70):
        own = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(lines)
            own.append(edited(rng, line, rng.choice([0, 0, 1, 2, 3]), "xyz"))
        own.append(hot if rng.random() < 0.7 else edited(rng, hot, rng.randint(0, 2), "abcxyz"))
        rng.shuffle(own)
        texts.append("\n".join(own))
    return texts + ["", None, "\n\n", texts[0], "z" * 3000, "z" * 3001, "z" * 50 + "\n" + "z" * 51]


@pytest.mark.parametrize(("block", "per_edit"), [(4096, 10), (2, 7)])
def test_whole_operator_against_brute_force(spark, block, per_edit):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, h string").repartition(3)
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(df, per_edit=per_edit, block=block).collect()}
    want = brute(rows, 2, per_edit)
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i].text == want[i], i
        assert got[i].n_lines == len((t or "").split("\n"))


def test_lines_that_share_their_start(spark):
    rng = random.Random(4)
    start = "one and the same start of a very great many lines of text, "
    lines = [start + "".join(rng.choices("abcdefgh ", k=30)) for _ in range(120)]
    lines += [edited(rng, x, rng.randint(1, 3), "xyz") for x in lines[:60]]
    rows = list(enumerate(lines))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df, block=8).collect()}
    assert got == brute(rows)


def test_lines_that_a_polynomial_takes_for_one(spark):
    one, other = structured()
    rows = [(1, one + "\nx"), (2, other + "\ny"), (3, one)]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: one + "\nx", 2: other + "\ny", 3: ""}


def test_equal_ids_with_other_texts_are_other_documents(spark):
    line = "a line that is long enough to take part in this and more"
    rows = [(1, line), (1, line + "\nsomething else that is quite long as well"), (None, line), (None, "z " + line)]
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(line in t for _, t in got) == 1 and ("1", "something else that is quite long as well") in got


def test_registered_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = sorted((r.doc_id, r.text) for r in docs)
    want = brute(rows)
    for r in queries.op10_line_dedup(spark, "/root/testdata/sf0.001").collect():
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert r.n_lines == len((dict(rows)[r.doc_id] or "").split("\n")) and (r.n_removed > 0) == (want[r.doc_id] != (dict(rows)[r.doc_id] or ""))


def test_full_repeats_of_a_row_and_empty_tables(spark):
    line = "a line that is long enough to take part in this"
    df = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(df).collect())
    assert got == [(1, line), (1, line), (2, "")]
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_go_as_exact_copies(spark):
    texts = ["Les.\nAll rights reserved.\n\n  \nab", "Les.\nAll rights reserved!\n\n  \nabc", "Lis.\nnone of it\nab\nLes.", "All right reserved.\n\n\u3000\nabcde\nabxye", "\u3000\nvwxyz\nabcd\nAll rights reserved and more", "All rights reserved and mure"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got == {0: texts[0], 1: "\n  \nabc", 2: "Lis.\nnone of it", 3: texts[3], 4: texts[4], 5: ""}
    assert got == brute(list(enumerate(texts)))
