import hashlib
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from docsmith.functions import tables
from docsmith.operators import dedupe, outline
from docsmith.plans import backend, config
from docsmith.plans.plan import build_plan, plan_document
from docsmith.sources import files
from docsmith.streaming import ingest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def tree(tmp_path):
    for name in ("a/one.pdf", "a/two.PDF", "a/.git/no.pdf", "a/.hidden/no.pdf", "a/node_modules/no.pdf", "b/.kept.pdf", "b/note.txt", "skip/x.pdf"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(name.encode())
    return tmp_path


def test_listing_and_fingerprints(spark, tmp_path):
    root = tree(tmp_path)
    found = [os.path.relpath(p, root) for p in files.find_documents(str(root), [str(root / "skip")])]
    assert found == ["a/one.pdf", "a/two.PDF", "b/.kept.pdf"]
    with pytest.raises(OSError):
        files.find_documents(str(root / "nowhere"))
    (root / "abc.pdf").write_bytes(b"abc")
    big = bytes(i % 251 for i in range(3 << 20))
    (root / "big.pdf").write_bytes(big)
    got = {os.path.basename(r.path): r for r in files.fingerprints(spark, str(root)).collect()}
    assert got["abc.pdf"].hash == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and got["abc.pdf"].bytes == 3
    assert got["big.pdf"].hash == hashlib.sha256(big).hexdigest()
    assert "no.pdf" not in got and "two.PDF" in got


def test_log_round_trip(spark, tmp_path):
    fields = [c.split()[0] for c in files.LOG_SCHEMA.split(", ")]
    row = {f: None for f in fields} | {"hash": "h", "title": "T", "topics": ["x"], "confidence": 0.5}
    df = spark.createDataFrame([tuple(row[f] for f in fields)], files.LOG_SCHEMA)
    log = str(tmp_path / "log")
    files.append_log(df, log)
    files.append_log(df.replace("T", "U", "title"), log)
    part = next((tmp_path / "log").iterdir())
    (part / "part-zz.json").write_text('\nnot json\n{"hash": "k"}\n')
    back = files.read_log(spark, log + "/*")
    assert sorted(r.hash for r in back.collect()) == ["h", "h", "k"]
    files.rewrite_log(spark, df, log)
    assert [r.title for r in files.read_log(spark, log).collect()] == ["T"]


@pytest.mark.parametrize("mode", ["hardlink", "symlink", "copy", "move"])
def test_apply_and_undo(tmp_path, mode):
    source, library = tmp_path / "in", tmp_path / "lib"
    source.mkdir()
    for n in ("a", "b"):
        (source / f"{n}.pdf").write_text(n)
    plan = [{"source": str(source / "a.pdf"), "dest": "X/a.pdf"}, {"source": str(source / "gone.pdf"), "dest": "X/g.pdf"}, {"source": str(source / "b.pdf"), "dest": "Y/Z/b.pdf"}]
    results, manifest = files.apply_plan(plan, str(library), mode)
    assert [r["status"] for r in results] == ["filed", "failed", "filed"]
    assert (library / "X/a.pdf").read_text() == "a" and (source / "a.pdf").exists() == (mode != "move")
    again, none = files.apply_plan([plan[0]] if mode != "move" else [{"source": str(library / "X/a.pdf"), "dest": "X/a.pdf"}], str(library), mode)
    assert again[0]["status"] == "skipped" and none is None
    assert files.latest_manifest(str(library)) == manifest
    moved = files.read_plan(manifest)
    assert moved["mode"] == mode and len(moved["actions"]) == 2
    assert {r["status"] for r in files.undo(manifest)} == {"undone"}
    assert (source / "a.pdf").read_text() == "a" and not (library / "Y").exists() and library.exists()


def test_config(tmp_path):
    assert config.load().extract.scanned_threshold == 800
    assert config.load(work_dir="w").library == "w/library"
    path = tmp_path / "c.toml"
    path.write_text('work_dir = "q"\n[extract]\nscanned_threshold = 200\n[systems.aliases]\n"d&d" = "D&D 3.5e"\n')
    c = config.load(str(path), source="s")
    assert (c.work_dir, c.extract.scanned_threshold, c.systems.aliases["d&d"], c.source, c.taxonomy.max_leaves) == ("q", 200, "D&D 3.5e", "s", 40)


def docs(spark):
    rows = [(f"in/adv{i}.pdf", f"h{i}", 1000 + 200 * i, 10 + i, f"adv{i}.pdf", None, f"A Pathfinder adventure number {i} set in Golarion for levels 1 to {i + 2} " + "word " * 300) for i in range(5)]
    rows += [("in/copy/adv0.pdf", "h0", 1000, 10, "adv0.pdf", None, rows[0][6]), ("in/sp.pdf", "hs", 500, 3, "sp.pdf", "The Book of Spells", "5th edition spell list " + "x " * 900), ("in/scan.pdf", "hz", 77, 2, "scan.pdf", None, "")]
    return spark.createDataFrame(rows, "path string, hash string, bytes long, page_count int, file_name string, pdf_title string, text string")


def test_whole_plan(spark):
    plan = build_plan(docs(spark))
    got = {r.path: r for r in plan.assignments.collect()}
    assert set(got) == {f"in/adv{i}.pdf" for i in range(5)} | {"in/sp.pdf", "in/scan.pdf"}
    assert all(got[f"in/adv{i}.pdf"].leaf == "Pathfinder 1e/Adventure" for i in range(5))
    assert got["in/scan.pdf"].leaf == "_Unsorted"
    assert [(r.kept, r.others) for r in dedupe.nested(plan.duplicates).collect()] == [("in/adv0.pdf", ["in/copy/adv0.pdf"])]
    s = plan.summary().first()
    assert (s.filed + s.unsorted, s.duplicates, s.unreadable) == (7, 1, 0)
    assert len({r.dest for r in got.values()}) == 7
    assert '"mode": "copy"' in plan_document(plan, "in", "out", "copy").first().plan


def test_plan_makes_hashes_twice_at_most(spark):
    # once for all comparisons of documents, once where texts are condensed
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def hashed(x):
        made.add(1)
        return x

    d = docs(spark)
    n, plan = d.count(), build_plan(d.withColumn("hash", hashed("hash")))
    assert plan.assignments.count() == 7 and plan.duplicates.count() == 1 and plan.unfiled.count() == 0
    assert made.value <= 2 * n


def test_plan_with_cache_and_model(spark):
    cache = spark.createDataFrame([("h1", "in/adv1.pdf", 1, "Known", "Pathfinder", "adventure", "unknown", "unknown", "unknown", ["t"], "s", 0.9)], "hash string, path string, seq long, title string, game_system string, doc_type string, setting string, level_range string, publisher string, topics array<string>, summary string, confidence float")

    def load():
        return lambda prompt, grammar: '{"title": "By Model", "game_system": "D&D", "doc_type": "adventure", "confidence": 0.8}' if "opening" in prompt.lower() else '["D&D 5e/Adventure"]' if "Catalogue" in prompt else '{"folder": "D&D 5e/Adventure", "confidence": 0.9, "reason": "fits"}'

    plan = build_plan(docs(spark), config.Config(dedupe=config.Dedupe(near_duplicates=False)), backend.Prompted(load), cache)
    got = {r.path: r for r in plan.assignments.collect()}
    assert got["in/adv1.pdf"].title == "Known" and got["in/adv2.pdf"].title == "By Model"
    assert got["in/adv2.pdf"].leaf == "D&D 5e/Adventure"
    # the model says nothing on scans: they are left over
    assert "in/scan.pdf" in {r.path for r in plan.unfiled.collect()}


def test_streaming_ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pdf").write_bytes(b"one")
    (source / "b.pdf").write_bytes(b"one")
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    ingest.append_new(ingest.arrivals(spark, str(source)), log, state).awaitTermination(120)
    assert spark.read.parquet(log).count() == 1
    (source / "c.pdf").write_bytes(b"two")
    (source / "d.pdf").write_bytes(b"one")
    ingest.append_new(ingest.arrivals(spark, str(source)), log, state).awaitTermination(120)
    assert spark.read.parquet(log).count() == 2


def test_the_rest_works_without_the_llm_folders(tmp_path):
    """The entry file imports where docsmith/llm, tests/llm and corpus_pipeline.py are gone."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.split()[1:] == ["False", "True"], out.stderr


def test_outline_cache_and_log(spark, tmp_path):
    cache = str(tmp_path / "outlines")
    assert files.read_outlines(spark, cache).count() == 0
    files.append_outlines(spark.createDataFrame([("a", [("x", 1, 0)]), ("b", [("y", 1, 0)])], files.OUTLINE_SCHEMA), cache)
    files.append_outlines(spark.createDataFrame([("a", [("z", 1, 0)])], files.OUTLINE_SCHEMA), cache)
    (tmp_path / "outlines" / "part=0").mkdir()
    (tmp_path / "outlines" / "part=0" / "x.json").write_text("no json\n{}\n")
    assert {r.hash: r.entries[0].title for r in files.read_outlines(spark, cache).collect()} == {"a": "z", "b": "y"}
    log = str(tmp_path / "log")
    assert files.open_log(spark, log) is None
    files.append_log(spark.createDataFrame([("h", "p", "t", *["u"] * 5, ["v"], "s", 0.5, "r")], files.LOG_SCHEMA), log)
    old = files.open_log(spark, log)
    files.rewrite_log(spark, old.unionByName(old), log)
    assert files.open_log(spark, log).count() == 2
    # a rewrite that broke off between its renames
    os.rename(log, log + ".old")
    assert files.open_log(spark, log).count() == 2
    files.clear_log(spark, log)
    assert files.open_log(spark, log) is None


def test_derived_outlines(spark):
    page = lambda n, rows: f'<page number="{n}">' + "".join(f'<text top="{t}" left="10" width="1" height="{h}" font="{f}">{x}</text>' for t, h, f, x in rows) + "</page>"
    spec = '<fontspec id="0" size="30"/><fontspec id="1" size="10"/>'
    body = "the body of the text that is there to be most of it " * 3
    xml = spec + page(1, [(10, 30, 0, "Up the Hill"), (60, 10, 1, body)]) + page(2, [(10, 30, 0, "Down Again"), (60, 10, 1, body)]) + page(9, [(10, 30, 0, "Beyond the End")])
    flat = spec + page(1, [(10, 10, 1, body)])
    docs = spark.createDataFrame([("a", 8, False), ("b", 8, False), ("c", 5, False), ("d", 8, True), ("e", 8, False)], "doc string, page_count int, encrypted boolean")
    layouts = spark.createDataFrame([("a", xml), ("b", flat), ("c", xml), ("d", xml), ("e", xml)], "doc string, xml string")
    known = spark.createDataFrame([("e",)], "doc string")
    found, status = outline.derive(layouts, docs, known, min_pages=6)
    assert {r.doc: r.status for r in status.collect()} == {"a": "derive", "b": "no_headings", "c": "too_short", "d": "encrypted", "e": "cached"}
    (row,) = found.collect()
    assert row.doc == "a" and [(e.title, e.page, e.level) for e in row.entries] == [("Up the Hill", 1, 0), ("Down Again", 2, 0)]
    assert {r.why for r in status.select(outline.skip_reason(status["status"]).alias("why")).collect()} == {None, *[tables.SKIPS[k] for k in ("no_headings", "too_short", "encrypted")]}
