import json

from docsmith.__main__ import main
from docsmith.operators import modeling, outline
from docsmith.plans import backend, config
from docsmith.plans.plan import build_plan, probe
from docsmith.sources import programs

from .test_files_and_plan import docs


def script(folder, name, body):
    path = folder / name
    path.write_text("#!/bin/sh\n" + body)
    path.chmod(0o755)
    return str(path)


def test_output_keeps_what_came_however_it_ends(tmp_path):
    assert programs.output([script(tmp_path, "fails", "printf abc; exit 3")], 5) == b"abc"
    assert programs.text_output([script(tmp_path, "odd", r"printf 'a\377\000b'")], 5) == "a�b"
    assert programs.output([script(tmp_path, "hangs", "echo so far; exec sleep 30")], 1) in (b"so far\n", b"")
    try:
        programs.output([str(tmp_path / "none")], 1)
    except OSError:
        return
    raise AssertionError("a program that is not there is an error")


def test_extract_command(spark, tmp_path, capsys):
    source, bin = tmp_path / "in", tmp_path / "bin"
    source.mkdir(), bin.mkdir()
    (source / "a.pdf").write_text("alpha")
    (source / "b c.pdf").write_text("beta")
    (source / "note.txt").write_text("no document")
    script(bin, "pdfinfo", 'printf "Title:  On %s\\nPages: 7\\n" "$(cat "$1")"')
    script(bin, "pdftotext", '[ "$4" = 12 ] && printf "text of %s" "$(cat "$8")"')
    script(bin, "pdftohtml", 'printf "<x>%s</x>" "$(cat "$5")"')
    table = str(tmp_path / "docs")
    files = spark.createDataFrame([(str(source / n),) for n in ("a.pdf", "b c.pdf", "gone.pdf")] + [(None,)], "path string")
    got = {r.file_name: r for r in programs.documents(files, info=str(bin / "pdfinfo"), text=str(bin / "pdftotext")).collect()}
    assert set(got) == {"a.pdf", "b c.pdf"}
    b = got["b c.pdf"]
    assert (b.pdf_title, b.page_count, b.text, b.bytes) == ("On beta", 7, "text of beta", 4)
    assert b.hash == "f44e64e75f3948e9f73f8dfa94721c4ce8cbb4f265c4790c702b2d41cfbf2753"
    table_of = programs.documents(files, info=str(bin / "pdfinfo"), text=str(bin / "pdftotext"))
    assert {r.xml for r in programs.layouts(table_of, program=str(bin / "pdftohtml")).collect()} == {"<x>alpha</x>", "<x>beta</x>"}
    pages = files.select(programs.page_count(files.path, info=str(bin / "pdfinfo")).alias("n"))
    assert [r.n for r in pages.limit(2).collect()] == [7, 7]
    # without the programs: the fallback's lines, and no text, so all are scans
    bare = programs.documents(files, info="no-such-program", fallback=lambda path: "Title: T\nPages: 2\n")
    assert {(r.pdf_title, r.page_count, r.text) for r in bare.collect()} == {("T", 2, "")}
    assert programs.documents(files.limit(0), info="no-such-program").count() == 0
    base = ["--source", str(source), "--work-dir", str(tmp_path / "work")]
    assert main([*base, "extract", table]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"documents": 2}
    assert main([*base, "plan", table]) == 0


def test_scans_are_looked_at(spark):
    reply = '{"title": "Seen", "game_system": "D&D", "doc_type": "adventure", "confidence": 0.9}'

    def load():
        return lambda page, prompt, grammar: reply if page == b"in/scan.pdf" and "scan.pdf" in prompt else "no idea"

    eyes = backend.Looking(backend.Rules(), load, lambda path, pixels, seconds: path.encode())
    got = {r.path: r for r in build_plan(docs(spark), backend=eyes).assignments.collect()}
    assert got["in/scan.pdf"].title == "Seen" and len(got) == 7
    blind = backend.Looking(backend.Rules(), load, lambda path, pixels, seconds: None)
    plain = {r.path: r.title for r in build_plan(docs(spark)).assignments.collect()}
    assert {r.path: r.title for r in build_plan(docs(spark), backend=blind).assignments.collect()} == plain
    off = config.Config(vision=config.Vision(enabled=False))
    assert eyes.digest(probe(docs(spark), off), off).filter("title = 'Seen'").count() == 0


def test_headings_are_refined_in_batches(spark):
    found = spark.createDataFrame([("d", s, 1 + s // 10, float(30 - s % 3), f"Line {s}") for s in range(0, 1200, 2)] + [("e", 5, 1, 20.0, "Alone")], "doc string, seq int, page int, size double, text string")

    def load():
        def model(prompt, grammar):
            assert len(prompt.encode()) <= 4096
            numbers = [int(x.split(":")[0]) for x in prompt.split("\n") if "(page" in x]
            return json.dumps([{"i": n, "l": 7} for n in numbers if n % 4 == 0] + [{"i": 999999, "l": 0}, {"i": numbers[0], "l": True}, "x"])

        return model

    c = config.Config(model=config.Model(context=4096))
    kept = backend.Prompted(load).refine_headings(outline.nest(found), c).collect()
    assert sorted(r.seq for r in kept) == list(range(0, 1200, 4))
    assert {r.level for r in kept} == {2} and {r.doc for r in kept} == {"d"}
    broken = backend.Prompted(lambda: lambda prompt, grammar: "[{")
    assert broken.refine_headings(outline.nest(found), c).count() == 0
    assert backend.Rules().refine_headings(found, c) is found
    assert modeling.picked(None, {1}) == [] and modeling.picked('{"i": 1}', {1}) == []
