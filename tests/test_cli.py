import json

from docsmith.__main__ import main
from docsmith.functions import tables
from docsmith.sources import files

from .test_files_and_plan import docs


def test_plan_show_apply_undo(spark, tmp_path, capsys):
    source, table = tmp_path / "in", str(tmp_path / "docs.parquet")
    rows = docs(spark)
    for r in rows.collect():
        p = tmp_path / r.path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(r.hash)
    prefix = str(tmp_path) + "/"
    rows.selectExpr(f"concat('{prefix}', path) AS path", "hash", "bytes", "page_count", "file_name", "pdf_title", "text").write.parquet(table)
    base = ["--source", str(source), "--work-dir", str(tmp_path / "work")]
    assert main([*base, "plan", table, "--mode", "copy"]) == 0
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert summary["duplicates"] == 1
    log = str(tmp_path / "work" / "cache" / "digests")
    entries = files.open_log(spark, log).count()
    assert entries >= 7
    # a second plan describes nothing again, unless it is asked to
    assert main([*base, "plan", table, "--mode", "copy", "--redigest-below", "0"]) == 0
    assert files.open_log(spark, log).count() == entries
    assert main([*base, "plan", table, "--mode", "copy", "--redigest-below", "2"]) == 0
    assert files.open_log(spark, log).count() == entries
    capsys.readouterr()
    assert main([*base, "show", "--full"]) == 0
    assert "Pathfinder 1e/" in capsys.readouterr().out
    assert main([*base, "apply"]) == 0
    counts = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert counts["filed"] == 7 and counts["failed"] == 0
    assert main([*base, "metadata"]) == 0
    assert json.loads(capsys.readouterr().out)["documents"] == 7
    assert spark.read.json(str(tmp_path / "work" / "metadata")).count() == 7
    layouts = str(tmp_path / "layouts")
    spark.createDataFrame([("h", 30, '<fontspec id="0" size="9"/><page number="1"><text top="1" left="1" height="9" font="0">text</text></page>')], "hash string, page_count int, xml string").write.parquet(layouts)
    assert main([*base, "bookmarks", layouts]) == 0
    assert json.loads(capsys.readouterr().out) == {tables.SKIPS["no_headings"]: 1}
    library = tmp_path / "work" / "library"
    assert sum(p.is_file() for p in library.rglob("*")) == 7
    assert main([*base, "undo"]) == 0
    assert sum(p.is_file() for p in library.rglob("*")) == 0
    capsys.readouterr()
    assert main([*base, "doctor"]) == 0
    assert json.loads(capsys.readouterr().out)["documents"] == 8
