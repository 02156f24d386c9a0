"""Command line: extract, plan, show, apply, sort, undo, headings, bookmarks, metadata, doctor.

Documents come as a Parquet table (path, hash, bytes, page_count, file_name, pdf_title, text), and layouts as one of
(hash, page_count, xml); extract makes both from the files below the source, by outside programs.  Writing into
documents is another program's work: metadata and bookmarks say what there is to write, as JSON lines in the work folder.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import cachelog, catalog, enrich, modeling, outline
from .plans import config as settings
from .plans.backend import Rules
from .plans.doctor import doctor
from .plans.plan import build_plan, plan_document
from .sources import files, programs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docsmith", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--source")
    p.add_argument("--library")
    p.add_argument("--work-dir", dest="work_dir")
    sub = p.add_subparsers(dest="command", required=True)
    extract = sub.add_parser("extract", help="make the table of documents from the files below the source")
    extract.add_argument("documents")
    extract.add_argument("--layouts", help="make the table of layouts too")
    plan = sub.add_parser("plan")
    plan.add_argument("documents")
    plan.add_argument("--mode", choices=["hardlink", "symlink", "copy", "move"], default="hardlink")
    plan.add_argument("--limit", type=int)
    plan.add_argument("--rescan", action="store_true", help="forget the digest log")
    plan.add_argument("--redigest-below", type=float, metavar="CONFIDENCE", help="describe those again that were less sure")
    plan.add_argument("--redigest-unknown", action="store_true", help="describe those again that have no title")
    sort = sub.add_parser("sort", help="plan and apply")
    sort.add_argument("documents")
    sort.add_argument("--mode", choices=["hardlink", "symlink", "copy", "move"], default="hardlink")
    sort.add_argument("--yes", "-y", action="store_true", help="do not ask")
    sort.add_argument("--metadata", action="store_true")
    sort.add_argument("--bookmarks", metavar="LAYOUTS")
    bookmarks = sub.add_parser("bookmarks")
    bookmarks.add_argument("layouts")
    bookmarks.add_argument("--dry-run", action="store_true")
    bookmarks.add_argument("--force", action="store_true", help="derive outlines again that are cached")
    bookmarks.add_argument("--min-pages", type=int)
    bookmarks.add_argument("--limit", type=int)
    metadata = sub.add_parser("metadata")
    metadata.add_argument("--dry-run", action="store_true")
    show = sub.add_parser("show")
    show.add_argument("--full", action="store_true")
    apply = sub.add_parser("apply")
    apply.add_argument("--mode", choices=["hardlink", "symlink", "copy", "move"])
    apply.add_argument("--dry-run", action="store_true")
    undo = sub.add_parser("undo")
    undo.add_argument("manifest", nargs="?")
    headings = sub.add_parser("headings")
    headings.add_argument("layout", help="a layout file in XML")
    headings.add_argument("--min-ratio", type=float, default=1.6)
    headings.add_argument("--max-depth", type=int, default=4)
    sub.add_parser("doctor")
    return p


def show(plan: dict, full: bool) -> list[str]:
    """The plan as a tree of folders, with documents if asked."""
    folders: dict[str, list[dict]] = {}
    for a in plan["assignments"]:
        folders.setdefault(a["leaf"], []).append(a)
    lines, before = [], []
    for leaf in sorted(folders):
        steps = leaf.split("/")
        shared = len(os.path.commonprefix([steps, before]))
        for depth in range(shared, len(steps)):
            last = depth == len(steps) - 1
            lines.append("  " * depth + steps[depth] + (f"/  ({len(folders[leaf])})" if last else "/"))
        before = steps
        if full:
            lines += ["  " * len(steps) + f"{os.path.basename(a['dest'])}  [{a['confidence']:.2f}]" for a in folders[leaf]]
    return lines


def make_plan(session: SparkSession, config: settings.Config, documents: str, mode: str, limit: int | None = None, rescan: bool = False, below: float | None = None, unknown: bool = False) -> dict:
    """Plan a table of documents, log the new digests and write the plan; its summary."""
    log = f"{config.cache_dir}/digests"
    if rescan:
        files.clear_log(session, log)
    cache = files.open_log(session, log)
    if cache is not None and (below is not None or unknown):
        kept = cachelog.last_wins(cache)
        kept = kept if below is None else cachelog.drop_below(kept, below)
        files.rewrite_log(session, cachelog.drop_unnamed(kept) if unknown else kept, log)
        cache = files.open_log(session, log)
    backend = Rules()
    plan = build_plan(session.read.parquet(documents), config, backend, cache=cache, limit=limit)
    files.append_log(plan.described.withColumn("source", modeling.label(backend.name, F.lit(""))), log)
    text = plan_document(plan, config.source, config.library, mode).first()["plan"]
    files.write_plan(json.loads(text), config.plan_path)
    return plan.summary().first().asDict()


def carry_out(config: settings.Config, mode: str | None, dry_run: bool = False) -> int:
    """Apply the plan that is written; 1 if a document could not be filed."""
    plan = files.read_plan(config.plan_path)
    mode = mode or plan["mode"]
    work = [{"source": x["path"], "dest": x["dest"]} for x in plan["assignments"]]
    if dry_run:
        print(f"{len(work)} documents, mode {mode}")
        return 0
    results, manifest = files.apply_plan(work, plan["library_root"], mode, config.work_dir)
    files.write_plan(plan | {"mode": mode}, config.plan_path)
    counts = {s: sum(r["status"] == s for r in results) for s in ("filed", "skipped", "failed")}
    print(json.dumps(counts | {"manifest": manifest}))
    failed = [r for r in results if r["status"] == "failed"]
    for r in failed[:10]:
        print(f"{r['source']}: {r['error']}", file=sys.stderr)
    return int(bool(failed))


def derive_outlines(session: SparkSession, config: settings.Config, layouts: str, dry_run: bool = False, force: bool = False, min_pages: int | None = None, limit: int | None = None) -> dict:
    """Make the outlines that the cache does not have; how many documents had which outcome."""
    cache = f"{config.cache_dir}/outlines"
    table = session.read.parquet(layouts).withColumnRenamed("hash", "doc")
    if limit is not None:
        table = table.orderBy("doc").limit(limit)
    known = files.read_outlines(session, cache).withColumnRenamed("hash", "doc")
    b = config.bookmarks
    found, status = outline.derive(table.select("doc", "xml"), table.drop("xml"), known, b.min_ratio, b.max_depth, b.min_pages if min_pages is None else min_pages, force, lambda h: Rules().refine_headings(h, config))
    counts = status.groupBy(F.coalesce(outline.skip_reason(F.col("status")), "status").alias("what")).count().collect()  # a few outcomes
    if not dry_run:
        files.append_outlines(found.withColumnRenamed("doc", "hash"), cache)
    return {r["what"]: r["count"] for r in counts}


def write_metadata(session: SparkSession, config: settings.Config, dry_run: bool = False) -> dict:
    """Say for each filed document what is to be written into it; refused where the plan made no copies."""
    plan = files.read_plan(config.plan_path)
    if not enrich.may_write(plan["mode"]):
        raise SystemExit(f"mode {plan['mode']}: the filed documents are the originals, which are left as they are")
    log = files.open_log(session, f"{config.cache_dir}/digests")
    if log is None:
        raise SystemExit("no digest log: plan first")
    assigned = session.createDataFrame([(a["hash"], a["dest"]) for a in plan["assignments"]], "hash string, dest string")
    digests = catalog.finish(cachelog.last_wins(log).drop("seq"), config.systems.aliases)
    fields = enrich.metadata_fields(digests.join(assigned, "hash"))
    rows = enrich.wanted(fields, files.read_outlines(session, f"{config.cache_dir}/outlines"))
    rows = rows.select("hash", "dest", "meta_title", "meta_author", "meta_subject", "meta_keywords", "confidence", "entries")
    if not dry_run:
        rows.write.mode("overwrite").json(f"{config.work_dir}/metadata")
    return {"documents": rows.count(), "with_outline": rows.filter("size(entries) > 0").count()}


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    config = settings.load(a.config, source=a.source, library=a.library, work_dir=a.work_dir)
    spark = lambda: SparkSession.builder.appName("docsmith").getOrCreate()
    if a.command == "extract":
        session = spark()
        found = files.listing(session, config.source, [config.library, config.work_dir])
        programs.documents(found, config.extract).write.mode("overwrite").parquet(a.documents)
        made = session.read.parquet(a.documents)
        if a.layouts:
            programs.layouts(made.dropDuplicates(["hash"]), config.extract).write.mode("overwrite").parquet(a.layouts)
        print(json.dumps({"documents": made.count()}))
    elif a.command == "plan":
        print(json.dumps(make_plan(spark(), config, a.documents, a.mode, a.limit, a.rescan, a.redigest_below, a.redigest_unknown)))
    elif a.command == "sort":
        if (a.metadata or a.bookmarks) and not enrich.may_write(a.mode):
            print("metadata and bookmarks need --mode copy or --mode move", file=sys.stderr)
            return 1
        session = spark()
        print(json.dumps(make_plan(session, config, a.documents, a.mode)))
        if not a.yes and input("File them? [y/N] ").strip().lower() not in ("y", "yes"):
            return 0
        code = carry_out(config, a.mode)
        if a.bookmarks:
            print(json.dumps(derive_outlines(session, config, a.bookmarks)))
        if a.metadata:
            print(json.dumps(write_metadata(session, config)))
        return code
    elif a.command == "bookmarks":
        print(json.dumps(derive_outlines(spark(), config, a.layouts, a.dry_run, a.force, a.min_pages, a.limit)))
    elif a.command == "metadata":
        print(json.dumps(write_metadata(spark(), config, a.dry_run)))
    elif a.command == "show":
        print("\n".join(show(files.read_plan(config.plan_path), a.full)))
    elif a.command == "apply":
        return carry_out(config, a.mode, a.dry_run)
    elif a.command == "undo":
        manifest = a.manifest or files.latest_manifest(config.work_dir)
        if manifest is None:
            print("no manifest", file=sys.stderr)
            return 1
        print(json.dumps(files.undo(manifest)))
    elif a.command == "headings":
        session = spark()
        layout = session.createDataFrame([(a.layout, open(a.layout, encoding="utf-8").read())], "doc string, xml string")
        found = outline.nest(outline.headings(outline.text_runs(layout), a.min_ratio), a.max_depth)
        for r in found.orderBy("seq").collect():  # one document
            print("  " * r["level"] + f"{r['text']}  (page {r['page']})")
    else:
        print(json.dumps(doctor(spark(), config), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
