"""Files: listing, fingerprints, probes, JSON tables, and the plan's effects on a file system."""

from __future__ import annotations

import datetime
import errno
import json
import os
import shutil
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import MODES, SKIP_DIRS
from ..functions.text import collapse


def find_documents(root: str, exclude: Iterable[str] = (), extension: str = "pdf") -> list[str]:
    """Files of an extension below a local folder, in the order of path steps; links are not followed.

    Hidden and housekeeping folders are skipped, hidden files are not.  An error ends the walk.
    """
    skipped = {os.path.realpath(x) for x in exclude if os.path.exists(x)}
    found = []

    def fail(error: OSError) -> None:
        raise error

    if Path(root).name in SKIP_DIRS:
        return []
    for folder, dirs, names in os.walk(root, onerror=fail):
        dirs[:] = [d for d in dirs if not d.startswith(".") and d not in SKIP_DIRS and os.path.realpath(os.path.join(folder, d)) not in skipped]
        if os.path.realpath(folder) in skipped:
            dirs[:] = []
            continue
        for n in names:
            path = os.path.join(folder, n)
            if n.lower().endswith("." + extension) and os.path.isfile(path) and not os.path.islink(path):
                found.append(path)
    return sorted(found, key=lambda p: p.split("/"))


def listing(spark: SparkSession, root: str, exclude: Iterable[str] = ()) -> DataFrame:
    """(path) of ``find_documents``."""
    return spark.createDataFrame([(p,) for p in find_documents(root, exclude)], "path string")


def fingerprints(spark: SparkSession, path: str, extension: str = "pdf") -> DataFrame:
    """(path, hash, bytes) of the files below a path that Spark reads; unreadable files are left out.

    Spark's listing passes over names that start with a dot or an underscore.
    """
    pattern = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in extension)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(path)
    skip = "/(" + "|".join(d.replace(".", r"\.") for d in SKIP_DIRS) + r"|\.[^/]+)/"
    return files.filter(~F.col("path").rlike(skip)).select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("bytes"))


def info_fields(infos: DataFrame, key: str = "path", text: str = "info") -> DataFrame:
    """(path, pdf_title, pdf_author, pdf_subject, pdf_creator, page_count) from ``Key: value`` lines; the last line of a key counts."""
    lines = infos.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select(key, "pos", F.regexp_extract("line", r"\A([^:]*):", 1).alias("k"), collapse(F.regexp_extract("line", r"(?s)\A[^:]*:(.*)\z", 1)).alias("v"))
    names = {"Title": "pdf_title", "Author": "pdf_author", "Subject": "pdf_subject", "Creator": "pdf_creator", "Pages": "pages"}
    latest = lambda k: F.max(F.when((F.col("k") == k) & (F.col("v") != ""), F.struct("pos", "v")))["v"]
    out = lines.groupBy(key).agg(*(latest(k).alias(n) for k, n in names.items()))
    return out.withColumn("page_count", F.expr("try_cast(pages as int)")).drop("pages")


LOG_SCHEMA = "hash string, path string, title string, game_system string, doc_type string, setting string, level_range string, publisher string, topics array<string>, summary string, confidence float, source string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The digest log with ``seq``, the order of its lines; blank and malformed lines are left out.

    The order is that of files and of lines in a file, so appended parts sort after the earlier ones.
    """
    lines = spark.read.text(path, wholetext=False).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    parsed = lines.filter(F.btrim("value") != "").select(F.from_json("value", LOG_SCHEMA).alias("d"), "file", "at").filter("d.hash IS NOT NULL")
    return parsed.select("d.*", F.struct("file", "at").alias("seq"))


def append_log(digests: DataFrame, path: str) -> None:
    """Add digests to the log; each call is a part that sorts after those before."""
    part = datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
    digests.select(*(c.split()[0] for c in LOG_SCHEMA.split(", "))).write.json(f"{path.rstrip('/')}/part={part}")


def rewrite_log(spark: SparkSession, digests: DataFrame, path: str) -> None:
    """Put a whole new log in place of the old one: written beside it, then renamed; the old one stays aside until then.

    A run that breaks off between the two renames leaves the old log under ``.old``, where the next reader finds it.
    """
    path = path.rstrip("/")
    digests.select(*(c.split()[0] for c in LOG_SCHEMA.split(", "))).write.mode("overwrite").json(f"{path}.staging/part=0")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(hadoop(path + ".old"), True)
    system.rename(hadoop(path), hadoop(path + ".old"))
    system.rename(hadoop(path + ".staging"), hadoop(path))
    system.delete(hadoop(path + ".old"), True)


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def open_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The digest log with ``seq``, or None where there is none yet."""
    path = path.rstrip("/")
    for place in (path, path + ".old"):
        if _exists(spark, place):
            return read_log(spark, place + "/*")
    return None


def clear_log(spark: SparkSession, path: str) -> None:
    """Forget all digests."""
    for place in (path.rstrip("/"), path.rstrip("/") + ".old"):
        found = spark._jvm.org.apache.hadoop.fs.Path(place)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


OUTLINE_SCHEMA = "hash string, entries array<struct<title:string,page:int,level:int>>"


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """(hash, entries) of the outline cache, the latest of each hash; a missing cache is empty, and so are lines that make no sense."""
    if not _exists(spark, path):
        return spark.createDataFrame([], OUTLINE_SCHEMA)
    lines = spark.read.text(path.rstrip("/") + "/*").select("value", F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("seq"))
    parsed = lines.select(F.from_json("value", OUTLINE_SCHEMA).alias("o"), "seq").filter("o.hash IS NOT NULL AND o.entries IS NOT NULL")
    latest = parsed.groupBy("o.hash").agg(F.max(F.struct("seq", "o")).alias("m"))
    return latest.select("m.o.*")


def append_outlines(outlines: DataFrame, path: str) -> None:
    """Put outlines into the cache; later ones of a hash replace the earlier."""
    part = datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
    outlines.select("hash", "entries").write.json(f"{path.rstrip('/')}/part={part}")


def write_plan(plan: dict, path: str) -> None:
    """A plan as pretty JSON, whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(plan, f, indent=2, ensure_ascii=False, default=str)
    os.replace(path + ".tmp", path)


def read_plan(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def place(source: str, dest: str, mode: str) -> str:
    """Put one document at its place: ``filed``, or ``skipped`` if something is there."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if not os.path.exists(source):
        raise FileNotFoundError(errno.ENOENT, "the source is gone", source)
    if os.path.lexists(dest):
        return "skipped"
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    if mode == "copy":
        shutil.copyfile(source, dest)
    elif mode == "symlink":
        os.symlink(os.path.realpath(source), dest)
    else:
        try:
            (os.link if mode == "hardlink" else os.rename)(source, dest)
        except OSError as error:
            if error.errno != errno.EXDEV:
                raise
            shutil.copyfile(source, dest)
            if mode == "move":
                os.remove(source)
    return "filed"


def apply_plan(assignments: Iterable[dict], library: str, mode: str, manifests: str | None = None) -> tuple[list[dict], str | None]:
    """Place all documents; (results (source, dest, status, error), path of the undo manifest, if anything was made).

    Failures do not stop the rest.  The manifest is written after the loop.
    """
    results, actions = [], []
    for a in assignments:
        dest = os.path.join(library, a["dest"])
        try:
            status, error = place(a["source"], dest, mode), None
        except OSError as e:
            status, error = "failed", str(e)
        if status == "filed":
            actions.append({"created": dest, "original": a["source"]})
        results.append({"source": a["source"], "dest": dest, "status": status, "error": error})
    if not actions:
        return results, None
    now = datetime.datetime.now(datetime.timezone.utc)
    path = os.path.join(manifests or library, f"undo-{now.strftime('%Y%m%dT%H%M%SZ')}.json")
    write_plan({"created": now.isoformat(), "mode": mode, "library_root": library, "actions": actions}, path)
    return results, path


def latest_manifest(folder: str) -> str | None:
    """The undo manifest whose name comes last."""
    names = sorted(n for n in os.listdir(folder) if n.startswith("undo-") and n.endswith(".json")) if os.path.isdir(folder) else []
    return os.path.join(folder, names[-1]) if names else None


def undo(manifest: str) -> list[dict]:
    """Take back what a manifest lists; (created, status) with status undone, missing or blocked."""
    plan = read_plan(manifest)
    results = []
    for a in plan["actions"]:
        created, original = a["created"], a["original"]
        if not os.path.lexists(created):
            status = "missing"
        elif plan["mode"] != "move":
            os.remove(created)
            status = "undone"
        elif os.path.lexists(original):
            status = "blocked"
        else:
            os.makedirs(os.path.dirname(original), exist_ok=True)
            shutil.move(created, original)
            status = "undone"
        results.append({"created": created, "status": status})
    prune(plan["library_root"])
    return results


def prune(root: str) -> None:
    """Remove empty folders below the root, deepest first."""
    for folder, _, _ in sorted(os.walk(root), key=lambda x: -x[0].count("/")):
        if folder != root and not os.listdir(folder):
            os.rmdir(folder)


def undo_actions(manifests: DataFrame) -> DataFrame:
    """(created, original, action): the actions of manifests as a table."""
    rows = manifests.select("mode", F.explode("actions").alias("a"))
    return rows.select("a.created", "a.original", F.when(F.col("mode") == "move", "rename").otherwise("delete").alias("action"))


def render_name(path):
    """The name of a page image: 16 hexadecimal digits of the path's hash."""
    return F.substring(F.sha2(path, 256), 1, 16)
