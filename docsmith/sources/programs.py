"""Outside programs on the workers: digests, information, texts, layouts and pictures of files.

Files are read by path, one at a time, so they must stand where all workers find them; nothing holds a whole file.
"""

from __future__ import annotations

import hashlib
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..plans.config import Extract
from .files import info_fields

#: What goes out at once: as many files, or as many characters.
FILES, CHARS = 64, 1 << 22


def output(command: list[str], seconds: float) -> bytes:
    """What a program prints, however it ends; one that takes too long is stopped.  OSError if it cannot be started."""
    try:
        return subprocess.run(command, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, timeout=seconds, check=False).stdout
    except subprocess.TimeoutExpired as late:
        return late.stdout or b""


def text_output(command: list[str], seconds: float) -> str:
    return output(command, seconds).decode("utf-8", "replace").replace("\x00", "")


def fingerprint(path: str) -> tuple[str, int] | None:
    """(SHA-256, bytes) of a file, or None if it cannot be read."""
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest(), f.tell()
    except OSError:
        return None


def _by_file(columns: str, one: Callable[[str], tuple | None]):
    """Rows (path, columns) of a function of a path, in batches; None leaves a file out."""
    names = ["path"] + [c.split()[0] for c in columns.split(", ")]
    kinds = [pa.string()] + [{"string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in columns.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for paths in batches:
            for path in paths.column("path").to_pylist():
                row = None if path is None else one(path)
                if row is None:
                    continue
                held.append((path, *row))
                chars += sum(len(x) for x in row if isinstance(x, str))
                if len(held) >= FILES or chars >= CHARS:
                    yield batch(held)
                    held, chars = [], 0
        if held:
            yield batch(held)

    return run, "path string, " + columns


def extracted(files: DataFrame, settings: Extract | None = None, info: str = "pdfinfo", text: str = "pdftotext", fallback: Callable[[str], str] | None = None) -> DataFrame:
    """(path, hash, bytes, info, text) of the files (path) that can be read: ``Key: value`` lines, and the text of the first pages.

    Where one of the two programs is missing there is no text, so the document counts as a scan, and ``fallback`` gives
    the lines.  A program that fails or takes too long gives what it printed until then.
    """
    settings = settings or Extract()

    def one(path: str) -> tuple | None:
        known = fingerprint(path)
        if known is None:
            return None
        if shutil.which(info) is None or shutil.which(text) is None:
            return (*known, fallback(path) if fallback else "", "")
        first = [text, "-f", "1", "-l", str(settings.pages), "-q", "-enc", "UTF-8", path, "-"]
        return (*known, text_output([info, path], settings.timeout_secs), text_output(first, settings.timeout_secs))

    return files.select("path").mapInArrow(*_by_file("hash string, bytes long, info string, text string", one))


def documents(files: DataFrame, settings: Extract | None = None, **programs) -> DataFrame:
    """The table that a plan takes, (path, hash, bytes, page_count, file_name, pdf_title, pdf_author, pdf_subject, text), from files (path)."""
    from .shared import settled

    # programs run once a file
    rows = settled(extracted(files, settings, **programs), "extracted")
    known = info_fields(rows.select("path", "info"))
    return rows.join(known, "path").select("path", "hash", "bytes", "page_count", base_name(F.col("path")).alias("file_name"), "pdf_title", "pdf_author", "pdf_subject", "text")


def layouts(documents: DataFrame, settings: Extract | None = None, program: str = "pdftohtml") -> DataFrame:
    """(hash, page_count, xml) of documents (path, hash, page_count): where runs of text stand, and in which fonts."""
    settings = settings or Extract()

    def one(path: str) -> tuple | None:
        return (text_output([program, "-xml", "-i", "-q", "-stdout", path], settings.timeout_secs),)

    found = documents.select("path").mapInArrow(*_by_file("xml string", one))
    return documents.select("path", "hash", "page_count").join(found, "path").drop("path")


def page_count(path: Column, settings: Extract | None = None, info: str = "pdfinfo") -> Column:
    """The number of pages of the file at a path; null without the program or its answer."""
    settings = settings or Extract()

    @F.udf("int", useArrow=True)
    def pages(path: str | None) -> int | None:
        if path is None or shutil.which(info) is None:
            return None
        for line in text_output([info, path], settings.timeout_secs).splitlines():
            name, _, value = line.partition(":")
            if name == "Pages" and value.strip().isdigit():
                return int(value)
        return None

    return pages(path)


def first_page(path: str, max_pixels: int, seconds: float, program: str = "pdftoppm") -> bytes | None:
    """A picture of the first page, its longer edge at ``max_pixels``; None if there is none.  Nothing is written to disk."""
    try:
        return output([program, "-png", "-singlefile", "-f", "1", "-l", "1", "-scale-to", str(max_pixels), path], seconds) or None
    except OSError:
        return None
