"""What a run would find: the source, the cache, the model files."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import SparkSession

from ..sources import files
from .config import Config


def doctor(spark: SparkSession, config: Config) -> dict:
    """Documents found, log entries, the size of the model file (None if there is none), and which programs are there."""
    log = f"{config.cache_dir}/digests"
    entries = files.read_log(spark, log).count() if os.path.isdir(log) else 0
    model = os.path.getsize(config.model.path) if os.path.isfile(config.model.path) else None
    found = len(files.find_documents(config.source, [config.library, config.work_dir])) if os.path.isdir(config.source) else 0
    return {"documents": found, "log_entries": entries, "model_bytes": model, "programs": {p: shutil.which(p) is not None for p in ("pdfinfo", "pdftotext", "pdftohtml", "pdftoppm", "timeout")}}
