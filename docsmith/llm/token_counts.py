"""Operator 8, token counts: a transducer whose transitions emit token counts.

``count_tokens`` counts the tokens of whole texts as the ``tokenizers`` library
does for a byte-level BPE file, without begin and end tokens.  Pretoken starts
come from array operations (pretokens.py), counts from the lazily compiled
machine of bpe_fst.py.  One pass over the table, no shuffle; a worker holds one
machine of bounded size and a few MB of text.

Edge cases: a null or empty text has 0 bytes and 0 tokens; a special token's
string inside a text is that one token; repeated rows give repeated results; an
empty table gives an empty table.  Only the id column is carried over, so other
columns, whatever their names, do not matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_fst import Transducer
from .common import flat_texts, release, slices, sums
from .pretokens import spaced


@lru_cache(maxsize=2)
def machine(path: str) -> tuple[Transducer, tuple[bytes, ...]]:
    with open(path, encoding="utf-8") as f:
        special = tuple(t["content"].encode() for t in json.load(f)["added_tokens"])
    return Transducer(path), special


def without_special(data: np.ndarray, at: np.ndarray, special: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without special tokens, the rows' new offsets, where pieces start, and the special tokens of each row."""
    found, raw = np.zeros(len(at) - 1, np.int64), data.tobytes()
    gone, cuts = np.zeros(len(data), bool), []
    for s in special:
        place = raw.find(s)
        while place >= 0:
            row = int(np.searchsorted(at, place, "right")) - 1
            if place + len(s) <= at[row + 1]:
                found[row] += 1
                gone[place : place + len(s)] = True
                cuts.append(place + len(s))
                place = raw.find(s, place + len(s))
            else:
                place = raw.find(s, place + 1)
    moved = np.concatenate([[0], np.cumsum(~gone)])
    data = data[~gone]
    segment = np.zeros(len(data) + 1, bool)
    segment[moved[np.concatenate([at[:-1], np.array(cuts, np.int64)])]] = True
    return data, moved[at], segment[:-1], found


def token_counts(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text."""
    transducer, special = machine(path)
    data, at = flat_texts(column)
    size = np.diff(at)
    data, at, segment, found = without_special(data, at, special)
    _, emitted = transducer.run(data.astype(np.uint16), spaced(data, segment)) if len(data) else (None, np.zeros(0, np.int8))
    return size, sums(emitted, at) + found


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                n_bytes, n_tokens = token_counts(part.column("__text"), path)
                yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["__id", "n_bytes", "n_tokens", "over_limit"])
        release()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"__id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("__id", id_col)
