"""Filing: every document gets a leaf, a folder that passes the gate, and a path of its own."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import UNSORTED
from ..functions.text import WS, file_name, let, quoted, sanitize_folder, title_case
from ..sources.shared import settled
from .catalog import f32

BLOCK = 1024
EXACT, MISC, CLOSEST = "system and type match a leaf exactly", "no leaf for this document type; filed under the system", "closest leaf by keyword overlap"


def overlap(leaf: Column, hay: Column) -> Column:
    """How many of a leaf's words of more than three bytes stand in a text."""
    words = F.split(F.regexp_replace(leaf, "/", " "), WS + "+")
    return F.size(F.filter(words, lambda w: (F.octet_length(w) > 3) & F.contains(hay, F.lower(w))))


def file_documents(digests: DataFrame, leaves: DataFrame) -> DataFrame:
    """Digests with folder, confidence and reason: the exact leaf, else the system's Other, else the closest leaf.

    The first two are joins by name.  Only the documents that neither finds are held against all leaves, by an
    expression over blocks of BLOCK leaves: a taxonomy has a few dozen, and a leaf more for each system that it leaves out.
    """
    known = leaves.select("leaf").distinct()
    exact = F.concat_ws("/", "game_system", title_case(F.col("doc_type")))
    misc = F.concat_ws("/", "game_system", F.lit("Other"))
    named = digests.withColumn("__exact", exact).withColumn("__misc", misc)
    named = named.join(known.withColumnRenamed("leaf", "__e"), F.col("__exact") == F.col("__e"), "left")
    named = named.join(known.withColumnRenamed("leaf", "__m"), F.col("__misc") == F.col("__m"), "left")
    hay = F.lower(F.concat_ws(" ", "game_system", "doc_type", "title"))
    own = F.col("confidence").cast("float")
    lowered = lambda by: F.greatest((own - f32(by)).cast("float"), f32(0.0))
    is_exact, is_misc = F.col("__e").isNotNull(), F.col("__m").isNotNull()
    rows = (
        named.withColumn("folder", F.coalesce("__e", "__m", F.lit("Other")))
        .withColumn("reason", F.when(is_exact, EXACT).when(is_misc, MISC).otherwise(CLOSEST))
        .withColumn("filing_confidence", F.when(is_exact, own).when(is_misc, lowered(0.15)).otherwise(lowered(0.3)).cast("float"))
    )
    best = F.lit(None).cast("struct<n:int,leaf:string>")
    names = sorted(r["leaf"] for r in known.toLocalIterator())
    for a in range(0, len(names), BLOCK):
        # of equal overlaps the last leaf wins
        block = F.array(*(F.lit(x) for x in names[a : a + BLOCK]))
        scored = F.array_max(F.transform(block, lambda leaf: F.struct(overlap(leaf, F.col("__hay")).alias("n"), leaf.alias("leaf"))))
        best = F.greatest(best, scored)
    rows = rows.withColumn("__hay", hay)
    rows = rows.withColumn("folder", F.when(is_exact | is_misc, F.col("folder")).otherwise(F.coalesce(best["leaf"], F.lit("Other"))))
    return rows.drop("__exact", "__misc", "__e", "__m", "__hay")


def gate(filings: DataFrame, min_confidence: float = 0.45) -> DataFrame:
    """Filings below the confidence go to the unsorted folder, with the reason; null confidence counts as failed."""
    sure = F.col("filing_confidence") >= f32(min_confidence)
    reason = F.concat(F.lit("low confidence for "), quoted(F.col("folder")), F.lit(": "), F.col("reason"))
    out = filings.withColumn("reason", F.when(sure, F.col("reason")).otherwise(F.coalesce(reason, F.lit("filing failed: no answer"))))
    out = out.withColumn("folder", F.when(sure, F.col("folder")).otherwise(UNSORTED))
    return out.withColumn("filing_confidence", F.coalesce("filing_confidence", f32(0.0)))


def candidates(filings: DataFrame) -> DataFrame:
    """Filings with the path each would have if no other did."""
    return filings.withColumn("dest", F.concat_ws("/", sanitize_folder(F.col("folder")), file_name(F.col("title"), F.col("path"))))


#: A claim for a path that already looks numbered.
NUMBERED = r"(?s) \([0-9]+\)(\.[^./]*)?\z"


#: An extension: from the last dot of a name on, unless the name starts with it.  The look behind takes one character; of many, it would read the name anew at every place.
EXTENSION = r"(?s)(?<=[^/])(\.[^./]*)\z"


def _numbered(dest: Column, n: Column) -> Column:
    """dest with `` (n)`` before its extension."""
    return F.when(n == 1, dest).otherwise(F.concat(F.regexp_replace(dest, EXTENSION, ""), F.lit(" ("), n.cast("string"), F.lit(")"), F.regexp_extract(dest, EXTENSION, 1)))


def _family(dest: Column) -> Column:
    """What claims that can meet have in common: the path without any numbers at its end."""
    bare = F.concat(F.regexp_replace(F.regexp_replace(dest, EXTENSION, ""), r"(?:(?: \([0-9]+\))+)\z", ""), F.regexp_extract(dest, EXTENSION, 1))
    return F.when(dest.rlike(NUMBERED), bare).otherwise(dest)


def settle(claims: list[str]) -> list[str]:
    """Paths for claims in order: a free one as it is, else the first free number from 2 on."""
    taken: set[str] = set()
    following: dict[str, int] = {}
    out = []
    for claim in claims:
        path, n = claim, following.get(claim, 2)
        while path in taken:
            folder, slash, name = claim.rpartition("/")
            dot = name.rfind(".")
            name, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
            path, n = f"{folder}{slash}{name} ({n}){ext}", n + 1
        taken.add(path)
        following[claim] = n
        out.append(path)
    return out


def assign_paths(filings: DataFrame) -> DataFrame:
    """Filings with distinct destinations, numbered in the order of their paths.

    Only claims of one family can meet.  Families without a claim that is numbered already, which is nearly
    all, are numbered by rank: ranks come from counts of sorted ranges, so a title
    that a third of all documents share is no group of one task.  The others are settled in order by family.
    """
    # names are made once; what follows reads them several times
    claims = settled(candidates(filings), "claims").withColumn("__family", _family(F.col("dest")))
    odd = claims.filter(F.col("dest").rlike(NUMBERED)).select(F.col("__family").alias("__odd")).distinct()
    plain = claims.join(odd, F.col("__family") == F.col("__odd"), "left_anti")
    numbered = ranked(plain, "dest").withColumn("dest", _numbered(F.col("dest"), F.col("__rank"))).drop("__rank", "__family")
    rest = claims.join(odd, F.col("__family") == F.col("__odd"), "left_semi")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)

    def one(table: pa.Table) -> pa.Table:
        order = sorted(range(table.num_rows), key=lambda i, p=table.column("path").to_pylist(): p[i].split("/"))
        table = table.take(order)
        return table.set_column(table.schema.get_field_index("dest"), "dest", pa.array(settle(table.column("dest").to_pylist()), pa.string()))

    return numbered.unionByName(rest.groupBy("__family").applyInArrow(one, schema).drop("__family"))


#: Into how many ranges of paths a hot value is split.
RANGES = 64


def _place(x: Column, bounds: list[str], first: int = 0) -> Column:
    """How many of the sorted bounds are at most x, and first more: a search by halves."""
    if not bounds:
        return F.lit(first)
    k = len(bounds) // 2
    return F.when(x >= bounds[k], _place(x, bounds[k + 1 :], first + k + 1)).otherwise(_place(x, bounds[:k], first))


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """Rows with __rank, 1, 2, ... within equal ``by`` in the order of paths.

    A window over ``by`` alone would gather a hot value in one task.  Rows are split by
    ranges of the path instead, whose bounds are RANGES - 1 paths of the table itself, drawn evenly by hash: each value is
    ranked within its ranges, and the ranges' counts, which are few, give the offsets.
    """
    drawn = rows.select("path").orderBy(F.xxhash64("path"), "path").limit(RANGES - 1).collect()  # a fixed number
    # with the least character between them, steps are in order as their path is
    bounds = sorted({r["path"].replace("/", "\x00") for r in drawn if r["path"] is not None}, key=str.encode)
    place = F.lit(0)
    if bounds:
        own = F.replace("path", F.lit("/"), F.lit("\x00"))
        place = let(own, lambda x: _place(x, bounds))
    salted = rows.withColumn("__range", place)
    inside = Window.partitionBy(by, "__range").orderBy(F.split("path", "/"))
    counts = salted.groupBy(by, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(by).alias("__by"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = salted.withColumn("__rank", F.row_number().over(inside)).join(offsets, (F.col(by) == F.col("__by")) & (F.col("__range") == F.col("__r")))
    return joined.withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__range", "__by", "__r", "__before")
