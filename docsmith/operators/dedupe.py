"""Exact duplicates by hash, near duplicates by text or size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_key


def steps(path: Column) -> Column:
    """A path as its components; paths are ordered by these, not by bytes."""
    return F.split(path, "/")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row of (path, hash, ...) for each hash: the shallowest path, then the first.

    Only hashes and paths are compared; the rows, whatever else they hold, are picked by path.
    """
    kept = _firsts(docs).select("first.path")
    return docs.join(kept, "path", "left_semi").select(*docs.columns)


def _place(size: Column) -> Column:
    return F.struct(size.cast("long").alias("size"), steps(F.col("path")).alias("steps"), F.col("path"))


def _firsts(docs: DataFrame) -> DataFrame:
    # a minimum is taken partly before the shuffle; a window would gather every copy
    return docs.groupBy("hash").agg(F.min(_place(F.size(steps(F.col("path"))))).alias("first"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """(hash, kept, other, place): a row for every path that is left out, however many a hash has; place is its order of precedence."""
    firsts = _firsts(docs).select("hash", F.col("first.path").alias("kept"))
    rows = docs.select("hash", F.col("path").alias("other"), _place(F.size(steps(F.col("path")))).alias("place"))
    return rows.join(firsts, "hash").filter("other <> kept").select("hash", "kept", "other", "place")


def nested(copies: DataFrame) -> DataFrame:
    """(hash, kept, others), others in order of precedence: for documents that one reads through, as a group becomes one row."""
    groups = copies.groupBy("hash", "kept").agg(F.sort_array(F.collect_list("place")).alias("all"))
    return groups.select("hash", "kept", F.transform("all", lambda p: p["path"]).alias("others"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """(hash, kept, others) for each hash with several paths."""
    return nested(exact_copies(docs))


def surplus(copies: DataFrame) -> DataFrame:
    """How many copies are left out."""
    return copies.agg(F.count("*").alias("duplicates"))


def contested(docs: DataFrame, by: str = "page_count") -> DataFrame:
    """The rows whose page count, null included, another row shares: only these need their text read."""
    counts = docs.groupBy(by).agg(F.count("*").alias("__n")).filter("__n > 1").withColumnRenamed(by, "__by")
    return docs.join(counts, F.col(by).eqNullSafe(F.col("__by")), "left_semi")


def with_leader(docs: DataFrame, tolerance: float = 0.05, min_chars: int = 500) -> DataFrame:
    """Each row of (path, bytes, page_count, text) with the path of the document it is a copy of, itself if none.

    Within a page count the largest leads (then the first path).  With text keys, equal keys
    follow.  Without, documents follow a leader whose size they are within the tolerance of; the
    distance is to the leader only, and in order of size that makes each follower's
    group one stretch.  The stretches are found on the distinct sizes of each page
    count: eight bytes for each, however many documents have it.
    """
    keyed = docs.withColumn("text_key", text_key(F.col("text"), min_chars)) if "text_key" not in docs.columns else docs
    head = F.struct((-F.col("bytes")).alias("size"), steps(F.col("path")).alias("steps"), F.col("path"))
    sizes = keyed.filter("text_key IS NULL").groupBy("page_count").agg(F.sort_array(F.collect_set("bytes"), asc=False).alias("sizes"))

    def fold(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        spread = ((last - b).cast("float") / F.greatest(last, F.lit(1)).cast("float")).cast("float")
        return F.when(spread <= F.lit(tolerance).cast("float"), acc).otherwise(F.concat(acc, F.array(b)))

    # the fold holds leaders only, each a tolerance below the one before: some hundreds at most
    leaders = F.aggregate(F.slice("sizes", 2, 1 << 30), F.slice("sizes", 1, 1), fold)
    led = sizes.select("page_count", F.explode("sizes").alias("__bytes"), leaders.alias("leaders"))
    leads = led.select(F.col("page_count").alias("__pages"), "__bytes", F.array_min(F.filter("leaders", lambda x: x >= F.col("__bytes"))).alias("lead"))
    joined = keyed.join(leads, F.col("page_count").eqNullSafe(F.col("__pages")) & (F.col("bytes") == F.col("__bytes")) & F.col("text_key").isNull(), "left")
    group = F.coalesce(F.col("text_key"), F.concat(F.lit("size:"), F.col("lead").cast("string")))
    grouped = joined.withColumn("__group", group).drop("__pages", "__bytes", "lead")
    heads = grouped.groupBy("page_count", "__group").agg(F.min(head).alias("__head")).select(F.col("page_count").alias("__p"), F.col("__group").alias("__g"), F.col("__head.path").alias("leader"))
    return grouped.join(heads, F.col("page_count").eqNullSafe(F.col("__p")) & (F.col("__group") == F.col("__g"))).drop("__p", "__g", "__group")


def near_dedup(docs: DataFrame, tolerance: float = 0.05, min_chars: int = 500) -> tuple[DataFrame, DataFrame]:
    """(kept rows, (hash, kept, other, place) of those that were folded)."""
    led = with_leader(docs, tolerance, min_chars)
    kept = led.filter(F.col("leader") == F.col("path"))
    others = led.filter(F.col("leader") != F.col("path")).select("leader", F.col("path").alias("other"), _place(-F.col("bytes")).alias("place"))
    copies = others.join(kept.select("hash", F.col("path").alias("kept")), F.col("kept") == F.col("leader"))
    return kept.drop("leader"), copies.select("hash", "kept", "other", "place")
