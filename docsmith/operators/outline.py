"""Chapter outlines from the layout of text runs.

A run is (doc, page, seq, size, top, left, baseline, text).  What depends on order within a document is
an expression over that document's sorted runs, so the only shuffle is by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import LINE_TOLERANCE, SKIPS
from ..functions.text import attribute, plausible_heading, strip_markup

ELEMENT = r'(?s)(<page [^>]*>|<fontspec [^>]*>|<text [^>]*>.*?</text>)'


def elements(layouts: DataFrame, doc: str = "doc", xml: str = "xml") -> DataFrame:
    """(doc, seq, element): pages, fonts and texts of a layout file, in order."""
    found = F.regexp_extract_all(F.col(xml), F.lit(ELEMENT), F.lit(1))
    return layouts.select(F.col(doc).alias("doc"), F.posexplode(found).alias("seq", "element"))


def fonts(parts: DataFrame) -> DataFrame:
    """(doc, font, size): the last size given to a font in a document."""
    spec = parts.filter(F.startswith("element", F.lit("<fontspec "))).select("doc", "seq", attribute(F.col("element"), "id").alias("font"), F.expr("try_cast(regexp_extract(element, 'size=\"([^\"]*)\"', 1) as float)").alias("size"))
    latest = spec.filter("font IS NOT NULL AND size IS NOT NULL").groupBy("doc", "font").agg(F.max(F.struct("seq", "size")).alias("m"))
    return latest.select("doc", "font", F.col("m.size").alias("size"))


def text_runs(layouts: DataFrame, doc: str = "doc", xml: str = "xml") -> DataFrame:
    """The runs of layout files; runs of unknown fonts and empty runs are left out."""
    parts = elements(layouts, doc, xml)
    page = F.when(F.startswith("element", F.lit("<page ")), F.expr("try_cast(regexp_extract(element, 'number=\"([^\"]*)\"', 1) as int)"))
    paged = parts.withColumn("page", F.coalesce(F.last(page, ignorenulls=True).over(Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    texts = paged.filter(F.startswith("element", F.lit("<text ")))
    head, body = F.regexp_extract("element", r"(?s)\A(<text [^>]*>)", 1), F.regexp_extract("element", r"(?s)\A<text [^>]*>(.*)</text>\z", 1)
    number = lambda name: F.coalesce(F.expr(f"try_cast(regexp_extract(regexp_extract(element, '(?s)\\\\A(<text [^>]*>)', 1), '{name}=\"([^\"]*)\"', 1) as float)"), F.lit(0.0).cast("float"))
    runs = texts.select("doc", "seq", "page", attribute(head, "font").alias("font"), number("top").alias("top"), number("left").alias("left"), number("height").alias("height"), strip_markup(body).alias("text"))
    runs = runs.filter("text <> ''").join(fonts(parts), ["doc", "font"])
    return runs.select("doc", "page", "seq", "size", "top", "left", (F.col("top") + F.col("height")).cast("float").alias("baseline"), "text")


def body_size(runs: DataFrame) -> DataFrame:
    """(doc, body): the size with the most characters, the larger one of equals; documents without a positive one are left out."""
    chars = runs.groupBy("doc", "size").agg(F.sum(F.length("text")).alias("chars"))
    best = chars.groupBy("doc").agg(F.max(F.struct("chars", "size")).alias("m")).select("doc", F.col("m.size").alias("body"))
    return best.filter("body > 0")


def large_runs(runs: DataFrame, min_ratio: float = 1.6) -> DataFrame:
    """The runs that stand out from the body text."""
    joined = runs.join(body_size(runs), "doc")
    return joined.filter(F.col("size") >= (F.col("body") * F.lit(min_ratio).cast("float")).cast("float")).drop("body")


RUN = ("page", "baseline", "seq", "size", "top", "left", "text")


def join_lines(runs: DataFrame) -> DataFrame:
    """(doc, page, size, top, left, baseline, seq, text): runs joined to lines.

    Runs in the order of baselines form a line while they are within the tolerance of its first
    run; within a line they are read from left to right.
    """
    ordered = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(*RUN))).alias("runs"))

    def gather(lines: Column, run: Column) -> Column:
        first = F.get(F.element_at(lines, -1), F.lit(0))
        same = (first["page"] == run["page"]) & (F.abs(first["baseline"] - run["baseline"]) <= F.lit(LINE_TOLERANCE).cast("float"))
        kept = F.slice(lines, F.lit(1), F.size(lines) - 1)
        return F.when(same, F.concat(kept, F.array(F.concat(F.element_at(lines, -1), F.array(run))))).otherwise(F.concat(lines, F.array(F.array(run))))

    lines = F.aggregate(F.slice("runs", 2, 1 << 30), F.array(F.slice("runs", 1, 1)), gather)

    def across(line: Column) -> Column:
        keyed = F.sort_array(F.transform(line, lambda r: F.struct(r["left"].alias("left"), r["baseline"].alias("baseline"), r["seq"].alias("seq"), r.alias("run"))))
        return F.transform(keyed, lambda k: k["run"])

    def join(so_far: Column, run: Column) -> Column:
        doubled = F.endswith(so_far["text"], run["text"])
        lone = F.length(F.element_at(F.split(so_far["text"], " "), -1)) == 1
        initial = lone & run["text"].rlike(r"\A\p{IsUppercase}")
        text = F.when(doubled, so_far["text"]).when(initial, F.concat(so_far["text"], run["text"])).otherwise(F.concat(so_far["text"], F.lit(" "), run["text"]))
        top = F.when(doubled, so_far["top"]).otherwise(F.least(so_far["top"], run["top"]))
        return F.struct(so_far["page"].alias("page"), so_far["baseline"].alias("baseline"), so_far["seq"].alias("seq"), F.greatest(so_far["size"], run["size"]).alias("size"), top.alias("top"), so_far["left"].alias("left"), text.alias("text"))

    joined = F.transform(lines, lambda line: F.get(F.transform(F.array(across(line)), lambda x: F.aggregate(F.slice(x, 2, 1 << 30), F.get(x, F.lit(0)), join)), F.lit(0)))
    return ordered.select("doc", F.explode(joined).alias("line")).select("doc", "line.*")


def drop_running_headers(lines: DataFrame) -> DataFrame:
    """Lines in reading order without those that repeat the line kept last, on the same page or the next."""
    ordered = lines.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("page", "top", "seq", "size", "text"))).alias("lines"))

    def keep(kept: Column, line: Column) -> Column:
        last = F.element_at(kept, -1)
        same = (last["text"] == line["text"]) & (line["page"] - last["page"] <= 1)
        return F.when(same, kept).otherwise(F.concat(kept, F.array(line)))

    kept = F.aggregate(F.slice("lines", 2, 1 << 30), F.slice("lines", 1, 1), keep)
    return ordered.select("doc", F.posexplode(kept).alias("seq", "line")).select("doc", "seq", "line.page", "line.top", "line.size", "line.text")


def headings(runs: DataFrame, min_ratio: float = 1.6) -> DataFrame:
    """(doc, seq, page, top, size, text): the lines of large type that read like headings."""
    lines = join_lines(large_runs(runs, min_ratio)).filter(plausible_heading(F.col("text")))
    return drop_running_headers(lines)


def nest(found: DataFrame, max_depth: int = 3) -> DataFrame:
    """Headings with their level: the rank of their size, at most ``max_depth`` levels."""
    rank = F.dense_rank().over(Window.partitionBy("doc").orderBy(F.col("size").desc())) - 1
    return found.withColumn("level", F.least(rank, F.lit(max(max_depth - 1, 0))))


def tree(entries: DataFrame) -> DataFrame:
    """Entries (doc, seq, level, ...) with depth, parent and siblings.

    An entry goes as deep as its level allows below the entries open before it.  That
    depth is i + min(0, the least of level - j so far), with positions i and j.
    """
    order = Window.partitionBy("doc").orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = entries.withColumn("__i", F.row_number().over(order) - 1)
    placed = placed.withColumn("depth", (F.col("__i") + F.least(F.lit(0), F.min(F.col("level") - F.col("__i")).over(so_far))).cast("int")).drop("__i")
    # the parent is the last entry so far of the depth above: entries and possible parents of a depth, in order
    lane = placed.select(F.explode(F.array(F.struct(F.col("depth").alias("lane"), F.lit(True).alias("own")), F.struct((F.col("depth") + 1).alias("lane"), F.lit(False).alias("own")))).alias("l"), "doc", "seq")
    above = Window.partitionBy("doc", "l.lane").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parents = lane.withColumn("parent", F.last(F.when(~F.col("l.own"), F.col("seq")), ignorenulls=True).over(above)).filter("l.own").select("doc", "seq", "parent")
    placed = placed.join(parents, ["doc", "seq"])
    siblings = Window.partitionBy("doc", "parent").orderBy("seq")
    return placed.withColumn("prev", F.lag("seq").over(siblings)).withColumn("next", F.lead("seq").over(siblings))


def with_counts(placed: DataFrame) -> DataFrame:
    """Tree entries with first and last child and the count of entries below.

    Entries below one are those up to the next of its depth or less: the next in the order of all that are no deeper.
    """
    order = Window.partitionBy("doc").orderBy("seq")
    numbered = placed.withColumn("__i", F.row_number().over(order))
    deepest = placed.groupBy(F.col("doc").alias("__of")).agg(F.max("depth").alias("__deepest"), F.count("*").alias("__n"))
    numbered = numbered.join(deepest, F.col("doc") == F.col("__of")).drop("__of")
    lanes = numbered.select("doc", "seq", "depth", "__i", "__n", F.explode(F.sequence("depth", "__deepest")).alias("__lane"))
    stop = F.lead("__i").over(Window.partitionBy("doc", "__lane").orderBy("__i"))
    counted = lanes.withColumn("__stop", stop).filter("depth = __lane").select("doc", "seq", (F.coalesce("__stop", F.col("__n") + 1) - F.col("__i") - 1).cast("int").alias("below"))
    children = placed.groupBy("doc", F.col("parent").alias("__parent")).agg(F.min("seq").alias("first_child"), F.max("seq").alias("last_child")).withColumnRenamed("doc", "__doc").filter("__parent IS NOT NULL")
    return placed.join(counted, ["doc", "seq"]).join(children, (F.col("doc") == F.col("__doc")) & (F.col("seq") == F.col("__parent")), "left").drop("__doc", "__parent")


def within_pages(entries: DataFrame, last_page: str = "last_page") -> DataFrame:
    """Entries whose page the document has."""
    return entries.filter(F.col("page").between(1, F.col(last_page)))


def page_objects(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries with the object of their page (doc, page, object), or of the first page."""
    first = pages.groupBy("doc").agg(F.min(F.struct("page", "object")).alias("m")).select("doc", F.col("m.object").alias("__first"))
    joined = entries.join(pages, ["doc", "page"], "left").join(first, "doc", "left")
    return joined.withColumn("object", F.coalesce("object", "__first")).drop("__first")


def outline_status(docs: DataFrame, cached: DataFrame, found: DataFrame, min_pages: int = 20, force: bool = False) -> DataFrame:
    """(doc, status): derive, or why not: known already, unreadable, encrypted, with an outline of its own, too short, no headings.

    docs may say so in columns unreadable, encrypted and indexed.
    """
    known = cached.select("doc", F.lit(True).alias("known")).distinct()
    any_heading = found.select("doc", F.lit(True).alias("found")).distinct()
    joined = docs.join(known, "doc", "left").join(any_heading, "doc", "left")
    said = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in docs.columns else F.lit(False)
    status = F.when(F.col("known") & F.lit(not force), "cached")
    for column, why in (("unreadable", "unreadable"), ("encrypted", "encrypted"), ("indexed", "already_indexed")):
        status = status.when(said(column), why)
    status = status.when(F.coalesce("page_count", F.lit(0)) < min_pages, "too_short").when(F.col("found").isNull(), "no_headings").otherwise("derive")
    return joined.select("doc", status.alias("status"))


def skip_reason(status: Column) -> Column:
    """What is said about a document that gets no outline."""
    return F.create_map(*(F.lit(x) for pair in SKIPS.items() for x in pair))[status]


def derive(layouts: DataFrame, docs: DataFrame, cached: DataFrame, min_ratio: float = 1.6, max_depth: int = 3, min_pages: int = 20, force: bool = False, refine=None) -> tuple[DataFrame, DataFrame]:
    """((doc, entries) of the documents whose outline is made now, (doc, status) of all) from layouts (doc, xml).

    refine: a function from headings with levels to the headings that stay.
    """
    found = nest(headings(text_runs(layouts), min_ratio), max_depth)
    found = refine(found) if refine else found
    inside = within_pages(found.join(docs.select("doc", F.col("page_count").alias("last_page")), "doc"))
    status = outline_status(docs, cached, inside, min_pages, force)
    entry = F.struct("seq", F.struct(F.col("text").alias("title"), "page", F.col("level").cast("int").alias("level")).alias("e"))
    wanted = inside.join(status.filter("status = 'derive'"), "doc", "left_semi")
    entries = wanted.groupBy("doc").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    return entries.select("doc", F.transform("all", lambda x: x["e"]).alias("entries")), status
