"""The tables of a test directory seen as documents, probes, digests, layouts and a digest log.

Every view has its counterpart in SQL (``SQL``), which the oracle queries build on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rules over the words that the generated corpus has; the built-in tables are about another one.
CORPUS_SYSTEMS = [("licensed under", "Licensed"), (" que ", "Romance"), (" und ", "German"), (" the ", "English"), ("aux", "French")]
CORPUS_TYPES = [("***", "noise"), ("!!", "shouting"), (" | ", "listing"), ("ment", "statement"), ("ciones", "notices"), ("tion", "narration"), ("ing", "report"), ("ung", "record")]
CORPUS_SETTINGS = ["Apache License", "Creative", "Elle", "Der ", "Los "]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, hash, bytes, file_name, page_count, pdf_title, text, doc_id, lang, source)."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("path"),
        F.sha2("text", 256).alias("hash"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"),
        F.ceil(F.col("n_chars") / 1800).cast("int").alias("page_count"),
        F.substring_index("text", "\n", 1).alias("pdf_title"),
        "text",
        "doc_id",
        "lang",
        "source",
    )


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, path, bytes, page_count, title, game_system, doc_type, ...): the source as system, the language as type."""
    d = documents(spark, sf_dir)
    # single precision throughout
    confidence = (F.lit(0.25).cast("float") + F.lit(0.1).cast("float") * F.least(F.col("page_count"), F.lit(4)).cast("float")).cast("float")
    return d.select(
        "hash",
        "path",
        "bytes",
        "page_count",
        F.when(F.length("pdf_title") > 40, F.col("pdf_title")).otherwise("unknown").alias("title"),
        F.col("source").alias("game_system"),
        F.concat(F.lit("texts in "), F.col("lang")).alias("doc_type"),
        F.lit("unknown").alias("setting"),
        F.lit("unknown").alias("level_range"),
        F.when(F.col("bytes") > 2000, "House of Prose").otherwise("unknown").alias("publisher"),
        F.array("lang", "lang", "source").alias("topics"),
        F.col("pdf_title").alias("summary"),
        confidence.alias("confidence"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, seq, title, confidence): events as entries of a digest log."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("hash"), F.struct("ts", "event_id").alias("seq"), "event_id", F.col("event_type").alias("title"), F.col("value").cast("float").alias("confidence"))


TAGS = r"<(h1|h2|h3|p|li|b)>([^<]+)<"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, seq, size, top, left, baseline, text): the elements of pages as text runs, two to a line."""
    p = read(spark, sf_dir, "pages")
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(TAGS), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(TAGS), F.lit(2)).alias("raw"))
    rows = p.select(F.col("page_id").alias("doc"), F.posexplode(found).alias("seq", "e")).select("doc", "seq", F.col("e.tag").alias("tag"), F.col("e.raw").alias("raw"))
    size = F.when(F.col("tag") == "h1", 30).when(F.col("tag") == "h2", 24).when(F.col("tag") == "h3", 20).when(F.col("tag") == "b", 22).otherwise(10).cast("float")
    top = (F.floor(F.pmod("seq", F.lit(12)) / 2) * 40).cast("float")
    out = rows.select("doc", (F.floor(F.col("seq") / 12) + 1).cast("int").alias("page"), "seq", size.alias("size"), top.alias("top"), (F.pmod("seq", F.lit(2)) * 100).cast("float").alias("left"), "raw")
    return out.select("doc", "page", "seq", "size", "top", "left", (F.col("top") + F.col("size")).cast("float").alias("baseline"), F.col("raw").alias("text"))


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, xml): the runs written as layout files, for the parser."""
    r = runs(spark, sf_dir)
    number = lambda c: F.col(c).cast("int").cast("string")
    element = F.concat(F.lit('<page number="'), number("page"), F.lit('"><text top="'), number("top"), F.lit('" left="'), number("left"), F.lit('" width="1" height="'), number("size"), F.lit('" font="f'), number("size"), F.lit('"><b>'), F.col("text"), F.lit("</b></text>"))
    parts = r.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", element.alias("x")))), lambda e: e["x"]), "\n").alias("body"))
    specs = "".join(f'<fontspec id="f{s}" size="{s}" family="x"/>' for s in (30, 24, 22, 20, 10))
    return parts.select("doc", F.concat(F.lit(specs), F.col("body")).alias("xml"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of large type as headings."""
    return runs(spark, sf_dir).filter("size >= 20")


_SPACE = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'), ' ')"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


def sql_condense(x: str, limit: int) -> str:
    c = sql_collapse(x)
    return f"CASE WHEN substr({c}, {limit}, 1) = ' ' THEN substr({c}, 1, {limit + 1}) ELSE substr({c}, 1, {limit}) END"


def sql_unknown(x: str) -> str:
    return f"(lower({sql_strip(x)}) IN ('', 'unknown', 'untitled'))"


def sql_case(rules: list[tuple[str, str]], *texts: str) -> str:
    quote = lambda s: s.replace("'", "''")
    return "CASE " + " ".join(f"WHEN contains({t}, '{quote(n)}') THEN '{quote(v)}'" for t in texts for n, v in rules) + " END"


def sql_title_case(x: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({sql_collapse(x)}, ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ')"


def sql_cut(x: str, limit: int) -> str:
    """The longest start of that many bytes at most, without blanks at a cut."""
    longest = f"list_max(list_filter(generate_series(0, {limit}), lambda n: strlen(substr({x}, 1, CAST(n AS BIGINT))) <= {limit}))"
    return f"CASE WHEN strlen({x}) <= {limit} THEN {x} ELSE regexp_replace(substr({x}, 1, {longest}), '{_SPACE}+$', '') END"


def sql_component(x: str) -> str:
    clean = sql_collapse(f"regexp_replace({x}, '[/\\\\:*?\"<>|\\x00-\\x1F\\x7F]', ' ', 'g')")
    clean = f"regexp_replace(regexp_replace({clean}, '^[. ]+', ''), '[. ]+$', '')"
    return f"list_transform(list_transform([{clean}], lambda a: {sql_cut('a', 180)}), lambda c: CASE WHEN c = '' THEN 'Untitled' WHEN upper(c) IN ('CON', 'PRN', 'AUX', 'NUL') THEN c || '_' ELSE c END)[1]"


def sql_file_name(x: str) -> str:
    """The name of a title's file, for sources that end in .pdf."""
    bare = "CASE WHEN lower(s) LIKE '%.pdf' THEN " + sql_strip("substr(s, 1, length(s) - 4)") + " ELSE s END"
    return f"list_transform(list_transform([{sql_component(x)}], lambda s: coalesce(nullif({bare}, ''), 'Untitled')), lambda b: {sql_cut('b', 169)} || '.pdf')[1]"


SQL = {
    "docs": """docs AS (SELECT source || '/' || lang || '/' || doc_id || '.pdf' AS path, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS bytes, source || '_' || doc_id || '.pdf' AS file_name,
  CAST(ceil(n_chars / 1800) AS INTEGER) AS page_count, split_part(text, chr(10), 1) AS pdf_title, text, doc_id, lang, source FROM documents)""",
    "digests": """digests AS (SELECT hash, path, bytes, page_count, CASE WHEN length(pdf_title) > 40 THEN pdf_title ELSE 'unknown' END AS title, source AS game_system, 'texts in ' || lang AS doc_type,
  'unknown' AS setting, 'unknown' AS level_range, CASE WHEN bytes > 2000 THEN 'House of Prose' ELSE 'unknown' END AS publisher, [lang, lang, source] AS topics, pdf_title AS summary,
  CAST(CAST(0.25 AS FLOAT) + CAST(0.1 AS FLOAT) * CAST(least(page_count, 4) AS FLOAT) AS FLOAT) AS confidence FROM docs)""",
    "log": "log AS (SELECT CAST(user_id AS VARCHAR) AS hash, ts, event_id, event_type AS title, CAST(value AS FLOAT) AS confidence FROM events)",
    "runs": f"""tags AS (SELECT page_id AS doc, regexp_extract_all(html, '{TAGS}', 1) AS tag, regexp_extract_all(html, '{TAGS}', 2) AS raw FROM pages),
els AS (SELECT doc, CAST(unnest(generate_series(0, len(tag) - 1)) AS INTEGER) AS seq, unnest(tag) AS tag, unnest(raw) AS raw FROM tags),
runs AS (SELECT doc, CAST(seq // 12 + 1 AS INTEGER) AS page, seq, CAST(CASE tag WHEN 'h1' THEN 30 WHEN 'h2' THEN 24 WHEN 'h3' THEN 20 WHEN 'b' THEN 22 ELSE 10 END AS FLOAT) AS size,
  CAST((seq % 12) // 2 * 40 AS FLOAT) AS top, CAST(seq % 2 * 100 AS FLOAT) AS "left", CAST((seq % 12) // 2 * 40 + CASE tag WHEN 'h1' THEN 30 WHEN 'h2' THEN 24 WHEN 'h3' THEN 20 WHEN 'b' THEN 22 ELSE 10 END AS FLOAT) AS baseline, raw AS text FROM els),
headings AS (SELECT * FROM runs WHERE size >= 20)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
