"""The registered queries over a test directory, each with its oracle in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables, text
from ..operators import cachelog, catalog, dedupe, enrich, filing, modeling, outline, report, taxonomy
from ..sources import files
from . import relations as rel
from .config import Config
from .plan import build_plan

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


W = rel.with_views

# Fingerprints and duplicates


@query(W("docs") + " SELECT path, hash, bytes FROM docs")
def q_fingerprint(spark, sf):
    return rel.documents(spark, sf).select("path", "hash", "bytes")


@query(W("docs") + " SELECT hash, path, bytes FROM docs QUALIFY row_number() OVER (PARTITION BY hash ORDER BY len(string_split(path, '/')), string_split(path, '/')) = 1")
def q_exact_dedup_kept(spark, sf):
    return dedupe.exact_dedup(rel.documents(spark, sf).select("path", "hash", "bytes")).select("hash", "path", "bytes")


_GROUPS = W("docs") + ", g AS (SELECT hash, list(path ORDER BY len(string_split(path, '/')), string_split(path, '/')) AS p FROM docs GROUP BY hash HAVING count(*) > 1)"


@query(_GROUPS + " SELECT hash, p[1] AS kept, array_to_string(p[2:], '|') AS others FROM g")
def q_exact_dup_groups(spark, sf):
    return dedupe.exact_groups(rel.documents(spark, sf)).withColumn("others", F.array_join("others", "|"))


@query(_GROUPS + " SELECT CAST(coalesce(sum(len(p) - 1), 0) AS BIGINT) AS duplicates FROM g")
def q_surplus_copies(spark, sf):
    return dedupe.surplus(dedupe.exact_copies(rel.documents(spark, sf)))


@query(W("docs") + " SELECT path, page_count FROM docs QUALIFY count(*) OVER (PARTITION BY page_count) > 1")
def q_contested(spark, sf):
    return dedupe.contested(rel.documents(spark, sf)).select("path", "page_count")


_KEYED = W("docs") + f""", keyed AS (SELECT *, regexp_replace(text, '{rel._SPACE}+', '', 'g') AS ink FROM docs),
keys AS (SELECT path, hash, bytes, page_count, CASE WHEN length(ink) >= 500 THEN sha256(ink) END AS text_key FROM keyed)"""


@query(_KEYED + " SELECT path, text_key FROM keys")
def q_text_key(spark, sf):
    return rel.documents(spark, sf).select("path", text.text_key(F.col("text"), 500).alias("text_key"))


_LEADERS = _KEYED.replace("WITH ", "WITH RECURSIVE ", 1) + """, sizes AS (SELECT DISTINCT page_count, bytes FROM keys WHERE text_key IS NULL),
heads AS (SELECT page_count, max(bytes) AS lead FROM sizes GROUP BY page_count UNION ALL
  SELECT page_count, lead FROM (SELECT h.page_count, max(s.bytes) AS lead FROM heads h JOIN sizes s ON s.page_count IS NOT DISTINCT FROM h.page_count AND s.bytes < h.lead
    AND CAST(h.lead - s.bytes AS FLOAT) / CAST(greatest(h.lead, 1) AS FLOAT) > CAST(0.05 AS FLOAT) GROUP BY h.page_count, h.lead) WHERE lead IS NOT NULL),
led AS (SELECT k.*, coalesce(k.text_key, 'size:' || (SELECT min(h.lead) FROM heads h WHERE h.page_count IS NOT DISTINCT FROM k.page_count AND h.lead >= k.bytes)) AS grp FROM keys k),
final AS (SELECT *, first_value(path) OVER (PARTITION BY page_count, grp ORDER BY bytes DESC, string_split(path, '/')) AS leader FROM led)"""


@query(_LEADERS + " SELECT path, leader FROM final")
def q_near_dup_leader(spark, sf):
    return dedupe.with_leader(rel.documents(spark, sf)).select("path", "leader")


@query(_LEADERS + " SELECT path, hash, bytes FROM final WHERE path = leader")
def q_near_dup_kept(spark, sf):
    return dedupe.near_dedup(rel.documents(spark, sf))[0].select("path", "hash", "bytes")


@query(_LEADERS + ", o AS (SELECT leader, array_to_string(list(path ORDER BY bytes DESC, string_split(path, '/')), '|') AS others FROM final WHERE path <> leader GROUP BY leader) SELECT f.hash, f.path AS kept, o.others FROM o JOIN final f ON f.path = o.leader")
def q_near_dup_groups(spark, sf):
    return dedupe.nested(dedupe.near_dedup(rel.documents(spark, sf))[1]).withColumn("others", F.array_join("others", "|"))


@query(W("docs") + ", kept AS (SELECT hash, path FROM docs QUALIFY row_number() OVER (PARTITION BY hash ORDER BY len(string_split(path, '/')), string_split(path, '/')) = 1) SELECT path FROM kept ORDER BY string_split(path, '/') LIMIT 25")
def q_limit_after_dedup(spark, sf):
    """The limit is the feature: the first documents by path once copies are out."""
    unique = dedupe.exact_dedup(rel.documents(spark, sf).select("path", "hash"))
    return unique.orderBy(dedupe.steps(F.col("path"))).limit(25).select("path")


# Text functions


@query(W("docs") + f" SELECT path, {rel.sql_condense('text', 800)} AS condensed FROM docs")
def q_condense(spark, sf):
    return rel.documents(spark, sf).select("path", text.condense(F.col("text"), 800).alias("condensed"))


@query(W("docs") + f" SELECT path, length(regexp_replace({rel.sql_condense('text', 6000)}, '{rel._SPACE}+', '', 'g')) < 800 AS scanned FROM docs")
def q_scanned(spark, sf):
    return rel.documents(spark, sf).select("path", text.scanned(text.condense(F.col("text"), 6000), 800).alias("scanned"))


_FROM_NAME = r"replace(translate(regexp_replace(file_name, '\.[^.]*$', ''), '_.', '  '), ' - ', ' — ')"


@query(W("docs") + f" SELECT path, {rel.sql_collapse(_FROM_NAME)} AS title FROM docs")
def q_title_from_filename(spark, sf):
    return rel.documents(spark, sf).select("path", text.title_from_filename(F.col("file_name")).alias("title"))


@query(f"SELECT page_id, {rel.sql_component('url')} AS name FROM pages")
def q_sanitize_component(spark, sf):
    return rel.read(spark, sf, "pages").select("page_id", text.sanitize_component(F.col("url")).alias("name"))


@query(f"SELECT page_id, coalesce(nullif(array_to_string(list_transform(list_filter(list_transform(string_split(url, '/'), lambda s: {rel.sql_strip('s')}), lambda s: s NOT IN ('', '.', '..')), lambda s: {rel.sql_component('s')}), '/'), ''), 'Unsorted') AS folder FROM pages")
def q_sanitize_folder(spark, sf):
    return rel.read(spark, sf, "pages").select("page_id", text.sanitize_folder(F.col("url")).alias("folder"))


@query(f"SELECT p_partkey, {rel.sql_file_name('p_name')} AS name FROM part")
def q_file_name(spark, sf):
    return rel.read(spark, sf, "part").select("p_partkey", text.file_name(F.col("p_name"), F.lit("in/source.PDF")).alias("name"))


@query(f"SELECT p_partkey, {rel.sql_title_case('p_type')} AS titled FROM part")
def q_title_case(spark, sf):
    return rel.read(spark, sf, "part").select("p_partkey", text.title_case(F.col("p_type")).alias("titled"))


_JUNK = " OR ".join(f"contains(lower(t), '{j}')" for j in tables.JUNK_TITLES)


@query(W("docs") + f", s AS (SELECT path, {rel.sql_strip('pdf_title')} AS t FROM docs) SELECT path, (strlen(t) BETWEEN 4 AND 120) AND NOT ({_JUNK}) AND regexp_matches(t, '\\pL') AS usable FROM s")
def q_usable_title(spark, sf):
    return rel.documents(spark, sf).select("path", text.usable_title(F.col("pdf_title")).alias("usable"))


@query(r"SELECT conv_id, turn, CASE WHEN regexp_matches(t, p) THEN regexp_extract(t, p, 1) || '-' || regexp_extract(t, p, 2) END AS levels FROM (SELECT conv_id, turn, 'For Levels ' || turn || ' to  ' || (turn + 3) || ' ' || text AS t, '(?i)levels?\s+(\d{1,2})\s*(?:-|–|to|through)\s*(\d{1,2})' AS p FROM conversations)")
def q_level_range(spark, sf):
    c = rel.read(spark, sf, "conversations")
    t = F.concat(F.lit("For Levels "), F.col("turn").cast("string"), F.lit(" to  "), (F.col("turn") + 3).cast("string"), F.lit(" "), F.col("text"))
    return c.select("conv_id", "turn", text.level_range(t).alias("levels"))


@query(W("docs") + f" SELECT path, {rel.sql_unknown('pdf_title')} AS unknown_title FROM docs")
def q_is_unknown(spark, sf):
    return rel.documents(spark, sf).select("path", text.is_unknown(F.col("pdf_title")).alias("unknown_title"))


@query(W("docs", "digests") + f" SELECT path, CASE WHEN NOT {rel.sql_unknown('title')} THEN title ELSE regexp_replace(split_part(path, '/', 3), '\\.[^.]*$', '') END AS title FROM digests")
def q_title_or_stem(spark, sf):
    return rel.digests(spark, sf).select("path", text.title_or_stem(F.col("title"), F.col("path")).alias("title"))


_SHOWN = "regexp_replace(html, '<[^<>]*>', '', 'g')"
_PLAIN = f"replace(replace(replace(replace(replace(replace({_SHOWN}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&#160;', ' ')"


@query(f"SELECT page_id, {rel.sql_collapse(_PLAIN)} AS shown FROM pages")
def q_strip_markup(spark, sf):
    return rel.read(spark, sf, "pages").select("page_id", text.strip_markup(F.col("html")).alias("shown"))


@query(W("runs") + " SELECT doc, seq, (length(trim(text)) BETWEEN 3 AND 80) AND len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: length(regexp_replace(w, '[^\\pL]', '', 'g')) >= 2)) > 0 AS heading FROM runs")
def q_plausible_heading(spark, sf):
    return rel.runs(spark, sf).select("doc", "seq", text.plausible_heading(F.col("text")).alias("heading"))


# Catalogue

_DESCRIBED = W("docs") + f""", low AS (SELECT *, lower(file_name) AS n, lower({rel.sql_condense('text', 6000)}) AS b, {rel.sql_condense('text', 6000)} AS cond FROM docs),
found AS (SELECT *, {rel.sql_case(rel.CORPUS_SYSTEMS, 'n', 'b')} AS s, {rel.sql_case(rel.CORPUS_TYPES, 'n', 'b')} AS t, {rel.sql_case([(x.lower(), x) for x in rel.CORPUS_SETTINGS], "(n || ' ' || b)")} AS w,
  length(regexp_replace(cond, '{rel._SPACE}+', '', 'g')) < 800 AS scanned FROM low),
sig AS (SELECT *, CAST(CAST(0.25 AS FLOAT) + CAST(0.1 AS FLOAT) * CAST((s IS NOT NULL)::INT + (t IS NOT NULL)::INT + (w IS NOT NULL)::INT AS FLOAT) AS FLOAT) AS c FROM found)"""


def _probes(spark, sf):
    d = rel.documents(spark, sf)
    cond = text.condense(F.col("text"), 6000)
    return d.withColumn("text", cond).withColumn("scanned", text.scanned(F.col("text"), 800)).withColumn("pdf_title", F.lit(None).cast("string"))


@query(_DESCRIBED + """ SELECT path, coalesce(s, 'system neutral') AS game_system, coalesce(t, 'other') AS doc_type, coalesce(w, 'unknown') AS setting,
CAST(least(CASE WHEN scanned THEN greatest(c - CAST(0.2 AS FLOAT), CAST(0.1 AS FLOAT)) ELSE c END, CAST(0.65 AS FLOAT)) AS FLOAT) AS confidence FROM sig""")
def q_heuristic_digest(spark, sf):
    d = catalog.describe(_probes(spark, sf), rel.CORPUS_SYSTEMS, rel.CORPUS_TYPES, rel.CORPUS_SETTINGS)
    return d.select("path", "game_system", "doc_type", "setting", "confidence")


_BUILTIN = W("docs") + f", low AS (SELECT path, lower(file_name) AS n, lower({rel.sql_condense('text', 6000)}) AS b FROM docs)"


@query(_BUILTIN + f" SELECT path, {rel.sql_case(tables.SYSTEMS, 'n', 'b')} AS game_system, {rel.sql_case(tables.DOC_TYPES, 'n', 'b')} AS doc_type, {rel.sql_case([(x.lower(), x) for x in tables.SETTINGS], "(n || ' ' || b)")} AS setting FROM low")
def q_keyword_lookup(spark, sf):
    d = _probes(spark, sf).select("path", F.lower("file_name").alias("n"), F.lower("text").alias("b"))
    both = F.concat_ws(" ", "n", "b")
    return d.select("path", catalog.first_match(tables.SYSTEMS, F.col("n"), F.col("b")).alias("game_system"), catalog.first_match(tables.DOC_TYPES, F.col("n"), F.col("b")).alias("doc_type"), catalog.first_match([(s.lower(), s) for s in tables.SETTINGS], both).alias("setting"))


@query("SELECT conv_id, turn, CASE WHEN contains(t, 'wizards of the coast') THEN 'Wizards of the Coast' WHEN contains(t, 'paizo') THEN 'Paizo' WHEN contains(t, 'dungeon masters guild') OR contains(t, 'dmsguild') THEN 'DMs Guild' ELSE 'unknown' END AS publisher FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'paizo ' WHEN 'assistant' THEN 'DMsGuild ' ELSE '' END || text AS raw, lower(raw) AS t FROM conversations)")
def q_publisher(spark, sf):
    c = rel.read(spark, sf, "conversations")
    t = F.lower(F.concat(F.when(F.col("role") == "user", "paizo ").when(F.col("role") == "assistant", "DMsGuild ").otherwise(""), F.col("text")))
    return c.select("conv_id", "turn", catalog.publisher(t).alias("publisher"))


_ALIASES = ", ".join(f"('{k}', '{v}')" for k, v in tables.ALIASES.items())
_RAW = "CASE p_size % 6 WHEN 0 THEN ' DnD ' WHEN 1 THEN 'Pathfinder' WHEN 2 THEN '' WHEN 3 THEN 'N/A' WHEN 4 THEN p_brand ELSE 'Gurps' END"


@query(f"SELECT p_partkey, coalesce(o.v, a.v, nullif(trim(raw), ''), 'System Neutral') AS game_system FROM (SELECT p_partkey, {_RAW} AS raw FROM part) LEFT JOIN (VALUES {_ALIASES}) AS a(k, v) ON a.k = lower(trim(raw)) LEFT JOIN (VALUES ('pathfinder', 'House Rules')) AS o(k, v) ON o.k = lower(trim(raw))")
def q_canonical(spark, sf):
    return rel.read(spark, sf, "part").select("p_partkey", catalog.canonical(F.expr(_RAW), {"pathfinder": "House Rules"}).alias("game_system"))


@query("SELECT event_id, CAST(greatest(least(CAST(value / 50 - 0.5 AS FLOAT), CAST(1 AS FLOAT)), CAST(0 AS FLOAT)) AS FLOAT) AS confidence FROM events")
def q_clamp(spark, sf):
    return rel.read(spark, sf, "events").select("event_id", catalog.clamp(F.col("value") / 50 - 0.5).alias("confidence"))


# Taxonomy and filing

_LEAVES = W("docs", "digests") + f""", counts AS (SELECT game_system, doc_type, count(*) AS n FROM digests GROUP BY 1, 2),
leaves AS (SELECT DISTINCT leaf FROM (SELECT game_system || '/' || {rel.sql_title_case('doc_type')} AS leaf FROM counts WHERE n >= 3 UNION ALL SELECT game_system || '/Other' FROM counts) ORDER BY leaf LIMIT 40),
completed AS (SELECT leaf FROM leaves UNION SELECT min(game_system) FROM digests WHERE lower(game_system) NOT IN (SELECT lower(split_part(leaf, '/', 1)) FROM leaves) GROUP BY lower(game_system))"""


@query(_LEAVES + " SELECT leaf FROM leaves")
def q_taxonomy(spark, sf):
    return taxonomy.design(rel.digests(spark, sf))


@query(_LEAVES + " SELECT DISTINCT game_system AS system FROM digests")
def q_systems_present(spark, sf):
    return taxonomy.systems_present(rel.digests(spark, sf))


@query(_LEAVES + " SELECT game_system AS system, CAST(sum(n) AS BIGINT) AS documents FROM counts GROUP BY 1")
def q_system_totals(spark, sf):
    return taxonomy.system_totals(rel.digests(spark, sf))


@query(_LEAVES + " SELECT DISTINCT leaf FROM completed")
def q_complete_taxonomy(spark, sf):
    d = rel.digests(spark, sf)
    return taxonomy.complete(taxonomy.design(d), d)


_FILED = _LEAVES + f""", shaped AS (SELECT *, game_system || '/' || {rel.sql_title_case('doc_type')} AS exact, game_system || '/Other' AS misc, lower(game_system || ' ' || doc_type || ' ' || title) AS hay FROM digests),
scored AS (SELECT s.path, c.leaf, len(list_filter(string_split_regex(replace(c.leaf, '/', ' '), ' +'), lambda w: strlen(w) > 3 AND contains(s.hay, lower(w)))) AS n FROM shaped s, (SELECT DISTINCT leaf FROM completed) c),
closest AS (SELECT path, leaf FROM scored QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, leaf DESC) = 1),
filed AS (SELECT s.*, CASE WHEN exact IN (SELECT leaf FROM completed) THEN exact WHEN misc IN (SELECT leaf FROM completed) THEN misc ELSE c.leaf END AS folder0,
  CASE WHEN exact IN (SELECT leaf FROM completed) THEN confidence WHEN misc IN (SELECT leaf FROM completed) THEN greatest(confidence - CAST(0.15 AS FLOAT), CAST(0 AS FLOAT)) ELSE greatest(confidence - CAST(0.3 AS FLOAT), CAST(0 AS FLOAT)) END AS fc,
  CASE WHEN exact IN (SELECT leaf FROM completed) THEN '{filing.EXACT}' WHEN misc IN (SELECT leaf FROM completed) THEN '{filing.MISC}' ELSE '{filing.CLOSEST}' END AS reason0 FROM shaped s JOIN closest c USING (path)),
gated AS (SELECT *, CASE WHEN fc >= CAST(0.45 AS FLOAT) THEN folder0 ELSE '_Unsorted' END AS folder, CASE WHEN fc >= CAST(0.45 AS FLOAT) THEN reason0 ELSE 'low confidence for "' || folder0 || '": ' || reason0 END AS reason FROM filed),
sized AS (SELECT *, count(*) OVER (PARTITION BY folder) AS n FROM gated),
folded AS (SELECT *, CASE WHEN n < 3 AND folder <> '_Unsorted' AND contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') ELSE folder END AS folder2,
  CASE WHEN n < 3 AND folder <> '_Unsorted' AND contains(folder, '/') THEN reason || '; folded up from thin folder "' || folder || '"' ELSE reason END AS reason2 FROM sized)"""


def _filed(spark, sf):
    d = rel.digests(spark, sf)
    leaves = taxonomy.complete(taxonomy.design(d), d)
    return filing.file_documents(d, leaves), leaves


@query(_FILED + " SELECT path, folder0 AS folder, fc AS filing_confidence, reason0 AS reason FROM filed")
def q_filing(spark, sf):
    return _filed(spark, sf)[0].select("path", "folder", "filing_confidence", "reason")


@query(_FILED + " SELECT path, folder, reason FROM gated")
def q_unsorted_gate(spark, sf):
    return filing.gate(_filed(spark, sf)[0]).select("path", "folder", "reason")


@query(_FILED + " SELECT path, folder2 AS folder, reason2 AS reason FROM folded")
def q_fold_thin(spark, sf):
    return taxonomy.fold_thin(filing.gate(_filed(spark, sf)[0])).select("path", "folder", "reason")


@query(_FILED + " SELECT DISTINCT folder2 AS leaf FROM folded WHERE EXISTS (SELECT 1 FROM folded WHERE folder2 <> folder) UNION SELECT leaf FROM completed WHERE NOT EXISTS (SELECT 1 FROM folded WHERE folder2 <> folder)")
def q_leaves_after(spark, sf):
    filed, leaves = _filed(spark, sf)
    gated = filing.gate(filed)
    return taxonomy.leaves_after(leaves, gated, taxonomy.fold_thin(gated)).distinct()


_PATHS = W("docs", "digests") + f""", named AS (SELECT path, game_system || '/' || {rel.sql_file_name("title")} AS claim FROM digests),
numbered AS (SELECT path, claim, row_number() OVER (PARTITION BY claim ORDER BY string_split(path, '/')) AS n FROM named)"""


@query(_PATHS + " SELECT path, CASE WHEN n = 1 THEN claim ELSE regexp_replace(claim, '\\.pdf$', '') || ' (' || n || ').pdf' END AS dest FROM numbered")
def q_assign_paths(spark, sf):
    return filing.assign_paths(rel.digests(spark, sf).select("path", "title", F.col("game_system").alias("folder"))).select("path", "dest")


# The digest log


@query(W("log") + " SELECT hash, event_id, title, confidence FROM log QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ts DESC, event_id DESC) = 1")
def q_cache_last_wins(spark, sf):
    return cachelog.last_wins(rel.log(spark, sf)).select("hash", "event_id", "title", "confidence")


_CACHE = W("docs", "digests") + ", cache AS (SELECT hash, max(path) AS path, max(title) AS title, max(confidence) AS confidence, max(doc_id) AS seq FROM (SELECT d.*, o.doc_id FROM digests d JOIN docs o USING (path)) WHERE bytes > 1500 GROUP BY hash)"


def _cache(spark, sf):
    d = rel.digests(spark, sf).join(rel.documents(spark, sf).select("path", "doc_id"), "path").filter("bytes > 1500")
    return d.groupBy("hash").agg(F.max("path").alias("path"), F.max("title").alias("title"), F.max("confidence").alias("confidence"), F.max("doc_id").alias("seq"))


@query(_CACHE + " SELECT path, hash FROM docs WHERE hash NOT IN (SELECT hash FROM cache)")
def q_cache_pending(spark, sf):
    return cachelog.split_pending(rel.documents(spark, sf).select("path", "hash"), _cache(spark, sf))[1].select("path", "hash")


@query(_CACHE + " SELECT d.path, d.hash, c.title, c.confidence FROM docs d JOIN cache c USING (hash)")
def q_cache_described(spark, sf):
    return cachelog.split_pending(rel.documents(spark, sf).select("path", "hash"), _cache(spark, sf))[0].select("path", "hash", "title", "confidence")


_EDITED = _CACHE + """, edited AS (SELECT path, CASE WHEN lang = 'en' THEN sha256(text || ' edited') ELSE hash END AS hash FROM docs),
fresh AS (SELECT path, min(hash) AS new_hash FROM edited WHERE hash NOT IN (SELECT hash FROM cache) GROUP BY path),
movers AS (SELECT path, arg_max(hash, (seq, hash)) AS hash FROM cache GROUP BY path),
moves AS (SELECT new_hash, min(m.hash) AS hash FROM movers m JOIN fresh USING (path) GROUP BY new_hash)"""


@query(_EDITED + " SELECT coalesce(m.new_hash, c.hash) AS hash, c.path, c.title FROM cache c LEFT JOIN moves m ON m.hash = c.hash")
def q_cache_rekey(spark, sf):
    docs = rel.documents(spark, sf)
    edited = docs.select("path", F.when(F.col("lang") == "en", F.sha2(F.concat("text", F.lit(" edited")), 256)).otherwise(F.col("hash")).alias("hash"))
    return cachelog.rekey(_cache(spark, sf), edited).select("hash", "path", "title")


@query(W("log") + " SELECT event_id, confidence FROM log WHERE confidence >= CAST(20 AS FLOAT)")
def q_cache_drop_below(spark, sf):
    return cachelog.drop_below(rel.log(spark, sf), 20.0).select("event_id", "confidence")


@query(W("docs", "digests") + f" SELECT path, title FROM digests WHERE NOT {rel.sql_unknown('title')}")
def q_cache_drop_unnamed(spark, sf):
    return cachelog.drop_unnamed(rel.digests(spark, sf)).select("path", "title")


@query(_CACHE + " SELECT count(*) FILTER (WHERE hash IN (SELECT hash FROM cache)) AS described, count(*) FILTER (WHERE hash NOT IN (SELECT hash FROM cache)) AS pending, (SELECT count(*) FROM cache) AS entries FROM docs")
def q_cache_state(spark, sf):
    return cachelog.state(rel.documents(spark, sf).select("path", "hash"), _cache(spark, sf))


# Outlines

_CLEAN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(text, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&#160;', ' '), '\\s+', ' ', 'g'), ' ')"


@query(W("runs") + f" SELECT doc, page, size, top, \"left\", baseline, {_CLEAN} AS text FROM runs WHERE {_CLEAN} <> ''")
def q_text_runs(spark, sf):
    return outline.text_runs(rel.layouts(spark, sf)).drop("seq")


_BODY = W("runs") + ", chars AS (SELECT doc, size, sum(length(text)) AS chars FROM runs GROUP BY 1, 2), body AS (SELECT doc, size AS body FROM chars QUALIFY row_number() OVER (PARTITION BY doc ORDER BY chars DESC, size DESC) = 1)"


@query(_BODY + " SELECT doc, body FROM body WHERE body > 0")
def q_body_size(spark, sf):
    return outline.body_size(rel.runs(spark, sf))


@query(_BODY + " SELECT doc, seq, text FROM runs JOIN body USING (doc) WHERE size >= CAST(body * CAST(1.6 AS FLOAT) AS FLOAT)")
def q_large_runs(spark, sf):
    return outline.large_runs(rel.runs(spark, sf)).select("doc", "seq", "text")


def _lines(source: str) -> str:
    """Tables of the lines that the runs of a table make: first which runs stand in a line, then the runs of a line joined one by one."""
    return f""", placed AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, baseline, seq) AS i FROM {source}),
lined AS (SELECT doc, i, page, baseline AS first, 1 AS line FROM placed WHERE i = 1 UNION ALL
  SELECT p.doc, p.i, p.page, CASE WHEN p.page = l.page AND abs(p.baseline - l.first) <= 4 THEN l.first ELSE p.baseline END, CASE WHEN p.page = l.page AND abs(p.baseline - l.first) <= 4 THEN l.line ELSE l.line + 1 END
  FROM lined l JOIN placed p ON p.doc = l.doc AND p.i = l.i + 1),
across AS (SELECT p.*, l.line, row_number() OVER (PARTITION BY p.doc, l.line ORDER BY p."left", p.baseline, p.seq) AS k FROM lined l JOIN placed p ON p.doc = l.doc AND p.i = l.i),
joined AS (SELECT doc, line, k, page, baseline, seq, size, top, "left", text FROM across WHERE k = 1 UNION ALL
  SELECT j.doc, j.line, a.k, j.page, j.baseline, j.seq, greatest(j.size, a.size), CASE WHEN ends_with(j.text, a.text) THEN j.top ELSE least(j.top, a.top) END, j."left",
    CASE WHEN ends_with(j.text, a.text) THEN j.text WHEN length(string_split(j.text, ' ')[-1]) = 1 AND regexp_matches(a.text, '^\\p{{Lu}}') THEN j.text || a.text ELSE j.text || ' ' || a.text END
  FROM joined j JOIN across a ON a.doc = j.doc AND a.line = j.line AND a.k = j.k + 1),
lines AS (SELECT * FROM joined QUALIFY k = max(k) OVER (PARTITION BY doc, line))"""


def _headers(source: str) -> str:
    """Tables of the lines of a table that do not repeat the line kept last."""
    return f""", marked AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, top, seq) AS i FROM {source}),
kept AS (SELECT doc, i, page AS kp, text AS kt, true AS keep FROM marked WHERE i = 1 UNION ALL
  SELECT m.doc, m.i, CASE WHEN m.text = k.kt AND m.page - k.kp <= 1 THEN k.kp ELSE m.page END, CASE WHEN m.text = k.kt AND m.page - k.kp <= 1 THEN k.kt ELSE m.text END, NOT (m.text = k.kt AND m.page - k.kp <= 1)
  FROM kept k JOIN marked m ON m.doc = k.doc AND m.i = k.i + 1),
stayed AS (SELECT m.*, CAST(row_number() OVER (PARTITION BY m.doc ORDER BY m.i) - 1 AS INTEGER) AS pos FROM kept k JOIN marked m ON m.doc = k.doc AND m.i = k.i WHERE k.keep)"""


_RUNS = W("runs").replace("WITH ", "WITH RECURSIVE ", 1)


@query(_RUNS + _lines("runs") + ' SELECT doc, page, baseline, seq, size, top, "left", text FROM lines')
def q_join_lines(spark, sf):
    return outline.join_lines(rel.runs(spark, sf))


_PLAUSIBLE = "(length(trim(text)) BETWEEN 3 AND 80) AND len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: length(regexp_replace(w, '[^\\pL]', '', 'g')) >= 2)) > 0"
_LARGE = """, chars AS (SELECT doc, size, sum(length(text)) AS chars FROM runs GROUP BY 1, 2), body AS (SELECT doc, size AS body FROM chars QUALIFY row_number() OVER (PARTITION BY doc ORDER BY chars DESC, size DESC) = 1),
large AS (SELECT runs.* FROM runs JOIN body USING (doc) WHERE body > 0 AND size >= CAST(body * CAST(1.2 AS FLOAT) AS FLOAT))"""


@query(_RUNS + _LARGE + _lines("large") + f", likely AS (SELECT doc, page, seq, size, top, text FROM lines WHERE {_PLAUSIBLE})" + _headers("likely") + " SELECT doc, pos AS seq, page, top, size, text FROM stayed")
def q_headings(spark, sf):
    return outline.headings(rel.runs(spark, sf), 1.2)


@query(_RUNS + _headers("runs") + " SELECT doc, page, text, pos AS seq FROM stayed")
def q_running_header(spark, sf):
    return outline.drop_running_headers(rel.runs(spark, sf)).select("doc", "page", "text", "seq")


_NESTED = W("runs") + ", nested AS (SELECT doc, seq, page, text, CAST(least(dense_rank() OVER (PARTITION BY doc ORDER BY size DESC) - 1, 2) AS INTEGER) AS level FROM headings)"


@query(_NESTED + " SELECT doc, seq, level FROM nested")
def q_nest(spark, sf):
    return outline.nest(rel.headings(spark, sf)).select("doc", "seq", F.col("level").cast("int").alias("level"))


_TREE = _NESTED + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY seq) - 1 AS i FROM nested),
deep AS (SELECT *, CAST(i + least(0, min(level - i) OVER (PARTITION BY doc ORDER BY seq)) AS INTEGER) AS depth FROM numbered),
tree AS (SELECT d.*, (SELECT max(p.seq) FROM deep p WHERE p.doc = d.doc AND p.seq < d.seq AND p.depth = d.depth - 1) AS parent FROM deep d)"""


@query(_TREE + " SELECT doc, seq, depth, parent, lag(seq) OVER w AS prev, lead(seq) OVER w AS next FROM tree WINDOW w AS (PARTITION BY doc, parent ORDER BY seq)")
def q_tree(spark, sf):
    return outline.tree(outline.nest(rel.headings(spark, sf))).select("doc", "seq", "depth", "parent", "prev", "next")


@query(_TREE + """ SELECT t.doc, t.seq, CAST((SELECT count(*) FROM tree x WHERE x.doc = t.doc AND x.seq > t.seq AND x.seq < coalesce((SELECT min(y.seq) FROM tree y WHERE y.doc = t.doc AND y.seq > t.seq AND y.depth <= t.depth), 1000000)) AS INTEGER) AS below,
(SELECT min(c.seq) FROM tree c WHERE c.doc = t.doc AND c.parent = t.seq) AS first_child, (SELECT max(c.seq) FROM tree c WHERE c.doc = t.doc AND c.parent = t.seq) AS last_child FROM tree t""")
def q_tree_counts(spark, sf):
    placed = outline.tree(outline.nest(rel.headings(spark, sf)))
    return outline.with_counts(placed).select("doc", "seq", "below", "first_child", "last_child")


@query(W("runs") + ", lasts AS (SELECT doc, max(page) - 1 AS last_page FROM runs GROUP BY doc) SELECT doc, seq, page FROM headings JOIN lasts USING (doc) WHERE page BETWEEN 1 AND last_page")
def q_within_pages(spark, sf):
    lasts = rel.runs(spark, sf).groupBy("doc").agg((F.max("page") - 1).alias("last_page"))
    return outline.within_pages(rel.headings(spark, sf).join(lasts, "doc")).select("doc", "seq", "page")


@query(W("runs") + ", objects AS (SELECT doc, page, min(seq) * 7 AS object FROM runs WHERE page <> 2 GROUP BY doc, page), firsts AS (SELECT doc, arg_min(object, page) AS f FROM objects GROUP BY doc) SELECT h.doc, h.seq, CAST(coalesce(o.object, f.f) AS INTEGER) AS object FROM headings h LEFT JOIN objects o ON o.doc = h.doc AND o.page = h.page LEFT JOIN firsts f ON f.doc = h.doc")
def q_page_objects(spark, sf):
    pages = rel.runs(spark, sf).filter("page <> 2").groupBy("doc", "page").agg((F.min("seq") * 7).alias("object"))
    return outline.page_objects(rel.headings(spark, sf), pages).select("doc", "seq", F.col("object").cast("int").alias("object"))


@query(W("runs") + ", h AS (SELECT DISTINCT doc FROM headings WHERE size >= 30), k AS (SELECT DISTINCT doc FROM runs WHERE length(text) > 150) SELECT doc, CASE WHEN doc IN (SELECT doc FROM k) THEN 'cached' WHEN pages < 3 THEN 'too_short' WHEN doc NOT IN (SELECT doc FROM h) THEN 'no_headings' ELSE 'derive' END AS status FROM (SELECT doc, max(page) AS pages FROM runs GROUP BY doc)")
def q_outline_status(spark, sf):
    runs = rel.runs(spark, sf)
    docs = runs.groupBy("doc").agg(F.max("page").alias("page_count"))
    return outline.outline_status(docs, runs.filter(F.length("text") > 150), runs.filter("size >= 30"), min_pages=3)


# Enrichment


@query(W("docs", "digests") + """ SELECT path, CASE WHEN title <> 'unknown' THEN title END AS meta_title, CASE WHEN publisher <> 'unknown' THEN publisher END AS meta_author, CASE WHEN trim(summary) <> '' THEN summary END AS meta_subject,
game_system || ', ' || doc_type || ', ' || topics[1] || ', ' || topics[3] AS meta_keywords FROM digests""")
def q_metadata_fields(spark, sf):
    return enrich.metadata_fields(rel.digests(spark, sf)).select("path", "meta_title", "meta_author", "meta_subject", "meta_keywords")


@query(W("docs", "digests") + " SELECT path, CASE WHEN publisher IS NOT NULL AND (confidence >= CAST(0.6 AS FLOAT) OR coalesce(old, '') = '') THEN publisher ELSE old END AS kept FROM (SELECT *, CASE WHEN page_count > 1 THEN summary WHEN bytes > 900 THEN '' END AS old FROM digests)")
def q_overwrite(spark, sf):
    old = F.when(F.col("page_count") > 1, F.col("summary")).when(F.col("bytes") > 900, "")
    return rel.digests(spark, sf).select("path", enrich.overwrite(old, F.col("publisher"), F.col("confidence")).alias("kept"))


@query("SELECT l_orderkey, l_linenumber, b = 0 OR (a >= b // 2 AND a <= b + greatest(CAST(trunc(CAST(b AS FLOAT) * CAST(0.25 AS FLOAT)) AS BIGINT), 1048576)) AS plausible FROM (SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) * 200000 AS b, CAST(trunc(l_extendedprice) AS BIGINT) * 150 AS a FROM lineitem)")
def q_plausible_rewrite(spark, sf):
    li = rel.read(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", enrich.plausible_rewrite(F.col("l_quantity").cast("long") * 200000, F.col("l_extendedprice").cast("long") * 150).alias("plausible"))


@query(W("docs", "digests") + ", o AS (SELECT hash, count(*) AS n FROM docs GROUP BY hash HAVING count(*) > 1) SELECT path, coalesce(n, 0) AS entries FROM (SELECT * FROM digests WHERE title <> 'unknown' OR hash IN (SELECT hash FROM o)) LEFT JOIN o USING (hash)")
def q_enrichment_wanted(spark, sf):
    d = rel.digests(spark, sf).withColumn("meta_title", F.when(F.col("title") != "unknown", F.col("title")))
    outlines = rel.documents(spark, sf).groupBy("hash").agg(F.collect_list("path").alias("entries")).filter("size(entries) > 1")
    return enrich.wanted(d, outlines).select("path", F.greatest(F.size(F.coalesce("entries", F.array())), F.lit(0)).cast("long").alias("entries"))


@query("SELECT count(*) FILTER (WHERE d) AS refreshed, count(*) FILTER (WHERE d AND value > 20) AS stamped, count(*) FILTER (WHERE d AND user_id % 5 > 0) AS indexed, CAST(coalesce(sum(user_id % 5) FILTER (WHERE d), 0) AS BIGINT) AS bookmarks, count(*) FILTER (WHERE NOT d) AS skipped FROM (SELECT *, event_type <> 'click' AS d FROM events)")
def q_enrich_outcome(spark, sf):
    e = rel.read(spark, sf, "events")
    rows = e.select((F.col("value") > 20).alias("stamped"), (F.col("user_id") % 5).alias("bookmarks"), F.when(F.col("event_type") == "click", "skip").alias("skipped"))
    return enrich.outcome(rows)


# Reports


def _assigned(spark, sf):
    d = rel.digests(spark, sf)
    return d.select("path", F.concat_ws("/", "game_system", "doc_type").alias("leaf"), F.concat_ws("/", F.lit("out"), F.col("game_system"), F.when(F.col("page_count") > 1, F.concat(F.col("title"), F.lit(".pdf"))).otherwise(text.base_name(F.col("path")))).alias("dest"), "confidence")


_ASSIGNED = W("docs", "digests") + ", assigned AS (SELECT path, game_system || '/' || doc_type AS leaf, 'out/' || game_system || '/' || CASE WHEN page_count > 1 THEN title || '.pdf' ELSE split_part(path, '/', 3) END AS dest, confidence FROM digests)"


@query(_ASSIGNED + " SELECT leaf, count(*) AS documents FROM assigned GROUP BY leaf")
def q_folder_counts(spark, sf):
    return report.folder_counts(_assigned(spark, sf))


@query(_ASSIGNED + """, c AS (SELECT leaf, count(*) AS n FROM assigned GROUP BY leaf), t AS (SELECT leaf, n, split_part(leaf, '/', 1) AS a, split_part(leaf, '/', 2) AS b, lag(split_part(leaf, '/', 1)) OVER (ORDER BY leaf) AS before FROM c)
SELECT leaf, 0 AS depth, a || '/' AS line FROM t WHERE a IS DISTINCT FROM before UNION ALL SELECT leaf, 1, '  ' || b || '/  (' || n || ')' FROM t""")
def q_report_tree(spark, sf):
    return report.tree_lines(_assigned(spark, sf))


@query(_ASSIGNED + """ SELECT leaf, dest, '    ' || regexp_extract(dest, '[^/]*$') || '  [' || printf('%.2f', CAST(confidence AS DOUBLE)) || ']' || CASE WHEN regexp_extract(dest, '[^/]*$') = split_part(path, '/', 3) THEN '' ELSE chr(10) || '      was: ' || split_part(path, '/', 3) END AS line FROM assigned""")
def q_document_lines(spark, sf):
    return report.document_lines(_assigned(spark, sf))


@query(_ASSIGNED + ", g AS (SELECT count(*) - 1 AS n FROM docs GROUP BY hash HAVING count(*) > 1) SELECT (SELECT count(DISTINCT leaf) FROM assigned) AS folders, (SELECT count(*) FROM assigned) AS filed, CAST(0 AS BIGINT) AS unsorted, (SELECT count(*) FROM assigned WHERE regexp_extract(dest, '[^/]*$') <> split_part(path, '/', 3)) AS renamed, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM g) AS duplicates, (SELECT count(*) FROM docs WHERE bytes < 100) AS unreadable")
def q_plan_summary(spark, sf):
    a, d = _assigned(spark, sf), rel.documents(spark, sf)
    return report.summary(a, a.select("leaf").distinct(), dedupe.exact_copies(d), d.filter("bytes < 100").select("path"))


@query("SELECT string_split(r, ' from ')[1] AS why, count(*) AS documents FROM (SELECT event_type || ' failed' || CASE WHEN value > 10 THEN ' from user ' || user_id || ' from there' ELSE '' END AS r FROM events) GROUP BY 1")
def q_skip_summary(spark, sf):
    e = rel.read(spark, sf, "events")
    reason = F.concat(F.col("event_type"), F.lit(" failed"), F.when(F.col("value") > 10, F.concat(F.lit(" from user "), F.col("user_id").cast("string"), F.lit(" from there"))).otherwise(""))
    return report.skip_summary(e.select(reason.alias("reason")))


@query("SELECT event_type AS status, count(*) AS documents FROM events GROUP BY 1")
def q_apply_counts(spark, sf):
    return report.apply_counts(rel.read(spark, sf, "events").select(F.col("event_type").alias("status")))


@query("SELECT lpad(CAST(event_id AS VARCHAR), 9, '0') AS dest, props AS error, (SELECT count(*) FROM events WHERE event_type = 'click') AS failures FROM events WHERE event_type = 'click' ORDER BY dest LIMIT 10")
def q_first_failures(spark, sf):
    e = rel.read(spark, sf, "events")
    return report.first_failures(e.select(F.when(F.col("event_type") == "click", "failed").otherwise("filed").alias("status"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("dest"), F.col("props").alias("error")))


# The model's side


@query(W("docs", "digests") + """, ranked AS (SELECT '- ' || title || ' | ' || game_system || ' | ' || doc_type || ' | ' || setting || chr(10) AS line, row_number() OVER (ORDER BY string_split(path, '/')) AS n FROM digests)
SELECT CAST((n - 1) // 136 AS INTEGER) AS chunk, 'Catalogue:' || chr(10) || string_agg(line, '' ORDER BY n) || chr(10) || 'Design the leaf folders.' || chr(10) AS catalogue FROM ranked GROUP BY 1""")
def q_catalogue(spark, sf):
    return modeling.catalogue(rel.digests(spark, sf), modeling.catalogue_batch(8192))


@query(W("runs") + " SELECT doc, 'Lines of large type, in reading order:' || chr(10) || string_agg(seq || ': ' || text || '  (page ' || page || ')' || chr(10), '' ORDER BY seq) || chr(10) || 'Which are headings?' || chr(10) AS prompt FROM headings GROUP BY doc")
def q_headings_prompt(spark, sf):
    return modeling.headings_prompt(rel.headings(spark, sf))


@query(W("docs", "digests") + """ SELECT path, 'Folders:' || chr(10) || '- A/B' || chr(10) || '- C' || chr(10) || chr(10) || 'Document:' || chr(10) || '- title: ' || title || chr(10) || '- system: ' || game_system || chr(10) || '- type: ' || doc_type || chr(10) || '- setting: ' || setting || chr(10) || '- levels: ' || level_range || chr(10) || '- topics: ' || array_to_string(topics, ', ') || chr(10) || '- summary: ' || summary || chr(10) || chr(10) || 'File it.' || chr(10) AS prompt FROM digests""")
def q_assign_prompt(spark, sf):
    return rel.digests(spark, sf).select("path", modeling.assign_prompt(["A/B", "C"]).alias("prompt"))


@query("SELECT conv_id, turn, '<|im_start|>system' || chr(10) || 'Answer.' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS wrapped FROM conversations")
def q_chat_template(spark, sf):
    return rel.read(spark, sf, "conversations").select("conv_id", "turn", modeling.chat("chatml", F.lit("Answer."), F.col("text")).alias("wrapped"))


@query(W("docs") + " SELECT path, 'heuristic:' || doc_id AS label FROM docs")
def q_label(spark, sf):
    return rel.documents(spark, sf).select("path", modeling.label("heuristic", F.col("path")).alias("label"))


@query("SELECT event_id, props AS found FROM events")
def q_extract_json(spark, sf):
    e = rel.read(spark, sf, "events")
    prose = F.concat(F.lit("sure, here it is: "), F.col("props"), F.lit(' and more {"k": 1}'))
    return e.select("event_id", modeling.extract_json(prose).alias("found"))


@query("SELECT event_id, event_type AS title, 'unknown' AS setting, CAST(0 AS FLOAT) AS confidence FROM events")
def q_digest_json(spark, sf):
    e = rel.read(spark, sf, "events")
    reply = F.concat(F.lit('Reply: {"title": "'), F.col("event_type"), F.lit('", "game_system": "s", "doc_type": "t", "extra": '), F.col("props"), F.lit("} done"))
    return e.select("event_id", modeling.parse_digest(reply).alias("d")).select("event_id", "d.title", "d.setting", "d.confidence")


@query(W("runs") + ", picks AS (SELECT doc, seq AS i, arg_min(seq % 5, pos) AS l FROM (SELECT doc, seq, unnest([seq, seq + 1]) AS pos FROM runs WHERE size >= 22) GROUP BY doc, seq) SELECT h.doc, h.seq, CAST(least(l, 2) AS INTEGER) AS level FROM headings h JOIN picks p ON p.doc = h.doc AND p.i = h.seq")
def q_chosen_headings(spark, sf):
    picks = rel.runs(spark, sf).filter("size >= 22").select("doc", F.explode(F.array("seq", F.col("seq") + 1)).alias("pos"), F.col("seq").alias("i"), (F.col("seq") % 5).alias("l"))
    return modeling.chosen_headings(picks, rel.headings(spark, sf)).select("doc", "seq", F.col("level").cast("int").alias("level"))


@query(W("docs", "digests") + " SELECT path, game_system IN ('src0', 'src1', 'src2') AS known FROM digests")
def q_checked_folder(spark, sf):
    leaves = spark.createDataFrame([("src0",), ("src1",), ("src2",)], "leaf string")
    d = rel.digests(spark, sf).withColumn("folder", F.col("game_system")).withColumn("filing_confidence", F.col("confidence"))
    return modeling.checked_folder(d, leaves).select("path", "known")


@query(W("docs") + " SELECT DISTINCT split_part(text, chr(10), 2) AS leaf FROM docs WHERE trim(split_part(text, chr(10), 2)) <> ''")
def q_clean_leaves(spark, sf):
    second = F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit(""))
    return modeling.clean_leaves(rel.documents(spark, sf).select(second.alias("leaf")))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def q_first_of_each(spark, sf):
    return modeling.numbered_first(rel.read(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


# Files


@query(W("docs") + f" SELECT path, nullif({rel.sql_collapse('pdf_title')}, '') AS pdf_title, 'A: B' AS pdf_author, CAST(NULL AS VARCHAR) AS pdf_subject, page_count FROM docs")
def q_info_fields(spark, sf):
    d = rel.documents(spark, sf)
    info = F.concat(F.lit("Title:   "), F.col("pdf_title"), F.lit("\nAuthor: A: B\nSubject:  \nProducer: none\nno colon\nPages:  "), F.col("page_count").cast("string"), F.lit("\n"))
    return files.info_fields(d.select("path", info.alias("info"))).select("path", "pdf_title", "pdf_author", "pdf_subject", "page_count")


@query(W("docs") + " SELECT path, substr(sha256(path), 1, 16) AS name FROM docs")
def q_render_name(spark, sf):
    return rel.documents(spark, sf).select("path", files.render_name(F.col("path")).alias("name"))


@query("SELECT max('undo-' || strftime(ts, '%Y%m%dT%H%M%SZ') || '.json') AS manifest FROM events")
def q_latest_manifest(spark, sf):
    name = F.concat(F.lit("undo-"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit(".json"))
    return rel.read(spark, sf, "events").agg(F.max(name).alias("manifest"))


@query("SELECT 'lib/' || event_id AS created, 'src/' || user_id AS original, CASE WHEN event_type = 'click' THEN 'rename' ELSE 'delete' END AS action FROM events")
def q_undo_actions(spark, sf):
    e = rel.read(spark, sf, "events")
    action = F.struct(F.concat(F.lit("lib/"), F.col("event_id").cast("string")).alias("created"), F.concat(F.lit("src/"), F.col("user_id").cast("string")).alias("original"))
    rows = e.groupBy(F.when(F.col("event_type") == "click", "move").otherwise("copy").alias("mode"), "user_id").agg(F.collect_list(action).alias("actions"))
    return files.undo_actions(rows)


# The whole plan


@query()
def q_plan(spark, sf):
    plan = build_plan(rel.documents(spark, sf), Config())
    return plan.assignments.select("hash", "path", "dest", "leaf", "title", "confidence", "reason")
