import bisect
import random
import re
import time

from pyspark.sql import functions as F

from docsmith.operators import cachelog, catalog, dedupe, enrich, filing, modeling, outline, report, taxonomy


def test_exact_dedup_keeps_the_shallowest(spark):
    docs = spark.createDataFrame([("a/b/c.pdf", "h", 1), ("z.pdf", "h", 1), ("a.b", "g", 1), ("a/b", "k", 1), ("y/x.pdf", "h", 1)], "path string, hash string, bytes long")
    assert {r.hash: r.path for r in dedupe.exact_dedup(docs).collect()} == {"h": "z.pdf", "g": "a.b", "k": "a/b"}
    (g,) = dedupe.exact_groups(docs).collect()
    assert (g.kept, g.others) == ("z.pdf", ["y/x.pdf", "a/b/c.pdf"])


def literal_near(docs, tolerance):
    import numpy as np

    leader, groups = {}, {}
    for d in docs:
        groups.setdefault(d[2], []).append(d)
    for group in groups.values():
        group = sorted(group, key=lambda d: (-d[1], d[0].split("/")))
        while group:
            head, rest = group[0], []
            leader[head[0]] = head[0]
            for d in group[1:]:
                if head[3] and d[3]:
                    same = head[3] == d[3]
                elif head[3] or d[3]:
                    same = False
                else:
                    same = np.float32(np.float32(head[1] - d[1]) / np.float32(max(head[1], 1))) <= np.float32(tolerance)
                if same:
                    leader[d[0]] = head[0]
                else:
                    rest.append(d)
            group = rest
    return leader


def test_near_duplicates_against_the_literal_procedure(spark):
    rng = random.Random(6)
    docs = [(f"d{i}/x{i}.pdf", rng.choice([96, 100, 92, 95, 91, rng.randint(1, 3000)]), rng.choice([None, 1, 2, 3]), rng.choice([None, None, "a", "b"])) for i in range(300)]
    df = spark.createDataFrame([(p, f"h{p}", b, n, k) for p, b, n, k in docs], "path string, hash string, bytes long, page_count int, text_key string")
    assert {r.path: r.leader for r in dedupe.with_leader(df).collect()} == literal_near(docs, 0.05)


def digest_of(spark, name, body, scanned=False, title=None):
    return catalog.describe(spark.createDataFrame([(name, title, body, scanned)], "file_name string, pdf_title string, text string, scanned boolean")).first()


def test_rule_digests(spark):
    d = digest_of(spark, "starfinder bestiary.pdf", "beasts of the outer belt")
    assert (d.game_system, d.doc_type) == ("Starfinder", "bestiary")
    assert digest_of(spark, "roll one.pdf", "a random table of weather").doc_type == "random tables"
    assert digest_of(spark, "q.pdf", "a module, Levels 2 through 9").level_range == "2-9"
    scan = digest_of(spark, "Hill Walks.pdf", "", True)
    assert scan.confidence < 0.4 and scan.title == "Hill Walks" and scan.game_system == "system neutral"
    best = digest_of(spark, "shadowrun gazetteer.pdf", "Golarion by Paizo, level 3 to 4", title="  A Given Title ")
    assert abs(best.confidence - 0.65) < 1e-6 and best.publisher == "Paizo" and best.title == "A Given Title"


def digests(spark, rows):
    return spark.createDataFrame([(f"p{i:02d}.pdf", s, t, title, c) for i, (s, t, title, c) in enumerate(rows)], "path string, game_system string, doc_type string, title string, confidence float")


def test_filing(spark):
    leaves = spark.createDataFrame([("D&D 5e/Adventure",), ("D&D 5e/Other",), ("Maps/Battle Maps",)], "leaf string")
    d = digests(spark, [("D&D 5e", "adventure", "a", 0.45), ("D&D 5e", "spells", "b", 0.65), ("X", "battle things", "c", 0.65), ("D&D 5e", "adventure", "e", 0.25)])
    got = {r.title: r for r in filing.gate(filing.file_documents(d, leaves)).collect()}
    assert got["a"].folder == "D&D 5e/Adventure"
    assert got["b"].folder == "D&D 5e/Other" and abs(got["b"].filing_confidence - 0.5) < 1e-6
    assert got["c"].folder == "_Unsorted" and got["c"].reason == 'low confidence for "Maps/Battle Maps": closest leaf by keyword overlap'
    assert got["e"].folder == "_Unsorted"
    none = filing.file_documents(d, leaves.limit(0)).first()
    assert none.folder == "Other"


def test_taxonomy(spark):
    d = digests(spark, [("D&D 5e", "magic items", "x", 0.5)] * 3 + [("cyberpunk red", "maps", "y", 0.5), ("Cyberpunk Red", "maps", "y", 0.5)])
    assert [r.leaf for r in taxonomy.design(d).orderBy("leaf").collect()] == ["Cyberpunk Red/Other", "D&D 5e/Magic Items", "D&D 5e/Other", "cyberpunk red/Other"]
    few = spark.createDataFrame([("D&D 5e/Adventures",)], "leaf string")
    assert sorted(r.leaf for r in taxonomy.complete(few, d).collect()) == ["Cyberpunk Red", "D&D 5e/Adventures"]


def test_thin_folders(spark):
    rows = spark.createDataFrame([("A/B/C", "r"), ("A/B/D", "r"), ("A/B/D", "r"), ("_Unsorted", "r"), ("Solo", "r")], "folder string, reason string")
    got = sorted((r.folder, r.reason) for r in taxonomy.fold_thin(rows, 2).collect())
    assert got == [("A/B", 'r; folded up from thin folder "A/B/C"'), ("A/B/D", "r"), ("A/B/D", "r"), ("Solo", "r"), ("_Unsorted", "r")]
    assert sorted(r.leaf for r in taxonomy.leaves_after(rows.limit(0).select(F.col("folder").alias("leaf")), rows, taxonomy.fold_thin(rows, 2), 2).collect()) == ["A/B", "A/B/D", "Solo", "_Unsorted"]


def literal_unique(claims):
    taken, out = set(), []
    for c in claims:
        p, n = c, 2
        stem, ext = c[:-4], c[-4:]
        while p in taken:
            p, n = f"{stem} ({n}){ext}", n + 1
        taken.add(p)
        out.append(p)
    return out


def test_paths_never_collide(spark):
    assert filing.settle(["d/x.pdf"] * 3) == ["d/x.pdf", "d/x (2).pdf", "d/x (3).pdf"]
    assert filing.settle(["x", "x", "x (2)"]) == ["x", "x (2)", "x (2) (2)"]
    assert filing.settle(["x (2)", "x", "x"]) == ["x (2)", "x", "x (3)"]
    rng = random.Random(9)
    titles = [rng.choice(["Same", "Same (2)", "Other", "Same (2) (2)", "Other (3)", "Lone", "Twice"]) for _ in range(120)]
    rows = [(f"f{i:03d}/s.pdf", t, "A") for i, t in enumerate(titles)]
    got = {r.path: r.dest for r in filing.assign_paths(spark.createDataFrame(rows, "path string, title string, folder string")).collect()}
    want = literal_unique([f"A/{t}.pdf" for t in titles])
    assert [got[p] for p, _, _ in rows] == want and len(set(want)) == len(want)


def test_names_are_read_once(spark):
    # an extension that looked far behind at every place took more than the ten seconds for these names
    stems = ["a b", "a.b", ".a", "a", "a (2)", "a.b (3) (4)", "(5)"]
    long = ["x" * 100_000 + t for t in ("", " (2)")] * 8
    rows = [(f"d.e/{t}{e}", f"d.e/{t} (7){e}") for t in stems + long for e in (".pdf", ".x (1)")]
    rows += [("d.e/.a", "d.e/.a (7)"), ("a.b", "a (7).b"), ("d/..b", "d/. (7).b"), ("d.e/f", "d.e/f (7)"), ("d.e/f (3)", "d.e/f (3) (7)")]
    frame = spark.createDataFrame(rows, "dest string, want string").repartition(4)
    began = time.perf_counter()
    got = frame.select("dest", "want", filing._numbered(F.col("dest"), F.lit(7)).alias("numbered"), filing._family(F.col("dest")).alias("family")).collect()
    assert time.perf_counter() - began < 10
    for r in got:
        folder, slash, name = r.dest.rpartition("/")
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        assert r.numbered == r.want and r.family == folder + slash + re.sub(r"(?: \([0-9]+\))+$", "", stem) + ext


def test_places_among_bounds(spark):
    rng = random.Random(4)
    for n in (0, 1, 2, 5, 63):
        bounds = sorted({"".join(rng.choices("ab\x00é\U0001f600\uffee", k=rng.randint(1, 3))) for _ in range(n)}, key=str.encode)
        values = bounds + ["", "z", "a", "\U0001f600", "\uffee\uffee"]
        got = spark.createDataFrame([(v,) for v in values], "v string").select("v", filing._place(F.col("v"), bounds).alias("k")).collect()
        assert all(r.k == bisect.bisect_right([b.encode() for b in bounds], r.v.encode()) for r in got)
    assert spark.range(1).select(filing._place(F.lit(None).cast("string"), ["a", "b"]).alias("k")).first().k == 0


def test_folding_deals_nothing_out_by_folder(spark):
    rows = [(f"p{i}", "A/B" if i else "A/C", 0.9, "r") for i in range(400)]
    d = spark.createDataFrame(rows, "path string, folder string, filing_confidence float, reason string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        folded = taxonomy.fold_thin(d)
        assert "SortMergeJoin" not in folded._jdf.queryExecution().executedPlan().toString()
        got = {r.path: (r.folder, r.reason) for r in folded.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 400 and got["p0"] == ("A", 'r; folded up from thin folder "A/C"') and all(got[f"p{i}"] == ("A/B", "r") for i in range(1, 400))


def test_cache_log(spark):
    log = spark.createDataFrame([("h", 1, "a"), ("h", 3, "c"), ("h", 2, "b"), ("k", 1, "z")], "hash string, seq long, title string")
    assert {r.hash: r.title for r in cachelog.last_wins(log).collect()} == {"h": "c", "k": "z"}
    cache = spark.createDataFrame([("old", "a.pdf", 1, "A"), ("same", "b.pdf", 2, "B")], "hash string, path string, seq long, title string")
    docs = spark.createDataFrame([("a.pdf", "new"), ("b.pdf", "same"), ("c.pdf", "more")], "path string, hash string")
    assert sorted((r.hash, r.title) for r in cachelog.rekey(cache, docs).collect()) == [("new", "A"), ("same", "B")]
    known, pending = cachelog.split_pending(docs, cachelog.rekey(cache, docs))
    assert sorted(r.path for r in known.collect()) == ["a.pdf", "b.pdf"] and [r.path for r in pending.collect()] == ["c.pdf"]


def xml(pages, fonts):
    out = "".join(f'<fontspec id="{i}" size="{s}" family="x"/>' for i, s in fonts.items())
    for n, texts in pages:
        out += f'<page number="{n}" top="0">' + "".join(f'<text top="{t}" left="{left}" width="9" height="{h}" font="{f}">{body}</text>\n' for t, left, h, f, body in texts) + "</page>"
    return out


def heading_rows(spark, layout, ratio=1.6):
    df = spark.createDataFrame([("d", layout)], "doc string, xml string")
    return [(r.page, r.text) for r in outline.headings(outline.text_runs(df), ratio).orderBy("seq").collect()]


BODY = "this is the text of the page that goes on for a good while so that it counts"


def test_headings(spark):
    fonts = {0: 40, 1: 12}
    a = xml([(1, [(60, 20, 40, 0, "Part One, the Hills"), (120, 20, 12, 1, BODY), (140, 20, 12, 1, BODY)]), (2, [(60, 20, 40, 0, "Part Two, <i>the Sea</i>"), (120, 20, 12, 1, BODY)])], fonts)
    assert heading_rows(spark, a) == [(1, "Part One, the Hills"), (2, "Part Two, the Sea")]
    caps = xml([(1, [(40, 60, 44, 0, "T"), (40, 150, 44, 0, "R"), (48, 90, 36, 2, "HE"), (48, 180, 36, 2, "IVER"), (220, 10, 10, 1, BODY)])], {0: 33, 1: 10, 2: 26})
    assert heading_rows(spark, caps) == [(1, "THE RIVER")]
    shadow = xml([(1, [(70, 30, 32, 0, "Winds and Tides"), (72, 31, 32, 0, "Winds and Tides"), (220, 10, 10, 1, BODY)])], {0: 32, 1: 10})
    assert heading_rows(spark, shadow) == [(1, "Winds and Tides")]
    order = xml([(1, [(400, 10, 30, 0, "Note on the Margin"), (50, 10, 30, 0, "Setting Out"), (200, 10, 10, 1, BODY)])], {0: 30, 1: 10})
    assert heading_rows(spark, order) == [(1, "Setting Out"), (1, "Note on the Margin")]
    header = xml([(n, [(10, 10, 30, 0, "Heading"), (200, 10, 10, 1, BODY)]) for n in (4, 5, 6, 7)], {0: 30, 1: 10})
    assert heading_rows(spark, header) == [(4, "Heading"), (6, "Heading")]
    drop_cap = xml([(1, [(10, 10, 60, 0, "T"), (200, 10, 10, 1, BODY)])], {0: 60, 1: 10})
    assert heading_rows(spark, drop_cap) == []


def test_body_size_ties_go_to_the_larger(spark):
    runs = spark.createDataFrame([("d", 10.0, "abcd"), ("d", 12.0, "efgh"), ("e", 0.0, "x")], "doc string, size float, text string")
    assert [(r.doc, r.body) for r in outline.body_size(runs).collect()] == [("d", 12.0)]


def literal_lines(runs):
    lines = []
    for r in sorted(runs, key=lambda r: (r["page"], r["baseline"], r["seq"])):
        if lines and lines[-1][0]["page"] == r["page"] and abs(lines[-1][0]["baseline"] - r["baseline"]) <= 4:
            lines[-1].append(r)
        else:
            lines.append([r])
    out = []
    for line in lines:
        line = sorted(line, key=lambda r: (r["left"], r["baseline"], r["seq"]))
        text, size, top = line[0]["text"], line[0]["size"], line[0]["top"]
        for r in line[1:]:
            size = max(size, r["size"])
            if text.endswith(r["text"]):
                continue
            text += r["text"] if len(text.split(" ")[-1]) == 1 and r["text"][0].isupper() else " " + r["text"]
            top = min(top, r["top"])
        out.append((line[0]["page"], text, size, top))
    return sorted(out)


def test_lines_against_the_literal_procedure(spark):
    rng = random.Random(3)
    rows = []
    for doc in range(40):
        for seq in range(rng.randint(1, 14)):
            rows.append({"doc": doc, "page": rng.randint(1, 2), "seq": seq, "size": float(rng.choice([10, 20, 30])), "top": float(rng.randint(0, 12)), "left": float(rng.randint(0, 5)), "baseline": float(rng.randint(0, 25)), "text": rng.choice(["A", "B", "LASS", "ab", "word", "C"])})
    df = spark.createDataFrame(rows, "doc long, page int, seq int, size float, top float, left float, baseline float, text string")
    got = {}
    for r in outline.join_lines(df).collect():
        got.setdefault(r.doc, []).append((r.page, r.text, r.size, r.top))
    for doc in range(40):
        assert sorted(got[doc]) == literal_lines([r for r in rows if r["doc"] == doc])


def literal_tree(levels):
    path, out = 0, []
    for level in levels:
        depth = min(level, path)
        path = depth + 1
        out.append(depth)
    return out


def test_trees(spark):
    rng = random.Random(5)
    cases = [[0, 1, 2, 1, 0], [0, 2], [3, 3]] + [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    df = spark.createDataFrame([(d, i, level) for d, levels in enumerate(cases) for i, level in enumerate(levels)], "doc int, seq int, level int")
    got = {}
    for r in outline.with_counts(outline.tree(df)).collect():
        got.setdefault(r.doc, {})[r.seq] = r
    for d, levels in enumerate(cases):
        depths = literal_tree(levels)
        assert [got[d][i].depth for i in range(len(levels))] == depths
        for i, depth in enumerate(depths):
            parents = [j for j in range(i) if depths[j] == depth - 1]
            assert got[d][i].parent == (parents[-1] if parents else None)
            end = next((j for j in range(i + 1, len(depths)) if depths[j] <= depth), len(depths))
            assert got[d][i].below == end - i - 1
    sizes = spark.createDataFrame([("d", i, s) for i, s in enumerate([45.0, 36.0, 36.0, 23.0])], "doc string, seq int, size float")
    assert [r.level for r in outline.nest(sizes, 4).orderBy("seq").collect()] == [0, 1, 1, 2]
    assert max(r.level for r in outline.nest(sizes, 1).collect()) == 0


def test_metadata(spark):
    d = spark.createDataFrame([("Town Square", "Paizo", "A gridded town square.", "Pathfinder 1e", "maps", "unknown", "unknown", ["battle map", "town"]), ("unknown", "", " ", "x", "x", "y", "x", ["unknown"]), ("Untitled", "unknown", "", "unknown", "", "", "", [])], "title string, publisher string, summary string, game_system string, doc_type string, setting string, level_range string, topics array<string>")
    got = enrich.metadata_fields(d).collect()
    assert got[0].meta_keywords == "Pathfinder 1e, maps, battle map, town" and got[0].meta_author == "Paizo"
    assert got[1].meta_keywords == "x, y, x" and got[1].meta_title is None and got[1].meta_subject is None
    assert got[2].meta_keywords is None
    assert [enrich.may_write(m) for m in ("hardlink", "symlink", "copy", "move")] == [False, False, True, True]
    mb = 1 << 20
    sizes = [(10 * mb, 10 * mb + 500, True), (10 * mb, 4 * mb, False), (10 * mb, 30 * mb, False), (1000, 1500, True), (0, 5000, True)]
    df = spark.createDataFrame(sizes, "b long, a long, want boolean")
    assert all(r.v == r.want for r in df.select("want", enrich.plausible_rewrite(F.col("b"), F.col("a")).alias("v")).collect())


def test_reports(spark):
    a = spark.createDataFrame([("A/B", "A/B/x.pdf", "in/x.pdf", 0.5), ("A/B", "A/B/new.pdf", "in/old.pdf", 0.456), ("A/C/D", "A/C/D/y.pdf", "y.pdf", 0.6), ("E", "E/z.pdf", "z.pdf", 0.6)], "leaf string, dest string, path string, confidence float")
    lines = [r.line for r in report.tree_lines(a).orderBy("leaf", "depth").collect()]
    assert lines == ["A/", "  B/  (2)", "  C/", "    D/  (1)", "E/  (1)"]
    docs = {r.dest: r.line for r in report.document_lines(a).collect()}
    assert docs["A/B/x.pdf"] == "    x.pdf  [0.50]" and docs["A/B/new.pdf"] == "    new.pdf  [0.46]\n      was: old.pdf"


def test_replies(spark):
    cases = [('sure! {"a":1} done', '{"a":1}'), ('{"a":"}"}', '{"a":"}"}'), ("x [1,[2],3] y", "[1,[2],3]"), ('{"a":1', None), (None, None), ("none", None), ('{"a":"\\"}"}', '{"a":"\\"}"}')]
    assert [modeling.first_json(a) for a, _ in cases] == [b for _, b in cases]
    df = spark.createDataFrame([(a,) for a, _ in cases] + [('x {"title": "T", "game_system": "S", "doc_type": "D", "confidence": 0.5, "topics": ["a"]} y',)], "reply string")
    got = [r.d for r in df.select(modeling.parse_digest(F.col("reply")).alias("d")).collect()]
    assert got[:-1] == [None] * len(cases) and got[-1].title == "T" and got[-1].setting == "unknown" and got[-1].topics == ["a"]


def test_grammars_and_budgets():
    assert "[0-9]{1,1}" in modeling.headings_grammar(9, 3) and "[0-9]{1,3}" in modeling.headings_grammar(283, 3)
    for g in (modeling.digest_grammar(), modeling.taxonomy_grammar(), modeling.assign_grammar(["A/B", 'a" | "b']), modeling.headings_grammar(9, 3)):
        assert all("::=" in line for line in g.splitlines() if line.strip())
    folder = next(x for x in modeling.assign_grammar(['a" | "b']).splitlines() if x.startswith("folder"))
    assert folder.count("|") == 1 and r"\"" in folder
    for n in (1, 50, 200):
        assert modeling.reply_budget(n) >= 11 * n + 8
    for context in (4096, 8192, 32768):
        assert modeling.catalogue_batch(context) * 30 < context
    costs = [30] * 500
    take = modeling.fitting_batch(costs, 4096)
    assert 1 <= take <= 200 and 30 * take + modeling.reply_budget(take) <= 4096 - 256
    assert modeling.fitting_batch([10_000] * 5, 4096) == 1
