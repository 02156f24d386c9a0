import random

from pyspark.sql import functions as F

from docsmith.functions import tables, text
from docsmith.operators import catalog


def values(spark, rows, expression, schema="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r.v for r in df.select(expression.alias("v")).collect()]


def plain_condense(raw, limit):
    out, last = "", " "
    for c in raw:
        if c.isspace() or c in "\x85":
            if last != " ":
                out += " "
                last = " "
        elif not (ord(c) < 32 or 127 <= ord(c) < 160):
            out += c
            last = c
    out = out.strip(" ")
    return out[: limit + 1] if out[limit - 1 : limit] == " " else out[:limit]


def test_condense(spark):
    for raw, limit, want in [("\tone\n\ntwo   three ", 50, "one two three"), ("northwest", 5, "north"), ("", 3, ""), ("ñandú", 4, "ñand"), ("no rth", 3, "no r"), ("wide   gap", 50, "wide gap")]:
        assert values(spark, [raw], text.condense(F.col("x"), limit)) == [want]
    rng = random.Random(4)
    raws = ["".join(rng.choices(["a", "b", " ", "\n", "\t", "　", "\xa0", "\x07", "é"], k=rng.randint(0, 20))) for _ in range(400)]
    assert values(spark, raws, text.condense(F.col("x"), 7)) == [plain_condense(r, 7) for r in raws]


def test_white_space_however_mixed(spark):
    rng = random.Random(11)
    spaces = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000"
    raws = ["", " ", "  ", "\n ", " \n"] + ["".join(rng.choices(spaces + " " * 20 + "aé\u200b\U0001f600", k=rng.randint(1, 12))) for _ in range(600)]
    runs = [[w for w in "".join(" " if c in spaces else c for c in r).split(" ") if w] for r in raws]
    assert values(spark, raws, text.collapse(F.col("x"))) == [" ".join(r) for r in runs]
    assert values(spark, raws, text.ink(F.col("x"))) == ["".join(r) for r in runs]


def test_stem_of_long_names(spark):
    # looking behind for the start of the name at every place gave up at 4096 characters
    names = ["a/" + "x" * n + ".pdf" for n in (1, 4000, 5000, 200_000)] + ["a/.pdf", "a.b/c", "x.y.z", "a/..b"]
    assert values(spark, names, text.stem(F.col("x"))) == ["x", "x" * 4000, "x" * 5000, "x" * 200_000, ".pdf", "c", "x.y", "."]


def test_text_key(spark):
    rng = random.Random(9)
    prose = " ".join("".join(rng.choices("aeioustrn", k=5)) for _ in range(90))
    short, exact = "q" * 199, "q" * 200
    assert values(spark, ["", "\t\n \x0b", short, short + " \n"], text.text_key(F.col("x"), 200)) == [None] * 4
    a, b, c, d = values(spark, [prose, prose.replace(" ", "\r\n\t"), prose[:-1] + "!", exact], text.text_key(F.col("x"), 200))
    assert a == b and a != c and d


def test_names(spark):
    x = F.col("x")
    assert values(spark, ["left\\right*up?", "..", " ", "aux", "tail. .", "Com3", "bell\x07end"], text.sanitize_component(x)) == ["left right up", "Untitled", "Untitled", "aux_", "tail", "Com3_", "bell end"]
    assert values(spark, ["./../up/./down/", "//x// y //", "/", "one/..two"], text.sanitize_folder(x)) == ["up/down", "x/y", "Unsorted", "one/two"]
    pairs = [("Field Notes", "scan.EPUB"), ("notes.Epub", "n.epub"), ("plain", "none"), (".epub", "r/s.epub"), ("deep", "r.s/.dotted")]
    got = values(spark, pairs, text.file_name(F.col("x"), F.col("y")), "x string, y string")
    assert got == ["Field Notes.epub", "notes.epub", "plain.pdf", "epub.epub", "deep.pdf"]
    (long,) = values(spark, [("ж" * 300, "s.djvu")], text.file_name(F.col("x"), F.col("y")), "x string, y string")
    assert long == "ж" * 84 + ".djvu"
    assert values(spark, ["Untitled", "\tUNKNOWN\n", " ", "unknown planet", None], text.is_unknown(x)) == [True, True, True, False, True]
    assert values(spark, ["Kx17.djvu", "river_log.v2.pdf", "north - south_b.pdf", "bare"], text.title_from_filename(x)) == ["Kx17", "river log v2", "north — south b", "bare"]
    assert values(spark, [("Unknown", "/q/Kx17.djvu"), (" ", "/q/river_log.v2.pdf"), ("Given", "/q/z.pdf"), (None, "/q/")], text.title_or_stem(F.col("x"), F.col("y")), "x string, y string") == ["Kx17", "river_log.v2", "Given", "Untitled"]
    assert values(spark, ["éclair o'clock", "\tten  to\none ", ""], text.title_case(x)) == ["Éclair O'clock", "Ten To One", ""]


def test_titles_headings_levels(spark):
    x = F.col("x")
    assert values(spark, ["PowerPoint of the day", "the Layout", "slide 12", "A Walk in the Hills", "hut", "20-24", None, "w" * 121], text.usable_title(x)) == [False, False, False, True, False, False, False, False]
    assert values(spark, ["Ox", "7.2", "x 1 y 2", "Part Three, the Hills", "y" * 81, "p q r s", "  to the sea  "], text.plausible_heading(x)) == [False, False, False, True, False, False, True]
    assert values(spark, ["LEVEL 3 through 11", "levels 12-14, level 1 to 2", "levelled", "from level 2–4"], text.level_range(x)) == ["3-11", "12-14", None, "2-4"]
    assert values(spark, ["To <i>the <b>sea</b></i>", "&amp;gt;&quot;", "n&#160;  m", "a<x<y<z>>>b", "c>d<e", "<<p>q>r"], text.strip_markup(x)) == ["To the sea", '>"', "n m", "ab", "cd", "r"]


def test_canonical(spark):
    rows = [(f" {r.upper()} ", v) for r, v in tables.ALIASES.items()] + [("Some House System", "Some House System"), ("\t", "System Neutral")]
    assert values(spark, [r for r, _ in rows], catalog.canonical(F.col("x"))) == [v for _, v in rows]


def test_canonical_overrides(spark):
    assert values(spark, ["Gurps"], catalog.canonical(F.col("x"), {"gurps": "Home Rules"})) == ["Home Rules"]
    assert values(spark, ["gurps"], catalog.canonical(F.col("x"), {"GURPS": "Home Rules"})) == ["GURPS"]
