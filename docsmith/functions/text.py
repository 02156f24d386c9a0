"""Scalar text functions, Column to Column, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import JUNK_TITLES, MAX_COMPONENT, RESERVED

#: White space in the sense of Unicode, which plain \s is not.
WS = r"\p{IsWhite_Space}"


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    # a lone blank, as most are, is left as it is and need not be found
    return F.btrim(F.regexp_replace(x, rf" {WS}+|[{WS}&&[^ ]]{WS}*", " "), F.lit(" "))


def strip(x: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(x, rf"\A{WS}+|{WS}+\z", "")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_unknown(x: Column) -> Column:
    """A title or field that says nothing."""
    return F.coalesce(ascii_lower(strip(x)).isin("", "unknown", "untitled"), F.lit(True))


def condense(x: Column, limit: int) -> Column:
    """Text without control characters, blanks collapsed, cut at ``limit`` characters; where the cut falls
    behind a blank, the character after it stays too."""
    if limit < 1:
        raise ValueError("the limit must be 1 or more")
    clean = collapse(F.regexp_replace(x, rf"[\p{{Cc}}&&[^{WS}]]", ""))
    return let(clean, lambda c: F.when(F.substring(c, limit, 1) == " ", F.substring(c, 1, limit + 1)).otherwise(F.substring(c, 1, limit)))


def ink(x: Column) -> Column:
    """Text without any white space."""
    # blanks, which are most of it, go bytewise
    return F.regexp_replace(F.replace(x, F.lit(" "), F.lit("")), WS + "+", "")


def scanned(condensed: Column, threshold: int) -> Column:
    """So little text that a document must be a scan."""
    return little_ink(ink(condensed), threshold)


def little_ink(inked: Column, threshold: int) -> Column:
    return F.length(inked) < threshold


def text_key(x: Column, min_chars: int) -> Column:
    """A hash of the words whatever their spacing; null where there are too few characters."""
    return let(ink(x), lambda s: ink_key(s, min_chars))


def ink_key(inked: Column, min_chars: int) -> Column:
    return F.when(F.length(inked) >= min_chars, F.sha2(inked, 256))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The part after the last dot of the name; null without one, or where the name only starts with a dot."""
    found = F.regexp_extract(base_name(path), r"(?s)\A.+\.([^.]*)\z", 1)
    return F.when(base_name(path).rlike(r"(?s)\A.+\.[^.]*\z"), found)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?s)(?<!\A)\.[^.]*\z", "")


def title_from_filename(name: Column) -> Column:
    """A readable title from a file name: no extension, blanks for _ and ., dashes for spaced hyphens."""
    bare = F.translate(F.regexp_replace(name, r"\.[^.]*\z", ""), "_.", "  ")
    return collapse(F.replace(bare, F.lit(" - "), F.lit(" — ")))


def title_or_stem(title: Column, path: Column) -> Column:
    """The title, or where it is unknown the file's stem, or ``Untitled``."""
    return F.when(~is_unknown(title), title).otherwise(F.coalesce(F.nullif(stem(path), F.lit("")), F.lit("Untitled")))


def title_case(x: Column) -> Column:
    """The first letter of every word in upper case, the rest as it is."""
    words = F.filter(F.split(x, WS + "+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def truncate_bytes(x: Column, limit: int | Column) -> Column:
    """At most that many bytes, cut between characters; white space before a cut goes."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    raw = x.cast("binary")
    # a cut stands before a byte that starts a character, at most three bytes back
    inside = lambda k: F.substring(F.hex(F.substring(raw, k, F.lit(1))), 1, 1).isin("8", "9", "A", "B")
    longest = F.when(~inside(limit + 1), limit).when(~inside(limit), limit - 1).when(~inside(limit - 1), limit - 2).otherwise(limit - 3)
    cut = F.substring(raw, F.lit(1), F.greatest(longest, F.lit(0))).cast("string")
    return F.when(F.octet_length(x) <= limit, x).otherwise(F.regexp_replace(cut, rf"{WS}+\z", ""))


def sanitize_component(x: Column) -> Column:
    """A name that any file system takes."""
    clean = collapse(F.regexp_replace(x, r"[/\\:*?\"<>|\p{Cc}]", " "))
    clean = F.regexp_replace(clean, rf"\A[.{WS}]+|[.{WS}]+\z", "")

    def named(s: Column) -> Column:
        return F.when(s == "", "Untitled").when(F.upper(s).isin(*RESERVED), F.concat(s, F.lit("_"))).otherwise(s)

    return let(clean, lambda c: let(truncate_bytes(c, MAX_COMPONENT), named))


def sanitize_folder(x: Column) -> Column:
    """A folder path of safe names, without empty and upward steps."""
    parts = F.filter(F.transform(F.split(x, "/"), strip), lambda p: ~p.isin("", ".", ".."))
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, sanitize_component), "/")).otherwise("Unsorted")


def file_name(title: Column, source: Column) -> Column:
    """The name of a title's file, with the extension of its source."""
    ext = F.coalesce(F.lower(extension(source)), F.lit("pdf"))

    def build(pair: Column) -> Column:
        s, e = pair["s"], pair["e"]
        glued = F.endswith(F.lower(s), F.concat(F.lit("."), e))
        bare = F.when(glued, strip(F.substring(s, F.lit(1), F.length(s) - F.length(e) - 1))).otherwise(s)
        room = F.lit(MAX_COMPONENT - 8) - F.octet_length(e)
        return F.concat(let(F.when(bare == "", "Untitled").otherwise(bare), lambda b: truncate_bytes(b, room)), F.lit("."), e)

    return let(F.struct(sanitize_component(title).alias("s"), ext.alias("e")), build)


def usable_title(x: Column) -> Column:
    """Whether an embedded title reads like prose rather than a program's default."""
    t = strip(x)
    junk = F.lit(False)
    for needle in JUNK_TITLES:
        junk = junk | F.contains(F.lower(t), F.lit(needle))
    return F.coalesce(F.octet_length(t).between(4, 120) & ~junk & t.rlike(r"\p{IsAlphabetic}"), F.lit(False))


def plausible_heading(x: Column) -> Column:
    """Whether a line of large type reads like a heading: 3 to 80 characters, and a word with two letters."""
    t = strip(x)
    words = F.exists(F.split(t, WS + "+"), lambda w: F.length(F.regexp_replace(w, r"\P{IsAlphabetic}", "")) >= 2)
    return F.length(t).between(3, 80) & words


def level_range(x: Column) -> Column:
    """The first ``levels a to b`` as ``a-b``, or null."""
    pattern = r"(?iU)levels?\s+(\d{1,2})\s*(?:-|–|to|through)\s*(\d{1,2})"
    return F.when(x.rlike(pattern), F.concat_ws("-", F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)))


def strip_markup(x: Column) -> Column:
    """Text without tags, nested however deep, the common entities resolved one kind after the other, blanks collapsed."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(so_far: Column, piece: Column) -> Column:
        depth = F.when(piece == "<", so_far["depth"] + 1).when(piece == ">", F.greatest(so_far["depth"] - 1, F.lit(0))).otherwise(so_far["depth"])
        shown = ~piece.isin("<", ">") & (so_far["depth"] == 0)
        return F.struct(depth.alias("depth"), F.when(shown, F.concat(so_far["out"], piece)).otherwise(so_far["out"]).alias("out"))

    outside = F.aggregate(F.regexp_extract_all(x, F.lit(r"([<>]|[^<>]+)"), F.lit(1)), start, step)["out"]
    x = F.when(x.rlike("[<>]"), outside).otherwise(x)
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#160;", " ")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return collapse(x)


def attribute(x: Column, name: str) -> Column:
    """The value of the first ``name="..."``, or null."""
    pattern = rf'(?s){name}="([^"]*)"'
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1))


def quoted(x: Column) -> Column:
    """A string in quotes with its quotes and backslashes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
