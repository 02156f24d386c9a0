"""The side that a language model sees: prompts, grammars, replies.  The model itself is a plug-in (plans/backend.py)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stem

# Chat formats, with the places of the system and the user turn.
CHAT = {
    "chatml": "<|im_start|>system\n%s<|im_end|>\n<|im_start|>user\n%s<|im_end|>\n<|im_start|>assistant\n",
    "llama3": "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n%s<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n%s<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    "mistral": "<s>[INST] %s\n\n%s [/INST]",
    "plain": "%s\n\n%s\n\n",
}

# Token budgets.
REPLY_TOKENS, REPLY_SLACK, SAFETY_MARGIN, MAX_BATCH = 16, 64, 256, 200

DIGEST_SYSTEM = "You catalogue documents. Read the fragment, say what the document is, and answer with one JSON object. Write unknown for what the text does not say."
ASSIGN_SYSTEM = "You put a catalogued document into one of the folders listed, the most specific one that fits. Answer with one JSON object."
TAXONOMY_SYSTEM = "You design the folders of a library from its catalogue: at most %d leaf folders, at most %d levels, the system first, no empty ones. Answer with a JSON array of paths."
HEADINGS_SYSTEM = "You make a table of contents. Choose the lines that are headings, keep their order, and give each a level from 0. Answer with a JSON array of objects with i and l."
VISION_SYSTEM = "You catalogue a document from a picture of its first page. Answer with one JSON object, with unknown for what the page does not say."


def chat(template: str, system: Column, user: Column) -> Column:
    """Both turns in a model's chat format; an unknown one counts as chatml."""
    before, between, after = CHAT.get(template, CHAT["chatml"]).split("%s")
    return F.concat(F.lit(before), system, F.lit(between), user, F.lit(after))


def chat_text(template: str, system: str, user: str) -> str:
    return CHAT.get(template, CHAT["chatml"]) % (system, user)


def label(prefix: str, path: Column) -> Column:
    name = stem(path)
    return F.when(name == "", prefix).otherwise(F.concat(F.lit(prefix + ":"), name))


def digest_prompt(probes: DataFrame) -> Column:
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name + ": "), c.cast("string"), F.lit("\n"))).otherwise("")
    body = F.when(F.col("scanned"), "\nNo text: the document is a scan. Go by the name, with a confidence below 0.4.\n").otherwise(F.concat(F.lit("\nOpening text:\n---\n"), F.coalesce("text", F.lit("")), F.lit("\n---\n")))
    known = [(n, c) for n, c in (("File name", "file_name"), ("Embedded title", "pdf_title"), ("Embedded author", "pdf_author"), ("Embedded subject", "pdf_subject"), ("Pages", "page_count")) if c in probes.columns]
    fields = "\nFields: title, game_system, doc_type, setting, level_range, publisher, topics, summary, confidence\n"
    return F.concat(*(line(n, F.col(c)) for n, c in known), body, F.lit(fields))


def catalogue(digests: DataFrame, batch: int) -> DataFrame:
    """(chunk, catalogue): the corpus as prompt lines, ``batch`` documents a chunk, in the order of paths.

    Ranks come from counts by range of paths, so no window holds the corpus.
    """
    from .filing import ranked

    line = F.concat(F.lit("- "), F.concat_ws(" | ", "title", "game_system", "doc_type", "setting"), F.lit("\n"))
    rows = ranked(digests.select("path", line.alias("line"), F.lit(1).alias("one")), "one")
    chunk = F.floor((F.col("__rank") - 1) / batch).cast("int")
    lines = rows.groupBy(chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("__rank", "line"))).alias("all"))
    return lines.select("chunk", F.concat(F.lit("Catalogue:\n"), F.array_join(F.transform("all", lambda x: x["line"]), ""), F.lit("\nDesign the leaf folders.\n")).alias("catalogue"))


def catalogue_batch(context: int) -> int:
    """Catalogue lines that fit half the window, at 30 tokens each."""
    return max(20, min(400, context // 2 // 30))


def assign_prompt(leaves: list[str]) -> Column:
    """The user turn that files one digest."""
    fields = [("title", "title"), ("system", "game_system"), ("type", "doc_type"), ("setting", "setting"), ("levels", "level_range")]
    parts = [F.concat(F.lit(f"- {n}: "), F.col(c), F.lit("\n")) for n, c in fields]
    return F.concat(F.lit("Folders:\n" + "".join(f"- {x}\n" for x in leaves) + "\nDocument:\n"), *parts, F.lit("- topics: "), F.array_join("topics", ", "), F.lit("\n- summary: "), F.col("summary"), F.lit("\n\nFile it.\n"))


def heading_line() -> Column:
    return F.concat(F.col("seq").cast("string"), F.lit(": "), F.col("text"), F.lit("  (page "), F.col("page").cast("string"), F.lit(")\n"))


# what stands before and after the numbered lines
ASK_HEADINGS = ("Lines of large type, in reading order:\n", "\nWhich are headings?\n")


def headings_text(lines: list[str]) -> str:
    return ASK_HEADINGS[0] + "".join(lines) + ASK_HEADINGS[1]


def headings_prompt(found: DataFrame) -> DataFrame:
    """(doc, prompt): numbered lines with their pages."""
    lines = found.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("seq", heading_line().alias("line")))).alias("all"))
    return lines.select("doc", F.concat(F.lit(ASK_HEADINGS[0]), F.array_join(F.transform("all", lambda x: x["line"]), ""), F.lit(ASK_HEADINGS[1])).alias("prompt"))


def picked(reply: str | None, known: set[int]) -> list[tuple[int, int]]:
    """(line, level) for each pick of a reply that is among the known lines."""
    try:
        picks = json.loads(first_json(reply) or "[]")
    except ValueError:
        return []
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    return [(x["i"], min(x["l"], 255)) for x in picks if isinstance(x, dict) and whole(x.get("i")) and whole(x.get("l")) and x["i"] in known] if isinstance(picks, list) else []


def _literal(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def grammar(rules: dict[str, str]) -> str:
    """Grammar text, one rule a line, with the shared rules for strings."""
    shared = {"ws": r"[ \t\n]*", "string": r'"\"" char* "\""', "char": r'[^"\\] | "\\" (["\\/bfnrt] | "u" [0-9a-fA-F]{4})', "conf": r'"1" | "0" ("." [0-9]{1,3})?'}
    return "".join(f"{name} ::= {body}\n" for name, body in {**rules, **shared}.items())


def _object(fields: dict[str, str]) -> str:
    inner = ' "," ws '.join(f'{_literal(_literal(name) + ":")} ws {body} ws' for name, body in fields.items())
    return f'"{{" ws {inner} "}}"'


def digest_grammar() -> str:
    text = ["title", "game_system", "doc_type", "setting", "level_range", "publisher"]
    return grammar({"root": _object({**dict.fromkeys(text, "string"), "topics": "topics", "summary": "string", "confidence": "conf"}), "topics": '"[" ws (string (ws "," ws string){0,5})? ws "]"'})


def taxonomy_grammar(max_leaves: int = 40, max_depth: int = 3) -> str:
    more, deeper = max(max_leaves, 1) - 1, max(max_depth, 1) - 1
    return grammar({"root": f'"[" ws (leaf (ws "," ws leaf){{0,{more}}})? ws "]"', "leaf": rf'"\"" seg ("/" seg){{0,{deeper}}} "\""', "seg": "[A-Za-z0-9&'()+.,! -]{1,40}"})


def assign_grammar(leaves: list[str]) -> str:
    """Admits only folders that are there."""
    folder = " | ".join(f'"\\"" {_literal(x)} "\\""' if x else '"\\"\\""' for x in leaves)
    return grammar({"root": _object({"folder": "folder", "confidence": "conf", "reason": "string"}), "folder": folder})


def headings_grammar(max_index: int, max_level: int) -> str:
    """Numbers of lines and levels only, without blanks, which cost tokens."""
    return f'root ::= "[" (item ("," item)*)? "]"\nitem ::= "{{\\"i\\":" index ",\\"l\\":" [0-{min(max(max_level - 1, 0), 9)}] "}}"\nindex ::= [0-9]{{1,{len(str(max_index))}}}\n'


def reply_budget(n: int) -> int:
    return n * REPLY_TOKENS + REPLY_SLACK


def fitting_batch(costs: list[int], context: int) -> int:
    """How many lines, whose prompt tokens are given, fit the window with their reply."""
    room = max(context - SAFETY_MARGIN, 0)
    take = min(len(costs), MAX_BATCH)
    while take > 1:
        need = sum(costs[:take]) + reply_budget(take)
        if need <= room:
            return take
        take = min(max(int(take * 0.9 * room / need), 1), take - 1)
    return 1


def first_json(text: str | None) -> str | None:
    """The first balanced object or array in a text; strings and escapes are skipped."""
    if text is None:
        return None
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        return None
    start = min(starts)
    opening, closing = text[start], "}" if text[start] == "{" else "]"
    depth, inside, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if escaped:
            escaped = False
        elif inside:
            escaped, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def extract_json(x: Column) -> Column:
    """``first_json`` in Arrow batches: bracket matching is no regular expression."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(first_json)

    return run(x)


DIGEST_FIELDS = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "game_system", "doc_type", "setting", "level_range", "publisher")] + [T.StructField("topics", T.ArrayType(T.StringType())), T.StructField("summary", T.StringType()), T.StructField("confidence", T.FloatType())])


def parse_digest(reply: Column) -> Column:
    """The fields of a reply, unknown where optional ones are missing; null without title, system and type."""
    parsed = F.from_json(extract_json(reply), DIGEST_FIELDS)

    def fill(d: Column) -> Column:
        optional = lambda n: F.coalesce(d[n], F.lit("unknown")).alias(n)
        whole = F.struct(d["title"].alias("title"), d["game_system"].alias("game_system"), d["doc_type"].alias("doc_type"), optional("setting"), optional("level_range"), optional("publisher"), F.coalesce(d["topics"], F.expr("cast(array() as array<string>)")).alias("topics"), F.coalesce(d["summary"], F.lit("")).alias("summary"), F.coalesce(d["confidence"], F.lit(0.0).cast("float")).alias("confidence"))
        return F.when(d["title"].isNotNull() & d["game_system"].isNotNull() & d["doc_type"].isNotNull(), whole)

    return F.get(F.transform(F.array(parsed), fill), F.lit(0))


def chosen_headings(picks: DataFrame, found: DataFrame, max_levels: int = 3) -> DataFrame:
    """The headings that a reply (doc, pos, i, l) picks: known lines only, each once (first pick), levels capped, in order."""
    first = picks.groupBy("doc", "i").agg(F.min(F.struct("pos", "l")).alias("m"))
    joined = found.join(first, (found["doc"] == first["doc"]) & (found["seq"] == first["i"])).drop(first["doc"]).drop("i")
    return joined.withColumn("level", F.least(F.col("m.l"), F.lit(max(max_levels - 1, 0)))).drop("m")


def checked_folder(filings: DataFrame, leaves: DataFrame) -> DataFrame:
    """Filings with ``known``: whether the folder is a leaf.  The others' confidence becomes null, which the gate takes for failure."""
    marked = filings.join(leaves.select(F.col("leaf").alias("folder"), F.lit(True).alias("__known")).distinct(), "folder", "left")
    known = F.col("__known").isNotNull()
    return marked.withColumn("known", known).withColumn("filing_confidence", F.when(known, F.col("filing_confidence"))).drop("__known")


def clean_leaves(leaves: DataFrame) -> DataFrame:
    """Distinct leaves that are not blank."""
    return leaves.filter(F.btrim("leaf") != "").distinct()


def fold_design(chunks: DataFrame, design, leaves: list[str] | None = None) -> list[str]:
    """A taxonomy from chunks in order: design(catalogue text, leaves so far) gives the leaves.

    One chunk at a time comes to the driver, as each design needs the one before.
    """
    leaves = list(leaves or [])
    for row in chunks.orderBy("chunk").toLocalIterator():
        leaves = design(row["catalogue"], leaves)
    return leaves


def numbered_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")
