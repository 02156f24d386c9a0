"""Backends that describe documents, design a taxonomy and file into it.

The rule backend is expressions only.  A model backend wraps a function from prompt to reply;
it runs in Arrow batches, with one model a worker, and its replies go through the same checks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, filing, modeling, taxonomy
from ..sources import programs
from ..sources.shared import settled
from .config import Config


class Backend(Protocol):
    name: str

    def digest(self, probes: DataFrame, config: Config) -> DataFrame: ...

    def design(self, digests: DataFrame, config: Config) -> DataFrame: ...

    def file(self, digests: DataFrame, leaves: DataFrame, config: Config) -> DataFrame: ...

    def refine_headings(self, found: DataFrame, config: Config) -> DataFrame: ...


class Rules:
    """Keyword tables instead of a model."""

    name = "heuristic"

    def digest(self, probes: DataFrame, config: Config) -> DataFrame:
        return catalog.describe(probes)

    def design(self, digests: DataFrame, config: Config) -> DataFrame:
        return taxonomy.design(digests, config.taxonomy.min_docs_per_leaf, config.taxonomy.max_leaves)

    def file(self, digests: DataFrame, leaves: DataFrame, config: Config) -> DataFrame:
        return filing.file_documents(digests, leaves)

    def refine_headings(self, found: DataFrame, config: Config) -> DataFrame:
        """Headings (doc, seq, page, text, level, ...) as they are."""
        return found


class Prompted(Rules):
    """A model behind ``load() -> (prompt, grammar) -> reply``; load runs once a worker and must be picklable."""

    name = "model"

    def __init__(self, load: Callable[[], Callable[[str, str], str]]):
        self.load = load

    def replies(self, prompt, grammar: str):
        load = self.load

        @F.pandas_udf("string")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for prompts in batches:
                yield prompts.map(lambda p: model(p, grammar))

        return ask(prompt)

    def digest(self, probes: DataFrame, config: Config) -> DataFrame:
        prompt = modeling.chat(config.model.template, F.lit(modeling.DIGEST_SYSTEM), modeling.digest_prompt(probes))
        answered = probes.withColumn("__d", modeling.parse_digest(self.replies(prompt, modeling.digest_grammar())))
        return answered.filter("__d IS NOT NULL").select(*probes.columns, "__d.*")

    def design(self, digests: DataFrame, config: Config) -> DataFrame:
        model, t = self.load(), config.taxonomy
        grammar = modeling.taxonomy_grammar(t.max_leaves, t.max_depth)

        def one(text: str, leaves: list[str]) -> list[str]:
            import json

            known = "Folders so far:\n" + "".join(f"- {x}\n" for x in leaves) if leaves else ""
            reply = modeling.first_json(model(modeling.TAXONOMY_SYSTEM % (t.max_leaves, t.max_depth) + "\n\n" + known + text, grammar))
            return sorted({x for x in json.loads(reply or "[]") if x.strip()}) or leaves

        leaves = modeling.fold_design(modeling.catalogue(digests, modeling.catalogue_batch(config.model.context)), one)
        return digests.sparkSession.createDataFrame([(x,) for x in leaves], "leaf string")

    def file(self, digests: DataFrame, leaves: DataFrame, config: Config) -> DataFrame:
        names = [r["leaf"] for r in leaves.orderBy("leaf").collect()]  # a taxonomy has few leaves by design
        prompt = modeling.chat(config.model.template, F.lit(modeling.ASSIGN_SYSTEM), modeling.assign_prompt(names))
        reply = F.from_json(modeling.extract_json(self.replies(prompt, modeling.assign_grammar(names))), "folder string, confidence float, reason string")
        answered = digests.withColumn("__f", reply)
        filings = answered.select(*digests.columns, F.coalesce("__f.folder", F.lit("")).alias("folder"), F.coalesce("__f.reason", F.lit("")).alias("reason"), F.col("__f.confidence").alias("filing_confidence"))
        return modeling.checked_folder(filings, leaves).drop("known").select(*filings.columns)

    def refine_headings(self, found: DataFrame, config: Config) -> DataFrame:
        """The headings that the model picks, with the levels that it gives, at most ``bookmarks.max_depth``.

        A document's lines are judged in batches that fit the window; numbers stay those of the document.  What a
        reply picks outside its batch is left out, and so is all of a batch whose reply is no list.
        """
        load, template, context, depth = self.load, config.model.template, config.model.context, config.bookmarks.max_depth
        lines = F.sort_array(F.collect_list(F.struct("seq", modeling.heading_line().alias("line"))))
        asked = found.groupBy("doc").agg(lines.alias("lines"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            # a model may count its tokens; bytes are never fewer
            tokens = getattr(model, "tokens", lambda text: len(text.encode()))
            for batch in batches:
                rows = []
                for doc, lines in zip(batch["doc"], batch["lines"]):
                    rest, pos = [(r["seq"], r["line"]) for r in lines], 0
                    grammar = modeling.headings_grammar(rest[-1][0], depth)
                    fixed = tokens(modeling.chat_text(template, modeling.HEADINGS_SYSTEM, modeling.headings_text([])))
                    while rest:
                        take = modeling.fitting_batch([tokens(line) for _, line in rest[: modeling.MAX_BATCH]], context - fixed)
                        part, rest = rest[:take], rest[take:]
                        reply = model(modeling.chat_text(template, modeling.HEADINGS_SYSTEM, modeling.headings_text([line for _, line in part])), grammar)
                        for i, level in modeling.picked(reply, {i for i, _ in part}):
                            rows.append((doc, pos, i, level))
                            pos += 1
                yield pd.DataFrame(rows, columns=["doc", "pos", "i", "l"])

        kind = found.schema["doc"].dataType.simpleString()
        picks = settled(asked.mapInPandas(run, f"doc {kind}, pos int, i int, l int"), "picks")
        return modeling.chosen_headings(picks, found.drop("level"), depth)


class Looking:
    """A backend with eyes: a scan is described from a picture of its first page, and all else by the backend.

    ``load() -> (picture, prompt, grammar) -> reply`` runs once a worker; ``picture(path, max_pixels, seconds)`` gives
    PNG bytes or None.  Without a picture or a usable reply, the backend describes a scan too.
    """

    def __init__(self, backend: Backend, load: Callable[[], Callable[[bytes, str, str], str]], picture: Callable[[str, int, float], bytes | None] = programs.first_page):
        self.backend, self.load, self.picture = backend, load, picture

    def __getattr__(self, name: str):
        if name == "backend":
            raise AttributeError(name)
        return getattr(self.backend, name)

    def digest(self, probes: DataFrame, config: Config) -> DataFrame:
        if not config.vision.enabled:
            return self.backend.digest(probes, config)
        load, picture, pixels, seconds, grammar = self.load, self.picture, config.vision.max_pixels, config.extract.timeout_secs, modeling.digest_grammar()

        @F.pandas_udf("string")
        def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = None
            for paths, prompts in batches:
                replies = []
                for path, prompt in zip(paths, prompts):
                    page = picture(path, pixels, seconds)
                    if page:
                        model = model or load()
                    replies.append(model(page, prompt, grammar) if page else None)
                yield pd.Series(replies, dtype=object)

        prompt = modeling.chat(config.model.template, F.lit(modeling.VISION_SYSTEM), modeling.digest_prompt(probes))
        seen = probes.filter("scanned").withColumn("__d", modeling.parse_digest(look("path", prompt))).filter("__d IS NOT NULL")
        # a picture is looked at once, whatever reads the reply below
        seen = settled(seen.select("path", "__d"), "seen")
        described = probes.join(seen, "path").select(*probes.columns, "__d.*")
        others = self.backend.digest(probes.join(seen, "path", "left_anti"), config)
        return described.unionByName(others.select(*described.columns))
