"""Morphological analysis of text columns, end to end: one Arrow pass, no shuffle, so batches and streams alike.

    a = Analyzer.open("/shared/resources")
    a.analyze(spark.read.text("corpus"), "value")

Resources are a folder with model.npz and dictionaries.json (resources.py), or objects made otherwise. Options are preanal, errpatch and restore,
each on by default, as keywords or as a JSON object; what is not an option is ignored, what is not a truth value is an error.
"""

from __future__ import annotations

import logging
import os


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import sentence as S
from .operators.batches import with_columns
from .operators.resources import Dictionaries, Model
from .operators.tagger import predict
from .sources.dictionaries import Options

log = logging.getLogger("hanmal")
MORPH = "struct<lex:string,tag:string,c_begin:int,c_len:int,b_begin:int,b_len:int>"
WORD = f"struct<lex:string,c_begin:int,c_len:int,b_begin:int,b_len:int,morphs:array<{MORPH}>>"
FILES = ("model.npz", "dictionaries.json")


def set_log_level(level: str, name: str = "") -> None:
    """The level of all logging of the package, or of one part of it; an unknown level raises."""
    if not isinstance(logging.getLevelName(level.upper()), int):
        raise ValueError(f"unknown log level {level}")
    (log.getChild(name) if name else log).setLevel(level.upper())


class Analyzer:
    def __init__(self, model: Model, dictionaries: Dictionaries | None = None, **options: bool):
        self.model, self.dictionaries = model, dictionaries or Dictionaries()
        self.options = Options().override(dict_text(options))
        model.check()
        self.closed = False

    @staticmethod
    def open(folder: str, **options: bool) -> Analyzer:
        """From a folder of resources; raises where it or a file in it is missing."""
        if not os.path.isdir(folder):
            raise FileNotFoundError(f"no folder of resources: {folder}")
        if missing := [f for f in FILES if not os.path.isfile(os.path.join(folder, f))]:
            raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
        return Analyzer(Model.load(folder), Dictionaries.load(folder), **options)

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        self.model.save(folder)
        self.dictionaries.save(folder)

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Analyzer:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _chosen(self, options: str | None, **more: bool) -> Options:
        if self.closed:
            raise ValueError("the analyzer is closed")
        return self.options.override(options).override(dict_text(more))

    def analyze(self, df: DataFrame, text: str, options: str | None = None, into: str = "words", **more: bool) -> DataFrame:
        """df with `into`: the words of each text with offsets in characters and bytes, and their morphemes. Blank texts have none, null texts null."""
        o, model, d = self._chosen(options, **more), self.model, self.dictionaries
        state: list = []

        def fn(cols: list[list]) -> list[list]:
            if not state:
                state.append(Stages(model, d, o))
            return [state[0].analyze(cols[0])]

        return with_columns(df, [text], fn, f"`{into}` array<{WORD}>")

    def tags_before_patch(self, df: DataFrame, text: str, options: str | None = None, into: str = "tags", **more: bool) -> DataFrame:
        """df with `into`: the tags of each text's characters before error patches, -2 at both ends and -1 between words; a single -2 without words."""
        o, model, d = self._chosen(options, **more), self.model, self.dictionaries
        state: list = []

        def fn(cols: list[list]) -> list[list]:
            if not state:
                state.append(Stages(model, d, o))
            texts = [t or "" for t in cols[0]]
            _, tags = state[0].tagged(texts)
            return [[None if t is None else S.with_delimiters(x) for t, x in zip(cols[0], tags, strict=True)]]

        return with_columns(df, [text], fn, f"`{into}` array<int>")

    def register(self, spark: SparkSession, name: str = "analyze") -> None:
        """analyze(text) for SQL: the words column."""
        import pandas as pd

        model, d, o = self.model, self.dictionaries, self._chosen(None)

        @F.pandas_udf("array<struct<lex:string,morphs:string>>")
        def analyze(texts):
            got = Stages(model, d, o).analyze([None if t is None else t for t in texts])
            return pd.Series([None if x is None else [{"lex": w["lex"], "morphs": " + ".join(f"{m['lex']}/{m['tag']}" for m in w["morphs"])} for w in x] for x in got])

        spark.udf.register(name, analyze)


def dict_text(options: dict) -> str | None:
    import json

    return json.dumps(options) if options else None


class Stages:
    """All stages over a batch of texts, in one worker."""

    def __init__(self, model: Model, d: Dictionaries, o: Options):
        self.model, self.d, self.o = model, d, o
        self.longest, self.patcher = d.longest(), S.Patcher(d.patches)

    def tagged(self, texts: list[str]) -> tuple[list[list[tuple[str, int]]], list[S.Tags]]:
        """Words with their begins, and revised tags."""
        places = [S.tokenize(t) for t in texts]
        words = [[w for w, _ in p] for p in places]
        known = [[S.preanal(w, self.d, self.longest) if self.o.preanal else [0] * len(w) for w in s] for s in words]
        tags = predict(self.model, words, known)
        return places, [S.revise(w, t, self.d) for w, t in zip(words, tags, strict=True)]

    def analyze(self, texts: list[str | None]) -> list[list[dict] | None]:
        places, tags = self.tagged([t or "" for t in texts])
        out: list[list[dict] | None] = []
        for text, words, own in zip(texts, places, tags, strict=True):
            if text is None:
                out.append(None)
                continue
            if self.o.errpatch:
                own = self.patcher.apply([w for w, _ in words], own)
            at = byte = 0
            got = []
            for (word, begin), t in zip(words, own, strict=True):
                byte += len(text[at:begin].encode())
                at = begin
                wide = [0]
                for c in word:
                    wide.append(wide[-1] + len(c.encode()))
                found = [{"lex": x, "tag": g, "c_begin": begin + a, "c_len": b - a + 1, "b_begin": byte + wide[a], "b_len": wide[b + 1] - wide[a]} for x, g, a, b in S.morphs(word, t, self.d, self.o.restore)]
                got.append({"lex": word, "c_begin": begin, "c_len": len(word), "b_begin": byte, "b_len": wide[-1], "morphs": found})
            out.append(got)
        return out


__all__ = ["Analyzer", "set_log_level"]
