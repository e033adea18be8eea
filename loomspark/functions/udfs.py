"""Arrow-batched functions for what expressions can't say: lexing source code and rolling hashes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from loomspark.functions import chunking, code
from loomspark.functions import text as T
from loomspark.scratch import ready

#: Rows of a batch of symbols.
ROWS = 4096
SPANS = S.ArrayType(S.StructType([S.StructField("start", S.IntegerType()), S.StructField("end", S.IntegerType())]))
SYMBOL = "kind string, name string, qualified string, start_line int, end_line int, signature string, body_bytes long, parent string, calls array<string>, bases array<string>"


def _pandas(function, kind) -> object:
    if spark := SparkSession.getActiveSession():
        ready(spark)  # a function keeps the environment of the moment it is made
    return F.pandas_udf(function, kind)


def strip_raw(content: Column, language: Column, comments: bool = True, logs: bool = True) -> Column:
    """Text without comments and logs as a lexer sees them; null where the language has none or refuses the text."""

    def run(c: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or x is None else code.strip_exact(s, x, comments, logs) for s, x in zip(c, lang)])

    run.__annotations__ = {"c": pd.Series, "lang": pd.Series, "return": pd.Series}
    return _pandas(run, "string")(content, language)


def strip_code(content: Column, language: Column, comments: bool = True, logs: bool = True) -> Column:
    """The lexer's result where there is one, else the patterns'; lines tidied. Null content stays null."""
    exact = strip_raw(content, language, comments, logs)
    by_patterns = T.strip_comments(content, language) if comments else content
    by_patterns = T.strip_logs(by_patterns, language) if logs else by_patterns
    return T.tidy_lines(F.coalesce(exact, by_patterns))


def skeleton_code(content: Column, language: Column) -> Column:
    def run(c: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or x is None else code.skeleton(s, x) for s, x in zip(c, lang)])

    run.__annotations__ = {"c": pd.Series, "lang": pd.Series, "return": pd.Series}
    return _pandas(run, "string")(content, language)


def content_chunks(content: Column, min_size: int = chunking.MIN_SIZE, max_size: int = chunking.MAX_SIZE, mask_bits: int = chunking.MASK_BITS) -> Column:
    """Spans (start, end) of the UTF-8 bytes of a text, or of a binary column."""

    def run(c: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in chunking.cut(bytes(x), min_size, max_size, mask_bits)] if x is not None else [] for x in c])

    run.__annotations__ = {"c": pd.Series, "return": pd.Series}
    return _pandas(run, SPANS)(content.cast("binary"))


def symbols_of(files: DataFrame) -> DataFrame:
    """A row for each symbol of files (path, language, content): the columns of SYMBOL plus path and language."""
    ready(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SYMBOL.split(", ")]
        for b in batches:
            rows = ({**row, "path": p, "language": lang} for p, lang, c in zip(b["path"], b["language"], b["content"]) for row in code.each_symbol(c or "", lang, p))
            while part := list(itertools.islice(rows, ROWS)):
                yield pd.DataFrame(part, columns=["path", "language", *names])

    return files.select("path", "language", "content").mapInPandas(run, f"path string, language string, {SYMBOL}")
