"""Source files that do not parse."""

from __future__ import annotations

import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The checked languages and their extensions.
LANGUAGES = ["python", "javascript", "typescript", "java", "go", "json", "toml"]
EXTENSIONS = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".json": "json", ".toml": "toml"}


def checked_language(language: Column, extension: Column) -> Column:
    """The language of a file if it is one of the checked ones; a null language is that of the extension."""
    known = F.coalesce(*[F.when(F.lower(extension) == e, F.lit(name)) for e, name in EXTENSIONS.items()])
    named = F.coalesce(F.lower(F.trim(language)), known)
    return F.when(named.isin(LANGUAGES), named)


def first_error(text: str, language: str) -> tuple[int, str] | None:
    """Offset of the first token that can't stand where it stands, and ``token``; or the length and ``end``; or None."""
    from codequarry.llm.grammars import grammar
    from codequarry.llm.lexers import lex

    lexed = lex(text, language)
    at = grammar(language).parse(lexed.kinds, lexed.breaks)
    if at < 0:
        return _repeated(text) if language == "toml" else None
    return (lexed.at[at], "token") if at < len(lexed.kinds) else (len(text), "end")


def _repeated(text: str) -> tuple[int, str] | None:
    """What TOML refuses in a text that parses: keys and tables defined twice, values that are no dates."""
    try:
        tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        m = re.search(r"\(at line (\d+), column (\d+)\)", str(e))
        if not m:
            return len(text), "end"
        line = text.replace("\r\n", "\n").split("\n")[: int(m[1]) - 1]
        return min(len(text), sum(map(len, line)) + len(line) * (2 if "\r\n" in text else 1) + int(m[2]) - 1), "token"
    except (ValueError, RecursionError):  # limits of the reader, not of the language
        return None
    return None


def syntax_errors(files: DataFrame) -> DataFrame:
    """``file_id, language, at, kind`` of every file of a checked language that doesn't parse.

    ``at`` is the code point offset of the failing token (kind ``token``) or the length of a text that is cut off
    (kind ``end``). Null contents and files of other languages have no row; an empty text is an error only where
    the language says so (JSON, Go). Repeated rows give one. Whole contents are parsed.
    """

    @F.pandas_udf("at int, kind string")
    def check(content: pd.Series, language: pd.Series) -> pd.DataFrame:
        found = [first_error(c, x) or (None, None) for c, x in zip(content, language)]
        return pd.DataFrame({"at": pd.array([a for a, _ in found], dtype="Int32"), "kind": [k for _, k in found]})

    return (
        files.withColumn("language", checked_language(F.col("language"), F.col("extension")))
        .where(F.col("content").isNotNull() & F.col("language").isNotNull() & F.col("file_id").isNotNull())
        .select("file_id", "language", check("content", "language").alias("e"))
        .where(F.col("e.kind").isNotNull())
        .groupBy("file_id")
        .agg(F.min(F.struct("language", "e.at", "e.kind")).alias("e"))
        .select("file_id", "e.*")
    )


def error_rates(files: DataFrame) -> DataFrame:
    """``repository_id, language, n_files, n_invalid, rate`` over the checked files with content, each id once."""
    checked = (
        files.withColumn("language", checked_language(F.col("language"), F.col("extension")))
        .where(F.col("content").isNotNull() & F.col("language").isNotNull() & F.col("file_id").isNotNull())
        .groupBy("file_id")
        .agg(F.min(F.struct("repository_id", "language")).alias("f"))
        .select("file_id", "f.*")
    )
    bad = syntax_errors(files).select("file_id", F.lit(1).alias("bad"))
    return (
        checked.join(bad, "file_id", "left")
        .groupBy("repository_id", "language")
        .agg(F.count("*").alias("n_files"), F.count("bad").alias("n_invalid"))
        .withColumn("rate", F.col("n_invalid") / F.col("n_files"))
    )
