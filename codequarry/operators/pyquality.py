"""Quality of Python files: unused imports, missing return annotations, mutable defaults, bare raises. Opt-in."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HITS = "array<struct<line_no:int,rule:string,name:string>>"


def analyze(source: str) -> list[tuple[int, str, str]]:
    """The hits of one file; one that doesn't parse has none. Names in ``__all__``, with a leading underscore or ``*`` count as used."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    nodes = list(ast.walk(tree))
    used = {n.id for n in nodes if isinstance(n, ast.Name)} | {w for n in nodes if isinstance(n, ast.Constant) and isinstance(n.value, str) for w in re.findall(r"\w+", n.value) if len(n.value) < 80}
    handlers = {id(x) for h in nodes if isinstance(h, ast.ExceptHandler) for x in ast.walk(h)}
    hits = []
    for n in nodes:
        if isinstance(n, (ast.Import, ast.ImportFrom)) and getattr(n, "module", None) != "__future__":
            for a in n.names:
                name = (a.asname or a.name).split(".")[0]
                if name not in used and not name.startswith("_") and name != "*":
                    hits.append((n.lineno, "unused_import", name))
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if n.returns is None and not n.name.startswith("_"):
                hits.append((n.lineno, "missing_return_annotation", n.name))
            for d in [*n.args.defaults, *n.args.kw_defaults]:
                if isinstance(d, (ast.List, ast.Dict, ast.Set)):
                    hits.append((n.lineno, "mutable_default", n.name))
        elif isinstance(n, ast.Raise) and n.exc is None and id(n) not in handlers:
            hits.append((n.lineno, "bare_raise", ""))
    return hits


def python_quality(files: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, line_no, rule, name`` over the Python files; null contents have none, repeated rows count once."""

    @F.pandas_udf(HITS)
    def found(content: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("line_no", "rule", "name"), h)) for h in analyze(c)] for c in content], dtype=object)

    py = files.where(F.col("content").isNotNull() & F.lower("relative_path").endswith(".py")).select(key, "content")
    return py.select(key, F.explode(found("content")).alias("h")).select(key, "h.*").distinct()
