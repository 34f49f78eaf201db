"""Python files: taint from request data to dangerous calls, literal secrets, query texts. One parse for each file."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import split_lines
from codequarry.operators.linerules import is_suppressed

# Request attributes, sanitizers, sinks, names of secrets, placeholders.
SOURCES = set("query_params body form headers cookies data json args values files path_params GET POST".split())
SANITIZERS = """escape quote sanitize sanitize_html clean bleach.clean html.escape markupsafe.escape shlex.quote urllib.parse.quote re.escape
parameterize validate allowlist whitelist""".split()
SINKS = {
    "eval": "PY001", "compile": "PY001", "exec": "PY002", "subprocess.run": "PY003", "subprocess.call": "PY003", "subprocess.Popen": "PY003",
    "subprocess.check_output": "PY003", "os.system": "PY004", "os.popen": "PY004", "pickle.loads": "PY007", "pickle.load": "PY007", "yaml.load": "PY008",
}
PATHS = {"open", "Path", "os.path.join", "os.path.abspath", "pathlib.Path", "Path.open"}
QUERY_CALLS = "execute executemany raw raw_sql query".split()
SECRET_NAME = re.compile(
    "api_key|secret_key|access_token|password|private_key|auth_token|client_secret|encryption_key|db_password|database_password|passwd|pwd", re.I
)
PLACEHOLDERS = {"", "none", "null", "your_key_here", "changeme", "replace_me", "todo", "fixme", "secret", "password"}
HITS = "array<struct<line_no:int,rule_id:string,severity:string,tainted:boolean,sanitized:boolean>>"


def dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id])) if isinstance(node, ast.Name) else ""


def _from_request(node: ast.AST) -> bool:
    node = node.value if isinstance(node, ast.Subscript) else node
    return isinstance(node, ast.Attribute) and node.attr in SOURCES


def _taints(nodes: list[ast.AST]) -> dict[str, tuple[bool, bool]]:
    """Name -> (tainted, sanitized), over the assignments to a single name in the order of the walk."""
    known: dict[str, tuple[bool, bool]] = {}
    for n in nodes:
        if not (isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name)):
            continue
        name, v, state = n.targets[0].id, n.value, None
        if _from_request(v):
            state = (True, False)
        elif isinstance(v, ast.Name):
            state = known.get(v.id)
        elif isinstance(v, ast.Call) and any(s in dotted(v.func) for s in SANITIZERS) and v.args and isinstance(v.args[0], ast.Name):
            inner = known.get(v.args[0].id)
            state = inner and (inner[0], True)
        elif isinstance(v, ast.JoinedStr) or isinstance(v, ast.BinOp) and isinstance(v.op, ast.Add):
            inside = ast.walk(v) if isinstance(v, ast.JoinedStr) else (v.left, v.right)
            inner = next((known[x.id] for x in inside if isinstance(x, ast.Name) and x.id in known), None)
            state = inner and (inner[0] and not inner[1], inner[1])
        if state:
            known[name] = state
    return known


def analyze(source: str) -> list[tuple]:
    """The hits of one file; a file that doesn't parse has none."""
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError, RecursionError):
        return []
    known, hits = _taints(nodes), []
    for n in nodes:
        if isinstance(n, ast.Assign):
            for t in n.targets:
                literal = n.value.value if isinstance(n.value, ast.Constant) else None
                if isinstance(t, ast.Name) and SECRET_NAME.search(t.id) and isinstance(literal, str) and len(literal) >= 4 and literal.lower() not in PLACEHOLDERS:
                    hits.append((n.lineno, "SEC001", "high", False, False))
        if not isinstance(n, ast.Call) or not (name := dotted(n.func)):
            continue
        first = n.args[0] if n.args else None
        tainted, sanitized = known.get(first.id, (False, False)) if isinstance(first, ast.Name) else (False, False)
        constant = isinstance(first, ast.Constant) or isinstance(first, (ast.List, ast.Tuple)) and all(isinstance(e, ast.Constant) for e in first.elts)
        rule = SINKS.get(name)
        if rule == "PY003":
            shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in n.keywords)
            if shell or not constant:
                dirty = tainted and not sanitized
                hits.append((n.lineno, rule, "critical" if shell and dirty else "high" if shell or dirty else "medium", tainted, sanitized))
        elif rule and (tainted or not constant):
            hits.append((n.lineno, rule, "high", tainted, sanitized))
        if name in PATHS and tainted:
            hits.append((n.lineno, "PY006", "high", True, sanitized))
        if any(q in name for q in QUERY_CALLS):
            percent = isinstance(first, ast.BinOp) and isinstance(first.op, ast.Mod) and isinstance(first.left, ast.Constant) and isinstance(first.left.value, str)
            if isinstance(first, ast.JoinedStr) or percent and re.search("SELECT|INSERT|UPDATE|DELETE", first.left.value, re.I):
                hits.append((n.lineno, "PY005", "high", tainted, sanitized))
    return hits


def flows(files: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, path, line_no, rule_id, severity, tainted, sanitized`` over the Python files; repeated rows count once.

    A hit whose rule its line suppresses is left out.
    """

    @F.pandas_udf(HITS)
    def found(content: pd.Series) -> pd.Series:
        names = ("line_no", "rule_id", "severity", "tainted", "sanitized")
        return pd.Series([[dict(zip(names, h)) for h in analyze(c)] for c in content], dtype=object)

    py = files.where(F.col("content").isNotNull() & F.lower("relative_path").endswith(".py")).select(key, F.col("relative_path").alias("path"), "content")
    line = F.get(split_lines(F.col("content")), F.col("h.line_no") - 1)
    hits = py.select(key, "path", "content", F.explode(found("content")).alias("h"))
    return hits.where(~is_suppressed(F.coalesce(line, F.lit("")), F.col("h.rule_id"))).select(key, "path", "h.*").distinct()


def parsing(files: DataFrame, key: str = "file_id") -> DataFrame:
    """``key`` of the Python files that parse."""

    @F.pandas_udf("boolean")
    def parses(content: pd.Series) -> pd.Series:
        return content.map(_parses)

    py = files.where(F.col("content").isNotNull() & F.lower("relative_path").endswith(".py"))
    return py.where(parses("content")).select(key).distinct()


def _parses(source: str) -> bool:
    try:
        ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return False
    return True
