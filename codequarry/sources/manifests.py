"""Dependencies named by manifests and lock files: ``file_id, name, version, ecosystem, is_direct``.

All readers take files (``file_id, relative_path, content``) and pick theirs by name. Content that can't be read
gives no rows; repeated rows give their dependencies once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import blank_to_null, forward_slashes, split_lines

#: Folders without manifests of the project's own, and how deep manifests are looked for.
IGNORED = r"(^|/)(?:\.git|node_modules|\.venv|venv|__pycache__|\.next|dist|build|target|\.tox)/"
MOST_FOLDERS = 3
NOT_A_VERSION = r"^(?:file:|link:|github:|git|workspace:|portal:|latest)"


def _named(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose name fits, at most three folders deep and not below folders of tools and results."""
    path = forward_slashes(F.col("relative_path"))
    name = F.lower(F.substring_index(path, "/", -1))
    here = ~path.rlike(IGNORED) & (F.size(F.split(path, "/")) <= MOST_FOLDERS + 1)
    return files.where(F.col("content").isNotNull() & here & name.rlike(pattern)).select("file_id", "content")


def _row(name: Column, version: Column, ecosystem: str, direct: Column) -> list[Column]:
    return ["file_id", name.alias("name"), version.alias("version"), F.lit(ecosystem).alias("ecosystem"), direct.alias("is_direct")]


def npm_manifest(files: DataFrame) -> DataFrame:
    """``package.json``: the three direct blocks and the development block."""
    blocks = {"dependencies": True, "peerDependencies": True, "optionalDependencies": True, "devDependencies": False}
    schema = "struct<" + ",".join(f"{b}:map<string,string>" for b in blocks) + ">"
    parsed = _named(files, r"^package\.json$").select("file_id", F.from_json("content", schema).alias("p"))
    out = None
    for block, direct in blocks.items():
        bare = F.regexp_replace("v", r"^[\^~>=<! ]+", "")
        version = F.when(~F.col("v").rlike(NOT_A_VERSION), blank_to_null(bare))
        rows = parsed.select("file_id", F.explode(f"p.{block}").alias("k", "v")).select(*_row(F.col("k"), version, "npm", F.lit(direct)))
        out = rows if out is None else out.unionByName(rows)
    return out


def npm_lock(files: DataFrame) -> DataFrame:
    """``package-lock.json`` with a ``packages`` map: the name follows the last ``node_modules/``; development packages aren't direct."""
    schema = "struct<packages:map<string,struct<version:string,dev:boolean>>>"
    rows = _named(files, r"^package-lock\.json$").select("file_id", F.explode(F.from_json("content", schema)["packages"]).alias("k", "v"))
    name = F.substring_index("k", "node_modules/", -1)
    return rows.where(F.col("k") != "").select(*_row(name, F.col("v.version"), "npm", ~F.coalesce("v.dev", F.lit(False))))


def pip_requirements(files: DataFrame) -> DataFrame:
    """``requirements*.txt``: a name and perhaps an operator and version; options, comments and addresses are skipped."""
    rows = _named(files, r"^requirements.*\.txt$").select("file_id", F.explode(split_lines(F.col("content"))).alias("l")).select("file_id", F.trim("l").alias("l"))
    pattern = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:(?:==|>=|<=|~=|!=|>|<)\s*([^\s,;#]+))?"
    good = (F.col("l") != "") & ~F.col("l").rlike(r"^[#-]|://") & F.col("l").rlike(pattern)
    return rows.where(good).select(
        *_row(F.regexp_extract("l", pattern, 1), blank_to_null(F.regexp_extract("l", pattern, 2)), "pypi", F.lit(True))
    )


def poetry_lock(files: DataFrame) -> DataFrame:
    """``poetry.lock``: the name and version lines of each package block."""
    block = r"\[\[package\]\]\s*\r?\nname = \"([^\"]+)\"\r?\nversion = \"([^\"]+)\""
    hits = _named(files, r"^poetry\.lock$").select("file_id", F.explode(F.regexp_extract_all("content", F.lit(block), F.lit(0))).alias("b"))
    return hits.select(*_row(F.regexp_extract("b", block, 1), F.regexp_extract("b", block, 2), "pypi", F.lit(False)))


def go_sum(files: DataFrame) -> DataFrame:
    """``go.sum``: module and version of each line, without the lines for ``go.mod`` files."""
    rows = _named(files, r"^go\.sum$").select("file_id", F.explode(split_lines(F.col("content"))).alias("l"))
    pattern = r"^(\S+) v([^\s/]+) h1:"
    return rows.where(F.col("l").rlike(pattern)).select(*_row(F.regexp_extract("l", pattern, 1), F.regexp_extract("l", pattern, 2), "go", F.lit(False)))


def maven_pom(files: DataFrame) -> DataFrame:
    """``pom.xml``: group:artifact of each dependency; a version by property is unknown; test and provided scopes aren't direct."""
    text = F.regexp_replace("content", r"<!--[\s\S]*?-->", "")
    block = r"<dependency>([\s\S]*?)</dependency>"
    rows = _named(files, r"^pom\.xml$").select("file_id", F.explode(F.regexp_extract_all(text, F.lit(block), F.lit(1))).alias("b"))
    field = lambda n: F.trim(F.regexp_extract("b", rf"<{n}>([^<]*)</{n}>", 1))
    version = F.when(~field("version").rlike(r"\$\{"), blank_to_null(field("version")))
    name = F.concat(field("groupId"), F.lit(":"), field("artifactId"))
    return rows.where(field("artifactId") != "").select(*_row(name, version, "maven", ~field("scope").isin("test", "provided")))


def pyproject(files: DataFrame) -> DataFrame:
    """``pyproject.toml``: the PEP 621 list and the Poetry table, whose ``python`` key is skipped."""

    @F.pandas_udf("array<struct<name:string,version:string>>")
    def read(contents: pd.Series) -> pd.Series:
        import re
        import tomllib

        def one(text: str) -> list[dict]:
            try:
                data = tomllib.loads(text)
            except (tomllib.TOMLDecodeError, UnicodeDecodeError):
                return []
            found = []
            for spec in data.get("project", {}).get("dependencies", []) or []:
                m = re.match(r"\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*(?:[=~!<>]=?\s*([^\s,;]+))?", str(spec))
                if m:
                    found.append({"name": m[1], "version": m[2]})
            for name, v in (data.get("tool", {}).get("poetry", {}).get("dependencies", {}) or {}).items():
                version = v.get("version") if isinstance(v, dict) else v
                if name.lower() != "python":
                    found.append({"name": name, "version": re.sub(r"^[\^~>=<! ]+", "", version) if isinstance(version, str) else None})
            return found

        return pd.Series([one(c) for c in contents], dtype=object)

    rows = _named(files, r"^pyproject\.toml$").select("file_id", F.explode(read("content")).alias("d"))
    return rows.select(*_row(F.col("d.name"), F.col("d.version"), "pypi", F.lit(True)))


READERS = (npm_manifest, npm_lock, pip_requirements, poetry_lock, go_sum, maven_pom, pyproject)


def dependencies(files: DataFrame) -> DataFrame:
    """All readers over one table of files."""
    out = READERS[0](files)
    for read in READERS[1:]:
        out = out.unionByName(read(files))
    return out.distinct()
