"""Generated, minified, vendored and data-only source files.

Each file is lexed into comments, strings, numbers, names and marks, and emitted again in canonical layout: one
statement, opening or closing brace to a line, broken lines joined, no blanks but between words. Comparing that
with the original tells three kinds by layout alone: re-emission that expands the file many times marks a
minified script; lines that throughout are emitted alike, in a few shapes, mark generated code; literals that are nearly all of the code mark data. Where a tool or a third party wrote code in the layout
people use, layout can't tell: there notices in comments, lock files' names, folders of package managers, heads
that name a release and its licence, and the copies of such code decide.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.session import written

#: A script is minified from this many canonical lines to a line; lines of a file are uniform if of so many, so large a
#: share is emitted like another one and one shape has so large a share; data is code of so many characters of which so
#: large a share is literals; a copy is recognised by its code from so many characters.
EXPANSION, UNIFORM_LINES, UNIFORM, UNIFORM_TOP, DATA_CHARS, DATA_SHARE, COPY_CHARS = 6.0, 15, 0.85, 0.3, 1500, 0.78, 120

# Extensions, path conventions and notices.
SCRIPTS = ["js", "mjs", "cjs", "jsx", "ts", "tsx", "css"]
PROGRAMS = [*SCRIPTS, "py", "java", "go", "rb", "php", "c", "h", "cc", "cpp", "hpp", "cs", "kt", "kts", "swift", "rs", "scala", "sh", "pl", "lua", "dart"]
HASH_COMMENTS = {"py", "sh", "rb", "yml", "yaml", "toml", "tf", "pl", "env", "ini", "properties", "sum", "lock"}
LOCK_FILES = (
    r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|poetry\.lock|pipfile\.lock|uv\.lock|pdm\.lock|go\.sum"
    r"|cargo\.lock|composer\.lock|gemfile\.lock|mix\.lock|flake\.lock|packages\.lock\.json|gradle\.lockfile|\.terraform\.lock\.hcl)$"
)
GENERATED_PATHS = (
    r"(^|/)(gen|generated|__generated__|autogen|generated-sources|generated-src|generated_src)/"
    r"|(_pb2|_pb2_grpc|_grpc_pb)\.pyi?$|\.pb(\.gw)?\.(go|cc|h)$|\.g\.(ts|dart|cs)$|outerclass\.java$|\.(generated|designer)\.\w+$|_generated\.\w+$"
)
#: Folders that package managers and vendoring tools fill; ``libs``, ``deps`` or ``external`` alone prove nothing.
VENDORED_PATHS = r"(^|/)(node_modules|bower_components|jspm_packages|vendor|third[_-]party|thirdparty|godeps|site-packages|dist-packages|pods|carthage)/"
NOTICE = re.compile(
    r"""code\ generated\b.*?\bdo\ not\ edit | @generated\b | <auto-?generated\b
    | ^\W*(?:this\ (?:file|code|class|module)\ (?:is|was|has\ been)\ )?(?:auto(?:matically)?[-\ ]?)?generated\ (?:by|from|with)\ (?!the\b|an?\b|this\b|these\b)
    | \bthis\ (?:file|code|class|module)\ (?:is|was|has\ been)\ (?:auto(?:matically)?[-\ ]?)?(?:generated|written|created|produced)\b
    | ^\W*auto-?generated\b | ^\W*machine[-\ ](?:written|generated|made)\b
    | automatisch\ (?:erzeugt|erstellt|generiert) | nicht\ von\ hand\ (?:ändern|bearbeiten) | fichier\ (?:produit|généré)\ par | ne\ pas\ modifier
    | généré\ automatiquement | (?:generado|gerado|generato)\ autom | 自動生成 | 自动生成 | ^\W*do\ not\ (?:edit|modify)\b""",
    re.I | re.M | re.X,
)
LICENCE = re.compile(
    r"""\bunmodified\ copy\b | \breleased\ under\ the\ \S+\ licen[cs]e | \blicensed\ under\ the\b | \bpermission\ is\ hereby\ granted
    | spdx-license-identifier:(?!\ *(?:proprietary|licenseref)) | \|\ *\(c\)[^|\n]*\|\ *(?:mit|isc|bsd|apache|mpl|[al]?gpl)""",
    re.I | re.X,
)
#: A head names a third party's release only if a release number stands there, too: own files have licences as well.
RELEASE = re.compile(r"(?<![\d.])v?\d+\.\d+\.\d+(?![\d.])|\bunmodified copy\b", re.I)

STRING = r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\'|`(?:[^`\\]|\\[\s\S])*`'
SLASH = re.compile(rf"({STRING})|/\*[\s\S]*?\*/|//[^\n]*|<!--[\s\S]*?-->")
HASH = re.compile(rf"({STRING})|\#[^\n]*")
HEAD = re.compile(r"(?:\s*(?:/\*[\s\S]*?\*/|//[^\n]*|\#[^\n]*|<!--[\s\S]*?-->))*")
NUMBER = re.compile(r"\b\d[\w.]*")
NAME = re.compile(r"[^\W\d]\w*")
SPACE = re.compile(r"\s+")

LAYOUT = "lines int, emitted int, code int, literal int, repeats double, top double, notice boolean, licence boolean, body long"

#: Canonical layout: lines that go on are joined, and no blanks stand but between words; in languages of braces a line
#: ends behind every statement and brace, else where it ended.
GOES_ON = re.compile(r"(?<=[,(\[{\\])\n\s*|\n\s*(?=[)\]}])")
LOOSE_BLANKS = re.compile(r"^[^\S\n]++|(?<![\w\s])[^\S\n]++|[^\S\n]++(?!\w)", re.M)
ENDS_LINE = re.compile(r"([;{}])\n*")


def canonical(bare: str, indented: bool) -> tuple[list[str], list[str]]:
    """The lines of a text without comments and string contents as they are but for their blanks, and in canonical layout."""
    dense = LOOSE_BLANKS.sub("", bare)
    text = GOES_ON.sub("", dense) if indented else ENDS_LINE.sub(r"\1\n", dense)
    return [x for x in dense.split("\n") if x], [x for x in text.split("\n") if x]


def layout(content: str, extension: str) -> tuple:
    """The measures of one file; see :data:`LAYOUT`."""
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    head = HEAD.match(text).group()
    literal = 0
    strings: list[str] = []
    comments: list[str] = []

    def blank(m: re.Match) -> str:
        nonlocal literal
        s = m.group(1)
        if s is None:
            comments.append(m.group())
            return ""
        literal += len(s)
        strings.append(s)
        return '""'

    bare = (HASH if extension in HASH_COMMENTS else SLASH).sub(blank, text)
    packed = SPACE.sub("", bare)
    literal += sum(map(len, NUMBER.findall(bare)))
    code = len(packed) + sum(map(len, strings)) - 2 * len(strings)
    lines, emitted = canonical(bare, extension in HASH_COMMENTS)
    shapes = Counter(NAME.sub("w", NUMBER.sub("0", "\n".join(lines))).split("\n"))
    del shapes[""]
    n = shapes.total()
    digest = xxhash.xxh64_intdigest(packed + "\0" + "\0".join(strings)) - 2**63
    top = max(shapes.values(), default=0) / n if n else 0.0
    repeats = 1 - len(shapes) / n if n else 0.0
    third = bool(LICENCE.search(head)) and bool(RELEASE.search(head))
    return len(lines), len(emitted), code, literal, repeats, top, bool(NOTICE.search("\n".join(comments))), third, digest


def measures(files: DataFrame) -> DataFrame:
    """``file_id, path, extension`` (both canonical) and the layout of every file with content."""

    @F.pandas_udf(LAYOUT)
    def measure(content: pd.Series, extension: pd.Series) -> pd.DataFrame:
        rows = [layout(c, e) for c, e in zip(content, extension)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in LAYOUT.split(", ")])

    path = F.lower(F.replace(F.coalesce("relative_path", F.lit("")), F.lit("\\"), F.lit("/")))
    return (
        files.where(F.col("content").isNotNull() & F.col("file_id").isNotNull())
        .select("file_id", path.alias("path"), F.length("content").alias("chars"), "content")
        .withColumn("extension", F.regexp_extract("path", r"\.(\w+)$", 1))
        .withColumn("m", measure("content", "extension"))
        .select("file_id", "path", "chars", "extension", "m.*")
    )


def _by_layout() -> Column:
    """What the comparison with the canonical layout tells, or null."""
    lines = F.greatest(F.col("lines"), F.lit(1))
    share = F.col("literal") / F.greatest(F.col("code"), F.lit(1))
    program = F.col("extension").isin(PROGRAMS)
    uniform = (F.col("lines") >= UNIFORM_LINES) & (F.col("repeats") >= UNIFORM) & (F.col("top") >= UNIFORM_TOP)
    return (
        F.when(F.col("extension").isin(SCRIPTS) & (F.col("emitted") / lines >= EXPANSION), "minified")
        .when(program & (F.col("code") >= DATA_CHARS) & (share >= DATA_SHARE), "data")
        .when(program & uniform & (share < DATA_SHARE / 2), "generated")
    )


def _kind(third_party: Column) -> Column:
    """Why a file isn't hand-written, or null: by layout, else by what else speaks for a tool or a third party."""
    return (
        F.when(F.col("path").rlike(LOCK_FILES), "lock file")
        .when(_by_layout().isNotNull(), _by_layout())
        .when(F.col("notice") | F.col("path").rlike(GENERATED_PATHS), "generated")
        .when(third_party, "third party")
    )


def kinds(files: DataFrame) -> DataFrame:
    """``file_id, kind, chars`` of every file with content and id; the kind of those the team wrote is null.

    Kinds are lock file, generated, third party, minified and data. The detector's flags are not used. A null path
    counts as empty, and then only the content speaks. Repeated rows give one; rows of one id that disagree give
    the alphabetically first kind and the greatest length. Whole contents are lexed, once: the measures, a few
    numbers a file, are written to the shared folder, as both sides of the copies' join need them.
    """
    measured = written(measures(files).withColumn("known", F.col("licence") | F.col("path").rlike(VENDORED_PATHS)))
    copies = measured.where(F.col("known") & (F.col("code") >= COPY_CHARS)).select("body").distinct().withColumn("copied", F.lit(True))
    return (
        measured.join(copies, "body", "left")
        .select("file_id", "chars", _kind(F.col("known") | F.coalesce("copied", F.lit(False))).alias("kind"))
        .groupBy("file_id")
        .agg(F.min("kind").alias("kind"), F.max("chars").cast("long").alias("chars"))
    )


def not_handwritten(files: DataFrame) -> DataFrame:
    """``file_id, kind`` of every file with content that nobody on the team wrote; see :func:`kinds`."""
    return kinds(files).where("kind is not null").select("file_id", "kind")
