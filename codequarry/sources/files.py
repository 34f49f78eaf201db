"""Trees of source files as a DataFrame, and what kind of file each one is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.text import forward_slashes, split_lines

MAX_BYTES, MAX_FILES, MAX_DEPTH, HEAD, LONG_LINE, LONG_SHARE = 512 * 1024, 5000, 20, 1000, 500, 0.2

# Ignored folders, languages, binary extensions, marks of generated files.
IGNORED_FOLDERS = """.git .svn .hg .venv venv .env node_modules __pycache__ .next .nuxt dist build out .tox .mypy_cache .pytest_cache htmlcov
coverage .coverage .cache .parcel-cache target .gradle .idea .vscode""".split()
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust",
    "php": "php", "rb": "ruby", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "c": "c", "h": "c", "hpp": "cpp", "sh": "shell", "bash": "shell",
    "zsh": "shell", "json": "json", "yaml": "yaml", "yml": "yaml", "html": "html", "htm": "html", "xml": "xml", "toml": "toml", "tf": "terraform",
    "env": "env",
}
ANALYZED = "python javascript typescript java go rust php ruby shell json yaml html env".split()
BINARY = """pyc pyo pyd so dylib dll lib a o exe bin out zip tar gz bz2 xz 7z rar png jpg jpeg gif bmp ico svg mp3 mp4 avi mov wav pdf docx xlsx
pptx db sqlite sqlite3 woff woff2 ttf eot class wasm""".split()
GENERATED_NAME = r"(?i)\.min\.|\.bundle\.|\.generated\.|\.pb\.go$|_pb2\.py$|\.g\.dart"
GENERATED_HEADS = ["// generated", "// auto-generated", "// do not edit", "# generated by", "# auto-generated", "# do not edit", "/* generated",
                   "/* auto-generated", "this file is auto-generated", "code generated by", "do not edit"]


def extension_of(path: Column) -> Column:
    """Lower case, without the point; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def language_of(extension: Column) -> Column:
    return F.coalesce(*[F.when(extension == e, F.lit(name)) for e, name in LANGUAGES.items()])


def is_generated(path: Column, content: Column) -> Column:
    """By name, or by a notice in the first thousand characters."""
    name, head = F.substring_index(forward_slashes(path), "/", -1), F.upper(F.substring(content, 1, HEAD))
    noticed = F.lit(False)
    for mark in GENERATED_HEADS:
        noticed = noticed | F.contains(head, F.lit(mark.upper()))
    return name.rlike(GENERATED_NAME) | F.coalesce(noticed, F.lit(False))


def is_minified(language: Column, content: Column) -> Column:
    """Scripts of which more than a fifth of the lines are longer than 500 characters."""
    lines = split_lines(content)
    long = F.size(F.filter(lines, lambda x: F.length(x) > LONG_LINE))
    return F.coalesce(language.isin("javascript", "typescript") & (long > LONG_SHARE * F.size(lines)), F.lit(False))


def read_tree(spark: SparkSession, root: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``relative_path, extension, language, size_bytes, is_binary, is_generated, is_minified, content`` of a tree.

    Ignored folders and paths deeper than 20 are left out and the first ``max_files`` by path are kept, which is
    the reader's documented limit. Content is null for binary files, larger ones and languages that aren't
    analysed; bytes that are no UTF-8 are replaced.
    """
    bare = root.split("://", 1)[-1].strip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.col("path"), rf"^(?:\w+:)?/*\Q{bare}\E/", "")
    parts = F.split("relative_path", "/")
    rows = (
        files.select(relative.alias("relative_path"), F.col("length").alias("size_bytes"), F.col("content").alias("bytes"))
        .where((F.size(parts) - 1 <= MAX_DEPTH) & ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, IGNORED_FOLDERS))))
    )
    kept = rows.select("relative_path").orderBy("relative_path").limit(max_files)
    rows = rows.join(kept, "relative_path", "left_semi").withColumn("extension", extension_of(F.col("relative_path")))
    sample = F.decode(F.substring("bytes", 1, 8192), "ISO-8859-1")
    nulls = F.length(sample) - F.length(F.replace(sample, F.lit("\0"), F.lit("")))
    binary = F.col("extension").isin(BINARY) | (nulls > 0.01 * F.least(F.col("size_bytes"), F.lit(8192)))
    rows = rows.withColumn("language", language_of(F.col("extension"))).withColumn("is_binary", binary)
    text = F.when(
        ~F.col("is_binary") & (F.col("size_bytes") <= max_bytes) & F.col("language").isin(ANALYZED), F.make_valid_utf8(F.col("bytes").cast("string"))
    )
    rows = rows.withColumn("content", text).drop("bytes")
    return rows.withColumn("is_generated", is_generated(F.col("relative_path"), F.col("content"))).withColumn(
        "is_minified", is_minified(F.col("language"), F.col("content"))
    )


def classified(files: DataFrame) -> DataFrame:
    """``file_id, language, generated, minified, scannable`` of table ``source_files``, recomputed; repeats give one row."""
    f = files.groupBy("file_id").agg(F.min(F.struct("relative_path", "content", "is_binary")).alias("f")).select("file_id", "f.*")
    ext = extension_of(F.col("relative_path"))
    rows = f.select(
        "file_id",
        language_of(ext).alias("language"),
        (ext.isin(BINARY) | F.coalesce("is_binary", F.lit(False))).alias("binary"),
        is_generated(F.col("relative_path"), F.col("content")).alias("generated"),
        is_minified(language_of(ext), F.col("content")).alias("minified"),
        F.col("content").isNotNull().alias("has_content"),
    )
    scannable = ~F.col("binary") & ~F.col("generated") & ~F.col("minified") & F.coalesce(F.col("language").isin(ANALYZED), F.lit(False)) & F.col("has_content")
    return rows.select("file_id", "language", "generated", "minified", scannable.alias("scannable"))


def delivered_lines(files: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, path, extension, copy_no, line_no, line`` (lines from 1); null and empty contents have no lines.

    A row that is delivered again has its lines again, under another ``copy_no``: the operators fold what they find
    in them, a few rows, so that contents are never shuffled to fold them.
    """
    path = forward_slashes(F.coalesce("relative_path", F.lit("")))
    return _cut(files.where(F.col("content").isNotNull()).select(key, path.alias("path"), "content", F.monotonically_increasing_id().alias("copy_no")), key)


def lines(files: DataFrame, key: str = "file_id") -> DataFrame:
    """As :func:`delivered_lines`, but repeated rows count once: for lines that are wanted themselves. ``copy_no`` is 0."""
    path = forward_slashes(F.coalesce("relative_path", F.lit("")))
    return _cut(files.where(F.col("content").isNotNull()).select(key, path.alias("path"), "content").distinct().withColumn("copy_no", F.lit(0).cast("long")), key)


def _cut(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "path", "copy_no", extension_of(F.col("path")).alias("extension"), F.posexplode(split_lines(F.col("content"))).alias("p", "line")).select(
        key, "path", "extension", "copy_no", (F.col("p") + 1).alias("line_no"), "line"
    )
