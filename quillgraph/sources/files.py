"""Scans of file trees: whole files, lines with references, and the predicates that say which paths count.

Paths are filtered on the listing (names, folders, sizes) before any content is read. Lines are numbered by file across splits:
a split's lines are counted first, so a file of any size is read by many tasks. Names that begin with a dot or an underscore are
hidden from Spark's file sources, and so from these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Folders and names that a note tree leaves out, generated index notes, code files and folders left out, most bytes.
NOTE_SKIP = (".obsidian", ".trash", ".git", ".sync", ".stfolder")
NOTE_TEMP = r"^\..*\.tmp$|~$|^\.#|\.tmp$"
INDEX_NOTES = ("MEMORY.md", "INDEX.md")
CODE_EXTS = (
    ".py", ".pyi", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".sh", ".bash", ".ps1", ".psm1", ".psd1", ".bat", ".cmd",
    ".go", ".rs", ".java", ".kt", ".c", ".h", ".hpp", ".cc", ".cpp", ".rb", ".php", ".lua", ".pl", ".sql", ".r",
    ".html", ".css", ".scss", ".vue", ".svelte", ".toml", ".ini", ".cfg", ".yaml", ".yml",
)
CODE_SKIP = (
    "__pycache__", ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "dist", "build", ".next", ".cache", "site-packages", ".tox", "target",
)
MAX_CODE_BYTES = 400_000


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folders_of(path: Column) -> Column:
    """The folders of a relative path, outermost first."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def is_note(path: Column) -> Column:
    """A Markdown file of a note tree, given by its path below the root: not a temporary one, not below a service folder."""
    return F.lower(path).endswith(".md") & ~name_of(path).rlike(NOTE_TEMP) & ~F.arrays_overlap(folders_of(path), F.array(*map(F.lit, NOTE_SKIP)))


def is_memory(path: Column) -> Column:
    """A memory file: flat, in projects/, or in a project's folder; never a generated index, never deeper."""
    return path.rlike(r"^(?:projects/(?:[^/]+/)?)?[^/]+\.md$") & ~name_of(path).isin(*INDEX_NOTES)


def is_code(path: Column, size: Column) -> Column:
    """A source file that an index takes: a known extension, no folder of products or dependencies, not too large."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return ext.isin(*CODE_EXTS) & ~F.arrays_overlap(folders_of(path), F.array(*map(F.lit, CODE_SKIP))) & (size <= MAX_CODE_BYTES)


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, rel, name, bytes, mtime, content) of all files below a root; what is not selected of content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    below = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/")
    prefix = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    rel = F.when(F.startswith(below, F.lit(prefix)), F.substr(below, F.lit(len(prefix) + 1))).otherwise(below)
    return files.select("path", rel.alias("rel"), name_of(F.col("path")).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), "content")


def text_of(content: Column) -> Column:
    """Bytes as UTF-8, malformed ones replaced."""
    return F.make_valid_utf8(content.cast("string"))


def text_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, rel, name, bytes, mtime, text) of all files below a root, in the order of their folders and names if sorted by rel."""
    return listing(spark, root, glob).withColumn("text", text_of(F.col("content"))).drop("content")


def notes(spark: SparkSession, root: str) -> DataFrame:
    files = listing(spark, root, "*.[mM][dD]").where(is_note(F.col("rel")))
    return files.withColumn("text", text_of(F.col("content"))).drop("content")


def memories(spark: SparkSession, root: str) -> DataFrame:
    files = listing(spark, root, "*.md").where(is_memory(F.col("rel")))
    return files.withColumn("text", text_of(F.col("content"))).drop("content")


def code_files(spark: SparkSession, root: str) -> DataFrame:
    files = listing(spark, root).where(is_code(F.col("rel"), F.col("bytes")))
    return files.withColumn("text", text_of(F.col("content"))).drop("content")


def lines(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """(file, name, n, line) of text files, blank lines left out but counted; n is the line's number in its file, from 1."""
    reader = spark.read.option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.make_valid_utf8("value").alias("line"))
    blocks = raw.groupBy("file", "block").agg(F.min("i").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = raw.join(blocks.select("file", "block", "first", before.alias("before")), ["file", "block"])
    n = F.col("before") + F.col("i") - F.col("first") + 1
    return placed.where(F.trim("line") != "").select("file", name_of(F.col("file")).alias("name"), n.cast("long").alias("n"), "line")
