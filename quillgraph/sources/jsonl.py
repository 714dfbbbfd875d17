"""JSON lines: tolerant scans with references to the line, two transcript formats, usage logs, changesets and plain sinks.

A line that is no JSON object is skipped; values are taken as variants, so a field may be a string in one line and a list of
blocks in the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import lines

#: Fixed value: how the header of a changeset names its format (a prefix may name the writer).
FORMAT = "changeset-v1"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text(v: Column, path: str) -> Column:
    """The string at a path; null for values of other kinds."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(_kind(at) == "STRING", F.try_variant_get(v, path, "string"))


def records(spark: SparkSession, path, glob: str | None = "*.jsonl") -> DataFrame:
    """(ref, n, v): the objects of JSON-lines files, ref is ``name#L<n>``."""
    parsed = lines(spark, path, glob).select(F.concat("name", F.lit("#L"), F.col("n").cast("string")).alias("ref"), "n", F.try_parse_json("line").alias("v"))
    return parsed.where(F.startswith(_kind(F.col("v")), F.lit("OBJECT")))


def flat_text(v: Column, path: str) -> Column:
    """A content field as text: a string, or the texts of a list's strings and blocks, one a line. Blocks without text are dropped."""
    at = F.try_variant_get(v, path, "variant")
    blocks = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(blocks, lambda b: F.when(_kind(b) == "STRING", F.try_variant_get(b, "$", "string")).otherwise(_text(b, "$.text")))
    return F.when(_kind(at) == "STRING", F.try_variant_get(v, path, "string")).otherwise(F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n"))


def transcripts(spark: SparkSession, path, form: str, glob: str | None = "*.jsonl") -> DataFrame:
    """(ref, role, channel, text) of chat transcripts.

    ``message``: the type is the role, the text is message.content. ``payload``: only response_item lines whose payload is a
    message of a user or an assistant; their event mirrors and all other lines are dropped. Blank texts are dropped. A user's
    words are of channel user, all others agent-derived."""
    v = F.col("v")
    rows = records(spark, path, glob)
    if form == "message":
        found = rows.where(_text(v, "$.type").isin("user", "assistant") & F.startswith(_kind(F.try_variant_get(v, "$.message", "variant")), F.lit("OBJECT")))
        found = found.select("ref", F.coalesce(_text(v, "$.message.role"), _text(v, "$.type")).alias("role"), flat_text(v, "$.message.content").alias("text"))
    elif form == "payload":
        found = rows.where((_text(v, "$.type") == "response_item") & (_text(v, "$.payload.type") == "message") & _text(v, "$.payload.role").isin("user", "assistant"))
        found = found.select("ref", _text(v, "$.payload.role").alias("role"), flat_text(v, "$.payload.content").alias("text"))
    else:
        raise ValueError(f"unknown form of transcripts: {form!r}")
    found = found.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return found.select("ref", "role", F.when(F.col("role") == "user", "user").otherwise("agent-derived").alias("channel"), "text")


def instant(c: Column) -> Column:
    """ISO-8601 with an offset or Z; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def usage_events(spark: SparkSession, path, after: str | None = None, glob: str | None = "*.jsonl") -> DataFrame:
    """(stem, ts, hits) of usage logs: uses without hits and those up to the cutoff are left out, unreadable times are kept."""
    v = F.col("v")
    hits = F.coalesce(F.try_variant_get(v, "$.hits", "long"), F.lit(0))
    rows = records(spark, path, glob).select(_text(v, "$.stem").alias("stem"), _text(v, "$.ts").alias("ts"), hits.alias("hits")).where("hits <> 0 and stem is not null")
    if after is not None:
        rows = rows.where(F.coalesce(instant(F.col("ts")) > instant(F.lit(after)), F.lit(True)))
    return rows


def usage_by_stem(events: DataFrame) -> DataFrame:
    """(stem, n, hits, first_used, last_used), times as they are written."""
    return events.groupBy("stem").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"), F.min("ts").alias("first_used"), F.max("ts").alias("last_used"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, null fields written."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_changeset(path: str, origin: str, exported_at: str, nodes: DataFrame, edges: DataFrame, redactions: DataFrame, writer: str = "quillgraph") -> None:
    """A changeset folder: a header, a line for each of nodes(uuid, ...), edges(child, parent) and redactions(uuid, redacted_at)."""
    line = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("type"), *df.columns), {"ignoreNullFields": "false"}).alias("value"))
    spark = nodes.sparkSession
    header = spark.createDataFrame([(f"{writer}-{FORMAT}", origin, exported_at)], "format string, origin string, exported_at string")
    parts = [line(header, "header"), line(nodes, "node"), line(edges.select("child", "parent"), "edge"), line(redactions.select("uuid", "redacted_at"), "redaction")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.write.text(path)


def read_changeset(spark: SparkSession, path, node: str) -> dict[str, DataFrame]:
    """header, nodes (of the given schema), edges, redactions of a changeset; damaged lines and incomplete records are skipped.

    Without a header of the format the whole is refused."""
    v = F.col("v")
    rows = records(spark, path, None).withColumn("type", _text(v, "$.type"))
    header = rows.where("type = 'header'").select(_text(v, "$.format").alias("format"), _text(v, "$.origin").alias("origin"), _text(v, "$.exported_at").alias("exported_at")).where(F.endswith("format", F.lit(FORMAT)))
    if header.isEmpty():
        raise ValueError("no changeset: a header of the format is missing")
    nodes = rows.where("type = 'node'").select(F.from_json(F.to_json("v"), node).alias("n")).select("n.*")
    edges = rows.where("type = 'edge'").select(_text(v, "$.child").alias("child"), _text(v, "$.parent").alias("parent")).where("child is not null and parent is not null")
    gone = rows.where("type = 'redaction'").select(_text(v, "$.uuid").alias("uuid"), _text(v, "$.redacted_at").alias("redacted_at")).where("coalesce(uuid, '') <> ''")
    return {"header": header, "nodes": nodes, "edges": edges, "redactions": gone}


def sync_out(folder: str, origin: str, *args, **options) -> str:
    """Write this origin's changeset into a folder that several origins share."""
    path = f"{folder.rstrip('/')}/origin={origin}"
    write_changeset(path, origin, *args, **options)
    return path


def sync_in(spark: SparkSession, folder: str, own: str, node: str) -> dict[str, DataFrame]:
    """What the other origins of a shared folder have written, with a column origin."""
    from pyspark.sql.utils import AnalysisException

    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(folder)
    names = [x.getPath().getName().removeprefix("origin=") for x in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root) if x.isDirectory()]
    out: dict[str, DataFrame] = {}
    for origin in sorted(n for n in names if n != own):  # one for each site, not for each row
        try:
            read = read_changeset(spark, f"{folder.rstrip('/')}/origin={origin}", node)
        except (ValueError, AnalysisException):
            continue  # a site that has not finished its write yet
        for kind, df in read.items():
            df = df.drop("origin").withColumn("origin", F.lit(origin))
            out[kind] = df if kind not in out else out[kind].unionByName(df)
    return out
