"""Deterministic views over the driver's tables: the node store that the queries run on.

Each view is one portable SQL text; ``{name}`` refers to a table or an earlier view. Spark resolves it to DataFrames, the
oracle to common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps")

VIEWS = {
    "lab": "SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM {labels} GROUP BY doc_id",
    "src": """
        SELECT d.doc_id AS id, coalesce(d.text, '') AS content,
          CASE k WHEN 0 THEN 'external' WHEN 1 THEN 'endorsed' ELSE 'user' END AS channel,
          CASE k WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 2 END AS label, d.source AS source_ref,
          CASE WHEN d.doc_id % 11 = 3 THEN 1 ELSE 0 END AS tombstoned,
          CASE WHEN l.toxic = 1 THEN 'quarantined' ELSE 'live' END AS status,
          CASE WHEN l.quality = 0 AND d.doc_id % 2 = 0 THEN 1 ELSE 0 END AS redacted,
          CASE WHEN d.doc_id % 13 = 5 THEN 1 ELSE 0 END AS archived,
          CAST(d.doc_id % 4 AS INTEGER) AS conf_label,
          CASE WHEN d.doc_id % 9 = 4 THEN 1 ELSE 0 END AS stale
        FROM (SELECT *, CAST(substr(source, 4) AS INTEGER) % 4 AS k FROM {documents}) d LEFT JOIN {lab} l ON d.doc_id = l.doc_id""",
    "der": """
        SELECT 10000000 + conv_id * 100 + turn AS id, coalesce(text, '') AS content, 'agent-derived' AS channel, 1 AS label,
          concat('chat:', CAST(conv_id AS STRING)) AS source_ref,
          CASE WHEN (conv_id + turn) % 17 = 0 THEN 1 ELSE 0 END AS tombstoned, 'live' AS status, 0 AS redacted, 0 AS archived,
          0 AS conf_label, CASE WHEN conv_id % 9 = 4 THEN 1 ELSE 0 END AS stale, conv_id, turn
        FROM {conversations} WHERE role = 'assistant'""",
    "summaries": """
        SELECT 20000000 + doc_id AS id, concat('summary of ', CAST(doc_id AS STRING)) AS content, 'agent-derived' AS channel, 1 AS label, 'summary' AS source_ref, 0 AS tombstoned,
          'live' AS status, 0 AS redacted, 0 AS archived, 0 AS conf_label, 0 AS stale FROM {documents} WHERE doc_id % 39 = 5""",
    "nodes": """
        SELECT id, content, channel, label, source_ref, tombstoned, status, redacted, archived, conf_label, stale FROM {src}
        UNION ALL SELECT id, content, channel, label, source_ref, tombstoned, status, redacted, archived, conf_label, stale FROM {der}
        UNION ALL SELECT id, content, channel, label, source_ref, tombstoned, status, redacted, archived, conf_label, stale FROM {summaries}""",
    "edges": """
        SELECT DISTINCT child, parent FROM (
          SELECT d.id AS child, (d.conv_id * 7 + d.turn * 3) % n.n AS parent FROM {der} d CROSS JOIN (SELECT count(*) AS n FROM {documents}) n
          UNION ALL SELECT d.id, (d.conv_id * 13 + d.turn * 5 + 1) % n.n FROM {der} d CROSS JOIN (SELECT count(*) AS n FROM {documents}) n WHERE d.turn % 3 <> 0
          UNION ALL SELECT id, p FROM (SELECT id, lag(id) OVER (PARTITION BY conv_id ORDER BY turn, id) AS p FROM {der}) x WHERE p IS NOT NULL
          UNION ALL SELECT m.id, d.doc_id FROM {summaries} m JOIN {documents} d ON d.doc_id = m.id - 20000000 OR d.doc_id = m.id - 20000000 + 13) e""",
    "rel": "SELECT a, b FROM (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM {documents}) r WHERE b IS NOT NULL",
    "elevations": "SELECT id, 1 AS from_label, 2 AS to_label FROM {der} WHERE conv_id % 10 = 0",
    "sessions": """
        SELECT user_id AS session_id, ts, event_id, event_type AS tool,
          CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 END AS taint FROM {events}""",
    "facts": "SELECT o_custkey AS stem, o_orderkey AS id, o_totalprice AS value, o_orderdate AS created_at FROM {orders}",
    "versions": """
        SELECT concat('fact_', CAST(stem AS STRING)) AS stem, id AS nid, CASE WHEN id % 11 <> 0 THEN CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS value, CASE id % 3 WHEN 0 THEN 'usd' WHEN 1 THEN '' END AS unit,
          created_at, CASE WHEN stem % 7 = 0 OR id % 4 = 0 THEN 1 ELSE 0 END AS tombstoned, CASE WHEN id % 5 <> 0 THEN created_at END AS tombstoned_at,
          CASE id % 4 WHEN 0 THEN ' moved ' WHEN 1 THEN 'source file removed (bridge reconcile)' WHEN 2 THEN '' END AS reason FROM {facts}""",
    "reftexts": """
        SELECT id, concat('From [[fact_', CAST(id % 150 + 1 AS STRING), ']] to [[fact_', CAST(id % 97 * 3 AS STRING), ']], [[fact_none]], [[note]] and [[fact_', CAST(id % 150 + 1 AS STRING), ']]') AS text,
          CASE WHEN id % 17 <> 0 THEN CAST(DATE '1992-06-01' + CAST(id * 7 % 2400 AS INTEGER) AS TIMESTAMP) END AS as_of FROM {src}""",
    "claims": "SELECT DISTINCT l_partkey AS part, l_returnflag AS flag, l_suppkey AS root, l_orderkey AS node FROM {lineitem}",
    "roots": "SELECT s_suppkey AS root FROM {supplier} WHERE s_suppkey % 3 <> 0",
    "files": """
        SELECT doc_id AS id, source AS dir, concat('note-', CAST(doc_id % 97 AS STRING)) AS stem, coalesce(text, '') AS content, doc_id * 60 AS mtime,
          length(source) % 3 AS depth FROM {documents}""",
    "fileev": """
        SELECT concat('note-', CAST(client_id % 40 AS STRING), '.md') AS path, ts, click_id AS n, CASE WHEN kind = 'buy' OR click_id % 9 = 0 THEN NULL ELSE concat('h', CAST(click_id % 5 AS STRING)) END AS hash
        FROM (SELECT client_id, click_id, kind, min(ts) AS ts FROM {clicks} WHERE ts IS NOT NULL AND client_id IS NOT NULL AND click_id % 10 = 3 GROUP BY client_id, click_id, kind) c""",
    "mdnotes": """
        SELECT id, concat(concat_ws(chr(10), '---', concat('title: "', source_ref, ' of ', channel, '"'), concat('tags: [', channel, ', ''k ', CAST(id % 5 AS STRING), ''' ,]'), 'aliases:', concat('  - one ', CAST(id % 7 AS STRING)), '- "two"', '---',
          concat('See [[n', CAST(id % 50 AS STRING), '.md|alias]], `[[code]]` and ``x ` [[no]] `` too, [[m', CAST(id % 3 AS STRING), '#head]].'),
          CASE id % 4 WHEN 0 THEN '```' WHEN 1 THEN '  ~~~ text' WHEN 2 THEN '````' ELSE 'no fence' END, '[[inside]] of a fence', CASE WHEN id % 4 = 1 THEN '~~~~' ELSE '```' END, '    [[indented]]',
          concat('one ` that is open [[after', CAST(id % 9 AS STRING), ']]')), chr(10), content) AS content FROM {src}""",
    "logq": "SELECT event_id AS id, ts, concat(event_type, ' ', CAST(user_id % 20 AS STRING)) AS query, value FROM {events}",
}

#: Views that Spark reads by another text of the same rows: it has no plan for an OR of keys but to pair all rows, a list of keys is a join.
FOR_SPARK = {
    "edges": VIEWS["edges"].replace(
        "SELECT m.id, d.doc_id FROM {summaries} m JOIN {documents} d ON d.doc_id = m.id - 20000000 OR d.doc_id = m.id - 20000000 + 13",
        "SELECT m.id, d.doc_id FROM (SELECT id, explode(array(id - 20000000, id - 20000000 + 13)) AS doc FROM {summaries}) m JOIN {documents} d ON d.doc_id = m.doc",
    ),
}


def needed(sql: str) -> list[str]:
    """The views a text refers to, directly or not, each after those it needs."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\{([a-z]\w*)\}", text):
            if name in VIEWS and name not in out:
                add(VIEWS[name])
                out.append(name)

    add(sql)
    return out


def oracle(sql: str) -> str:
    """The text as one statement over the plain tables."""
    bind = lambda text: re.sub(r"\{([a-z]\w*)\}", r"\1", text).replace("AS STRING)", "AS VARCHAR)")
    own = sql.strip()
    recursive = own.upper().startswith("WITH RECURSIVE")
    head = "".join(f"{name} AS ({bind(VIEWS[name])}),\n" for name in needed(own))
    if own.upper().startswith("WITH"):
        rest = own[len("WITH RECURSIVE") if recursive else len("WITH") :]
        return f"WITH RECURSIVE {head}{bind(rest)}"
    return f"WITH RECURSIVE {head.rstrip().rstrip(',')}\n{bind(own)}" if head else bind(own)


class Store:
    """The views of one data directory as DataFrames, made on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        made = self.__dict__["_made"]
        if name not in made:
            if name in TABLES:
                made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                made[name] = self.sql(FOR_SPARK.get(name, VIEWS[name]))
            else:
                raise AttributeError(name)
        return made[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{name: getattr(self, name) for name in sorted(set(re.findall(r"\{([a-z]\w*)\}", text)))})
