"""The node table: its columns and the fixed lattices of trust channels and confidentiality."""

from __future__ import annotations

from pyspark.sql import types as T

# Trust channels and their ranks, confidentiality levels, query stop words, stem width.
RANK = {"endorsed": 3, "user": 2, "agent-derived": 1, "external": 0}
CONF = {"public": 0, "internal": 1, "secret": 2, "topsecret": 3}
STOP = ("how", "should", "i", "a", "an", "the", "do", "does", "what", "my", "to", "is", "it", "of", "for", "with", "in", "on", "and", "or")
STEM_WIDTH = 6
K1, B, RRF_C = 1.2, 0.75, 60

_L, _S, _I, _D, _TS = T.LongType(), T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampType()
#: One complete schema with defaults instead of probing for columns.
NODE_DEFAULTS = {
    "status": "live", "tombstoned": 0, "redacted": 0, "archived": 0, "stale": 0, "conf_label": 0, "forget_tier": "hot", "forget_count": 0,
}
NODES = T.StructType([T.StructField(n, t) for n, t in (
    ("id", _L), ("content", _S), ("channel", _S), ("label", _I), ("source_ref", _S), ("created_at", _TS),
    ("tombstoned", _I), ("tombstoned_at", _TS), ("revoke_reason", _S), ("status", _S), ("quarantine_reason", _S), ("quarantined_at", _TS),
    ("redacted", _I), ("redacted_at", _TS), ("redact_reason", _S), ("conf_label", _I), ("content_hash", _S), ("archived", _I), ("archived_at", _TS),
    ("stale", _I), ("stale_at", _TS), ("stale_reason", _S), ("uuid", _S), ("origin", _S), ("forget_rs", _D), ("forget_ss", _D),
    ("forget_count", _I), ("forget_first_seen", _TS), ("forget_last_used", _TS), ("forget_tier", _S), ("bridge_path", _S), ("bridge_mtime", _S),
)])


def conform(df):
    """Any subset of the node columns as the full schema, with defaults for what is missing or null."""
    from pyspark.sql import functions as F

    out = []
    for f in NODES.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in NODE_DEFAULTS:
            c = F.coalesce(c, F.lit(NODE_DEFAULTS[f.name]))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def parse_rank(value) -> int:
    """A rank given as a number, a digit or a channel name."""
    if isinstance(value, str) and not value.strip().isdigit():
        if value.strip().lower() not in RANK:
            raise ValueError(f"unknown channel {value!r}")
        return RANK[value.strip().lower()]
    if not 0 <= int(value) <= 3:
        raise ValueError(f"rank out of range: {value!r}")
    return int(value)


def parse_conf(value) -> int:
    """A confidentiality level given as a number, a digit or a name."""
    if isinstance(value, str) and not value.strip().isdigit():
        if value.strip().lower() not in CONF:
            raise ValueError(f"unknown level {value!r}")
        return CONF[value.strip().lower()]
    if not 0 <= int(value) <= 3:
        raise ValueError(f"level out of range: {value!r}")
    return int(value)
