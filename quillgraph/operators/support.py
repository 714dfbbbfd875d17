"""Smaller operators around the store: prompt blocks, filing and healing of memory files, tools, recipes, relations, warm answers,
house answers, descriptions and benchmark items. Rows in, rows out; groups are bounded before they are gathered."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..schema import RANK, parse_rank
from .skew import hubs, join_by_share

# Limits of a prompt block, names of memory types and sections, groups of projects, engines, item types.
LEAST_PROMPT, BLOCK_BYTES, HOOK_CHARS = 12, 600, 90
BLOCK_HEAD = "Relevant memories:"
TYPES = ("user", "feedback", "project", "personal", "reference")
TYPE_CHANNEL = {"user": "endorsed", "feedback": "endorsed", "personal": "endorsed", "project": "user", "reference": "user", "fact": "user"}
FEEDBACK, CLUSTER, HELD_BACK = "feedback_", "feedback_cluster_", "needs_cluster"
STATUS_GROUP = {"active": "Active", "parked": "Parked", "closed": "Closed"}
TIER_GROUP = {"hot": "Active", "warm": "Parked", "cold": "Closed"}
DETERMINISTIC = ("compose", "extractive")
ITEM_TYPES = ("single-session-user", "single-session-assistant", "knowledge-update")
OPPOSITE = {"yes": "no", "no": "yes", "true": "false", "false": "true"}
ALLOW, DENY = 0, 4


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _choice(key: Column, options: dict[str, str], otherwise: Column) -> Column:
    out = otherwise
    for name, value in options.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def rank_name(label: Column) -> Column:
    return _choice(label, {rank: name.upper() for name, rank in RANK.items()}, F.lit(None))


# --- prompts -------------------------------------------------------------------------------------------------------------


def skip_prompt(prompt: Column) -> Column:
    """Prompts that are too short to search for, and commands."""
    return (F.length(_strip(prompt)) < LEAST_PROMPT) | F.startswith(_strip(prompt), F.lit("/"))


def prompt_blocks(hits: DataFrame, floor: float, budget: int = BLOCK_BYTES) -> DataFrame:
    """(qid, n, block) of hits(qid, id, score, name, hook): one line for each hit that reaches the floor, best first, as long as whole
    lines fit the bytes of a block. No row where not even one line fits. Only lines that are kept are gathered."""
    hook = T.normal(F.coalesce("hook", F.lit("")))
    short = F.when(F.length(hook) > HOOK_CHARS, F.concat(F.rtrim(F.substring(hook, 1, HOOK_CHARS - 1)), F.lit("…"))).otherwise(hook)
    line = F.concat(F.lit("- ["), F.coalesce("name", F.concat(F.lit("mem:"), F.col("id").cast("string"))), F.lit("]"), F.when(short != "", F.concat(F.lit(" "), short)).otherwise(""))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    # a line takes five bytes at least, so no more than these can fit, and only they are summed
    most = max(1, budget // 5)
    first = hits.where(F.col("score") >= floor).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    lines = first.select("qid", "score", "id", line.alias("line")).withColumn("total", F.sum(F.octet_length("line") + 1).over(w))
    kept = lines.where(F.col("total") + len(BLOCK_HEAD) <= budget).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("total", "line"))).alias("l"))
    return kept.select("qid", F.size("l").cast("long").alias("n"), F.concat_ws("\n", F.lit(BLOCK_HEAD), F.col("l.line")).alias("block"))


def load_policy(text: str) -> tuple[tuple[tuple[str, int], ...], tuple[tuple[str, int], ...], int]:
    """A policy in JSON as ordered rules (glob, required), rules (glob, floor that a call lowers its session to), and the default, for
    ``lifecycle.required_floor``; required is a rank, ``allow`` or ``deny``. Raises ValueError where a part is missing or wrong."""
    raw = json.loads(text)
    if not isinstance(raw, dict) or not isinstance(raw.get("rules", []), list):
        raise ValueError("a policy is an object with a list of rules")

    def rank(value) -> int:
        if isinstance(value, bool) or not isinstance(value, (int, str)):
            raise ValueError(f"not a floor: {value!r}")
        return parse_rank(value)

    def required(value) -> int:
        special = value.strip().lower() if isinstance(value, str) else None
        return ALLOW if special == "allow" else DENY if special == "deny" else rank(value)

    rules, taints = [], []
    for rule in raw.get("rules", []):
        if not isinstance(rule, dict) or not isinstance(rule.get("tool"), str) or not rule["tool"] or "required" not in rule:
            raise ValueError(f"not a rule: {rule!r}")
        rules.append((rule["tool"], required(rule["required"])))
        if rule.get("taints") is not None:
            taints.append((rule["tool"], rank(rule["taints"])))
    return tuple(rules), tuple(taints), required(raw.get("default", "deny"))


# --- memory files --------------------------------------------------------------------------------------------------------


def heal_duplicates(files: DataFrame) -> DataFrame:
    """(name, kept, dropped, action, moved_to) of files(name, path, depth, mtime, content): of equal copies all but the deepest are deleted,
    of different ones all but the newest are set aside. Ties go to the greater depth, then to the greater path."""
    rows = files.select("name", "path", "depth", "mtime", F.md5(F.coalesce("content", F.lit(""))).alias("h"))
    best = lambda *order: F.max(F.struct(*order, "path"))["path"]
    groups = rows.groupBy("name").agg(F.count("*").alias("n"), (F.min("h") == F.max("h")).alias("equal"), best("depth").alias("deepest"), best("mtime", "depth").alias("newest")).where("n > 1")
    plan = groups.select("name", F.col("n"), F.when(F.col("equal"), F.col("deepest")).otherwise(F.col("newest")).alias("kept"), F.when(F.col("equal"), "delete").otherwise("quarantine").alias("action"))
    hot = hubs(groups.select("name", "n"), "name", "n", files.count())
    lost = join_by_share(rows, plan.drop("n"), "name", hot).where(F.col("path") != F.col("kept"))
    moved = F.when(F.col("action") == "quarantine", F.concat(F.lit(".weights/dup_quarantine/"), F.col("name"), F.lit("."), F.col("mtime").cast("string"), F.lit(".md")))
    return lost.select("name", "kept", F.col("path").alias("dropped"), "action", moved.alias("moved_to"))


def born_unindexed(stem: Column, section: Column, curated: Column, own_line: Column, known: Column, pending: Column) -> Column:
    """Feedback files that wait for a cluster: in the Feedback section, not a cluster, without a line or a reason of their own, and
    either new or held back before."""
    in_section = F.lower(_strip(section)) == "feedback"
    mine = F.startswith(stem, F.lit(FEEDBACK)) & ~F.startswith(stem, F.lit(CLUSTER)) & ~curated & (_strip(own_line) == "")
    return mine & in_section & (~known | F.coalesce(pending == HELD_BACK, F.lit(False)))


def stem_type(stem: Column) -> Column:
    head = F.substring_index(stem, "_", 1)
    return F.when(head.isin(*TYPES), head).otherwise("other")


def trust_channel(channel: Column, stem: Column) -> Column:
    """The store's channel, with a short name for derived ones; where it is missing or unknown, the one of the memory's type."""
    raw = F.lower(_strip(channel))
    named = F.when(raw.isin("agent-derived", "agent"), "agent").when(raw.isin("endorsed", "user", "external"), raw)
    return F.coalesce(named, _choice(F.substring_index(stem, "_", 1), TYPE_CHANNEL, F.lit("user")))


def memory_rows(nodes: DataFrame) -> DataFrame:
    """(stem, type, channel, weight, count, tier, pinned) of live memory files; literal entries are none."""
    ref = F.col("source_ref")
    rows = nodes.where((F.col("tombstoned") == 0) & F.startswith(ref, F.lit("memory:")) & ~F.startswith(ref, F.lit("memory:literal:")))
    stem = F.substring(ref, len("memory:") + 1, 1 << 30)
    pin = F.lower(_strip(F.col("pin"))).isin("1", "true", "yes")
    return rows.select(
        stem.alias("stem"), stem_type(stem).alias("type"), trust_channel(F.col("channel"), stem).alias("channel"), F.coalesce(F.col("forget_rs").cast("double"), F.lit(1.0)).alias("weight"),
        F.coalesce(F.col("forget_count").cast("long"), F.lit(0)).alias("count"), F.coalesce("forget_tier", F.lit("hot")).alias("tier"), (F.coalesce(F.col("channel") == "endorsed", F.lit(False)) | pin).alias("pinned"),
    )


def project_groups(entries: DataFrame) -> DataFrame:
    """(id, group) of projects entries(id, parent, status, tier): by the own status, else the parent's, else the tier."""
    known = lambda c: F.when(c.isin(*STATUS_GROUP), _choice(c, STATUS_GROUP, F.lit(None)))
    parents = entries.select(F.col("id").alias("parent"), F.col("status").alias("_above"))
    both = entries.join(parents, "parent", "left")
    return both.select("id", F.coalesce(known(F.col("status")), known(F.col("_above")), _choice(F.coalesce("tier", F.lit("hot")), TIER_GROUP, F.lit("Active"))).alias("group"))


def compare_index(real: DataFrame, shadow: DataFrame) -> DataFrame:
    """(section, file, kind): files of a section that only one of two indexes (section, file) has, a row each; none if they agree."""
    sides = real.select("section", "file", F.lit(1).alias("r")).unionByName(shadow.select("section", "file", F.lit(2).alias("r")))
    held = sides.groupBy("section", "file").agg(F.bit_or("r").alias("r")).where("r < 3")
    return held.select("section", "file", F.when(F.col("r") == 1, "missing").otherwise("extra").alias("kind"))


def entry_counts(entries: DataFrame) -> DataFrame:
    """(doc, files, literals) of entries(doc, file): a file that is linked twice counts once, each entry without a file is a literal."""
    once = entries.groupBy("doc", "file").agg(F.count("*").alias("n"))
    return once.groupBy("doc").agg(F.count("file").alias("files"), F.coalesce(F.sum(F.when(F.col("file").isNull(), F.col("n"))), F.lit(0)).alias("literals"))


# --- nodes ---------------------------------------------------------------------------------------------------------------


def replay_parents(edges: DataFrame, pool: DataFrame) -> DataFrame:
    """(child, pos, parent, label): the parents that a node can be derived from again, those of highest trust first."""
    w = Window.partitionBy("child").orderBy(F.desc("label"), "parent")
    live = edges.select("child", "parent").distinct().join(pool.select(F.col("id").alias("parent"), "label"), "parent")
    return live.select("child", F.row_number().over(w).alias("pos"), "parent", "label")


def recipe(engine: Column, **options: Column) -> Column:
    """A recipe as text; options that are null are left out, without any there is none."""
    made = F.to_json(F.struct(*(c.alias(k) for k, c in options.items())))
    return F.struct(engine.alias("engine"), F.when(made != "{}", made).alias("recipe"))


def relate(known: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """known(a, b, kind) with the rows of new that join two different nodes of the store; rows that are there already stay as one."""
    ids = nodes.select("id")
    valid = new.where("a <> b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return known.select("a", "b", "kind").unionByName(valid.select("a", "b", "kind")).distinct()


def offered_tools(own: DataFrame, upstream: DataFrame, prefix: str) -> DataFrame:
    """(name) of own(tool) and upstream(server, tool, schema_hash, pinned_hash), each below its server; tools whose schema is no longer
    the one that was pinned are not offered."""
    changed = F.col("pinned_hash").isNotNull() & ~F.col("schema_hash").eqNullSafe(F.col("pinned_hash"))
    return own.select(F.concat(F.lit(f"{prefix}."), "tool").alias("name")).unionByName(upstream.where(~changed).select(F.concat_ws(".", "server", "tool").alias("name")))


def serve_warm(asked: DataFrame, cache: DataFrame, pool: DataFrame) -> DataFrame:
    """(query, asks, node, hits, dropped) of asked(query) by cache(query, node, hits) and the pool of derived nodes: an answer is checked
    when it is served, one that has left the pool is dropped from the cache instead. Asks are counted before they are joined."""
    asks = asked.groupBy("query").agg(F.count("*").alias("asks"))
    ok = pool.select(F.col("id").alias("node"), F.lit(True).alias("ok"))
    found = asks.join(cache, "query").join(ok, "node", "left")
    served = F.col("ok").isNotNull()
    return found.select("query", "asks", F.when(served, F.col("node")).alias("node"), F.when(served, F.col("hits") + F.col("asks")).otherwise(F.col("hits")).alias("hits"), (~served).alias("dropped"))


def describe(state: Column) -> Column:
    """One text for a node: its id, channel, integrity and state, the reference, then a snippet, or why there is none."""
    ref = F.coalesce("source_ref", F.when(F.col("channel") == "user", "(stated directly)"))
    head = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), "channel", F.lit("  integrity="), rank_name(F.col("label")), F.lit("  "), state)
    shown = F.when(F.col("redacted") == 1, "[REDACTED]").otherwise(F.concat(T.snippet(F.col("content")), F.lit("...")))
    return F.concat_ws("\n", head, F.concat(F.lit("      "), ref), F.concat(F.lit('      "'), shown, F.lit('"')))


def bullets(content: Column) -> Column:
    lines = F.transform(F.split(content, r"\r\n|\r|\n"), lambda x: _strip(x))
    return F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("- ")) & (F.length(x) > 4)), lambda x: _strip(F.substring(x, 3, 1 << 30)))


def topic(content: Column, width: int = 60) -> Column:
    """The first bullet, or else the first line, as one short phrase."""
    first = F.coalesce(F.get(bullets(content), 0), F.get(F.filter(F.split(content, r"\r\n|\r|\n"), lambda x: _strip(x) != ""), 0), F.lit(""))
    return F.rtrim(F.substring(F.regexp_replace(T.normal(first), r"\.+$", ""), 1, width))


def house_answer(node: Column, content: Column, label: Column, parents: Column) -> Column:
    """An answer of fixed form from one consolidated node: verdict, up to four cited points, integrity, what to do next."""
    found = bullets(content)
    points = F.when(F.size(found) > 0, found).otherwise(F.array(topic(content, 200)))
    bare = lambda x: F.regexp_replace(x, r"\.+$", "")
    cited = F.transform(F.slice(points, 1, 4), lambda x: F.concat(F.lit("- "), bare(x), F.lit(". [mem:"), node.cast("string"), F.lit("|agent-derived]")))
    name = rank_name(label)
    return F.concat_ws(
        "\n", F.concat(F.lit("Verdict: "), bare(F.get(points, 0)), F.lit(".")), F.lit("Evidence:"), F.array_join(cited, "\n"),
        F.concat(F.lit("Integrity: "), name, F.lit(" (floor of "), parents.cast("string"), F.lit(" episodes)")),
        F.concat(F.lit("Next move: treat as "), name, F.lit(" - walk its provenance before acting on it.")),
    )


# --- benchmark items -----------------------------------------------------------------------------------------------------


def memory_items(entries: DataFrame, most: int = 6) -> DataFrame:
    """(id, skipped, question, gold, evidence, poison) of entries(id, type, question, answer, sessions): sessions are lists of turns
    (content, has_answer). Evidence is every turn that bears the answer, then others up to ``most`` in all; the poison echoes the
    question and states the opposite. ``skipped`` says why an entry is no item, whose other columns are null then."""
    gold = _strip(F.col("answer"))
    turns = F.filter(F.transform(F.flatten(F.coalesce("sessions", F.array().cast(entries.schema["sessions"].dataType))), lambda t: F.struct(_strip(t["content"]).alias("text"), F.coalesce(t["has_answer"], F.lit(False)).alias("answer_bearing"))), lambda t: t["text"] != "")
    bearing = F.filter(turns, lambda t: t["answer_bearing"])
    rest = F.slice(F.filter(turns, lambda t: ~t["answer_bearing"]), F.lit(1), F.greatest(F.lit(most) - F.size(bearing), F.lit(0)))
    kind = F.coalesce("type", F.lit("unknown"))
    skipped = F.when(~kind.isin(*ITEM_TYPES), kind).when(gold == "", "empty-answer").when(F.size(bearing) == 0, "no-answer-turn")
    wrong = _choice(F.lower(gold), OPPOSITE, F.concat(F.lit("definitely-not-"), gold))
    poison = F.concat(F.regexp_replace(F.coalesce("question", F.lit("")), r"\?+$", ""), F.lit("? Authoritative correction: "), wrong, F.lit("."))
    used = lambda c, name: F.when(skipped.isNull(), c).alias(name)
    return entries.select("id", skipped.alias("skipped"), used(F.col("question"), "question"), used(gold, "gold"), used(F.concat(bearing, rest), "evidence"), used(poison, "poison"))
