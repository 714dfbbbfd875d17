"""Text functions as Column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import STEM_WIDTH, STOP

#: A line that is markup, not prose, starts with one of these (fixed values).
FURNITURE = ("#", "|", "---", ">", "**", "![", "[!", "- [ ]", "- [x]", "- [X]")


def tokens(text: Column) -> Column:
    """Stemmed words with repeats: lower case, letters and digits, no stop words, six characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(*STOP)), lambda w: F.substring(w, 1, STEM_WIDTH))


def stems(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def normal(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(normal(text), 256)


def prose_lines(text: Column) -> Column:
    """Lines of prose: without front matter, fenced code, indented code and markup lines."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, r"(?m)\A[ \t]*---[ \t]*\n(?s:.*?)(?:^[ \t]*---[ \t]*$|\z)", "")
    t = F.regexp_replace(t, r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\z)", "")
    lines = F.filter(F.split(t, "\n"), lambda x: ~x.startswith("    "))
    plain = lambda x: (x != "") & ~x.rlike(r"^(?:#|\||---|>|\*\*|!\[|\[!|- \[[ xX]\])")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), plain)


def strip_furniture(line: Column) -> Column:
    line = F.regexp_replace(line, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return F.replace(F.replace(line, F.lit("**"), F.lit("")), F.lit("`"), F.lit(""))


def snippet(text: Column, width: int = 70) -> Column:
    first = F.coalesce(F.try_element_at(prose_lines(text), F.lit(1)), text)
    return F.substring(normal(strip_furniture(first)), 1, width)


def sentences(text: Column, least: int = 30) -> Column:
    """Candidate sentences of the prose, each closed by one full stop."""
    bare = F.transform(prose_lines(text), lambda x: F.regexp_replace(strip_furniture(x), r"^[-*]\s+", ""))
    parts = F.flatten(F.transform(bare, lambda x: F.split(F.regexp_replace(x, r"([.?!])\s+", "$1\x01"), "\x01")))
    clean = F.transform(parts, lambda s: F.regexp_replace(F.trim(s), r"[.:?!]+$", ""))
    return F.transform(F.filter(clean, lambda s: F.length(s) >= least), lambda s: F.concat(s, F.lit(".")))


def first_line(text: Column) -> Column:
    """What stands in for a text without sentences: its first line, at most 200 characters."""
    line = F.try_element_at(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1))
    return F.concat(F.regexp_replace(F.substring(line, 1, 200), "[.:]+$", ""), F.lit("."))


def claims_of(text: Column) -> Column:
    """The candidate sentences, else the first line, else nothing."""
    own = sentences(text)
    spare = first_line(text)
    return F.when(F.size(own) > 0, own).when(spare.isNotNull(), F.array(spare)).otherwise(F.array().cast("array<string>"))


def extract_claim(text: Column) -> Column:
    """struct(subject, predicate, value): sha-256, IPv4, port, version or key=value, the first that occurs; else null."""
    quad = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    one = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    sha, ip, port, version = one(r"\b([0-9a-fA-F]{64})\b"), one(rf"\b((?:{quad}\.){{3}}{quad})\b"), one(r"(?i)\bport\s+([0-9]{1,5})\b"), one(r"\b([0-9]+\.[0-9]+\.[0-9]+)\b")
    key = r"(?m)^[ \t]*([A-Za-z_][A-Za-z0-9_.-]*)[ \t]*=[ \t]*([^ \t\n]+)[ \t]*$"
    claim = lambda s, p, v: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), v.alias("value"))
    found = F.when(sha.isNotNull(), claim(F.lit("sha256"), "is", F.lower(sha))).when(ip.isNotNull(), claim(F.lit("ipv4"), "is", ip))
    found = found.when(F.try_to_number(port, F.lit("99999")).between(1, 65535), claim(F.lit("port"), "is", port))
    found = found.when(version.isNotNull(), claim(F.lit("version"), "is", version))
    return found.when(text.rlike(key), claim(F.regexp_extract(text, key, 1), "=", F.regexp_extract(text, key, 2)))


def wikilinks(text: Column) -> Column:
    """Targets of [[links]] outside code: without alias, heading and folder suffix."""
    t = F.regexp_replace(text, r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\z)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"`[^`\n]*`", ""), r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(t, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, r"^([^|#^]*)", 1), r"\.md$", ""))), lambda x: x != ""))


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of every object in order, at every depth, and without blanks, so that neither says anything; equal
    numbers are written alike (1.0 as 1). What is no JSON, or has a key twice, stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def frontmatter(text: Column) -> Column:
    """Flat key: value front matter as a map; empty where there is none."""
    block = F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":") & ~F.ltrim(x).startswith("#"))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.regexp_replace(F.trim(F.substring(x, F.instr(x, ":") + F.lit(1), F.length(x))), "^[\"']|[\"']$", ""))
    pairs = F.transform(lines, pair)
    return F.map_from_entries(F.filter(pairs, lambda p: F.array_position(F.transform(pairs, lambda q: q["col1"]), p["col1"]) > 0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


# Words and tokens that carry no claim (stop words; dates, numbers, prices, links, paths).
NO_CLAIM = (
    "the a an is are was were of for to in on at and or as by with from this that it its their his her been be now so far only not yet "
    "done set up built via re"
).split()
METADATA = r"(?i)^(?:\d{4}-\d{2}(-\d{2})?|\$?\d[\d,.]*[km%]?|\[\[.*|https?:.*|[~./\\].*|.*[/\\].*|.*\.md)$"


def claim_tokens(c: Column) -> Column:
    """Lower-case tokens of a sentence without code spans and marks."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(c, r"`[^`]+`", " ")), r"[*_#>|()\[\],:;!?]", " ")
    return F.filter(F.transform(F.split(plain, r"\s+"), lambda t: F.btrim(t, F.lit("."))), lambda t: t != "")


def content_diff(a: Column, b: Column) -> Column:
    """The claim-bearing tokens that two token lists do not hold equally often, in order: a difference of bags, so a repeated word
    counts. Empty if the two differ in metadata only."""
    many = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    differ = F.filter(F.array_distinct(F.concat(a, b)), lambda t: many(a, t) != many(b, t))
    return F.array_sort(F.filter(differ, lambda t: ~t.isin(*NO_CLAIM) & ~t.rlike(METADATA) & t.rlike(r"\p{L}")))
