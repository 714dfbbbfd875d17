"""Graph operators over edges(child, parent): loops whose state is written to the shared folder each round, and whose rounds grow with
the logarithm of a chain."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import discard, materialise, shared_path


def _steps(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(_s, _d), written once: the rounds of a loop do not derive the edges again."""
    return materialise(edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).distinct(), "steps")


def _unseen(new: DataFrame, seen: DataFrame, *by: str) -> DataFrame:
    """Rows of new whose key is not in seen; nulls are equal, so a null end is found once."""
    old = seen.select(*(F.col(c).alias(f"_{c}") for c in by))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return new.join(old, reduce(and_, on), "left_anti")


def distances(edges: DataFrame, seeds: DataFrame | None = None, src: str = "parent", dst: str = "child", most: int | None = None) -> DataFrame:
    """(seed, id, depth): the least number of edges, ``most`` at most, by which each seed (any node, without seeds) reaches an id from src
    to dst. Ways double: those of up to L edges go on by those of exactly L, so rounds grow with the logarithm of the depth, and a
    chain's pairs are made once. They end with a round that finds no new pair, on cycles, too. Ways of exactly L edges are kept for all
    nodes, so this is for seeds that are many."""
    jump, length = _steps(edges, src, dst), 1
    seen = jump if seeds is None else seeds.select(F.col("id").alias("_s")).distinct().join(jump, "_s")
    seen = materialise(seen.select(F.col("_s").alias("seed"), F.col("_d").alias("id"), F.lit(1).alias("depth")), "closure")
    while most is None or length < most:
        new = seen.join(jump, seen["id"] == jump["_s"]).select("seed", F.col("_d").alias("id"), (F.col("depth") + length).alias("depth"))
        new = (new if most is None else new.where(F.col("depth") <= most)).groupBy("seed", "id").agg(F.min("depth").alias("depth"))
        new = materialise(_unseen(new, seen, "seed", "id"), "closure")
        if new.isEmpty():
            break
        seen, length = seen.unionByName(new), 2 * length
        after = jump.select(F.col("_s").alias("_d"), F.col("_d").alias("_e"))
        before, jump = jump, materialise(jump.join(after, "_d").select("_s", F.col("_e").alias("_d")).distinct(), "steps")
        discard(before)
    return seen


def closure(edges: DataFrame, seeds: DataFrame, src: str = "parent", dst: str = "child", include_seed: bool = True) -> DataFrame:
    """(seed, id): what each seed reaches from src to dst, by ``distances``."""
    pairs = distances(edges, seeds, src, dst).select("seed", "id")
    if not include_seed:
        return pairs
    return pairs.where(~F.col("seed").eqNullSafe(F.col("id"))).unionByName(seeds.select(F.col("id").alias("seed"), "id").distinct())


#: Rounds of a frontier before what is left is contracted.
SHALLOW = 4


def reachable(edges: DataFrame, seeds: DataFrame, src: str = "parent", dst: str = "child") -> DataFrame:
    """(id): what any of the seeds reaches, seeds included; one set, not one for each seed. A frontier takes the first steps; what is
    deeper is the maximum over the parents (``lattice``), so rounds do not grow with the length of a chain."""
    step = _steps(edges, src, dst)
    frontier = seen = materialise(seeds.select("id").distinct(), "reach")
    for _ in range(SHALLOW):
        if frontier.isEmpty():
            return seen
        new = frontier.join(step, frontier["id"] == step["_s"]).select(F.col("_d").alias("id")).distinct()
        frontier = materialise(_unseen(new, seen, "id"), "reach")
        seen = seen.unionByName(frontier)
    if frontier.isEmpty():
        return seen
    rest = materialise(_unseen(step.withColumnRenamed("_d", "id"), seen, "id").select(F.col("id").alias("child"), F.col("_s").alias("parent")), "reach")
    known = seen.select("id", F.lit(True).alias("fixed")).distinct()
    ends = rest.select(F.explode(F.array("child", "parent")).alias("id")).where("id is not null").distinct().join(known, "id", "left")
    values = ends.select("id", F.col("fixed").isNotNull().cast("int").alias("value"), F.col("fixed").isNotNull().alias("fixed"))
    deep = materialise(lattice(values, rest, F.max, unresolved=None).where("value = 1").select("id"), "reach")
    # a null end is no node of the lattice
    null = rest.where("child is null").join(deep.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id")).distinct()
    return seen.unionByName(materialise(_unseen(deep.unionByName(null), seen, "id"), "reach"))


class _Store:
    """Rows that are added in parts, each a folder of its own, and read as one scan: no union grows with the parts."""

    def __init__(self, spark, name: str, schema: str):
        self.spark, self.schema, self.root, self.parts = spark, schema, shared_path(spark, name), []

    def add(self, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.parts):06d}"
        rows.write.parquet(path)
        self.parts.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.parts)


def _runs(p: DataFrame, two) -> tuple[DataFrame, DataFrame]:
    """p(id, next, o, m, sb): nodes with one open parent. Pointers jump until they leave the table, so rounds grow with the logarithm
    of a run: (id, head, o, m, sb), and those that never leave, which stand on a cycle or run into one, with all of it in o."""
    p = now = materialise(p, "runs")
    for _ in range(p.count().bit_length() + 1):
        after = now.select(F.col("id").alias("next"), F.col("next").alias("_n"), F.col("o").alias("_o"), F.col("m").alias("_m"), F.col("sb").alias("_sb"))
        # behind an unresolved node all that follows is unresolved and counts with its own values
        m = F.when(F.col("_n").isNull(), F.col("m")).otherwise(two(F.when(F.col("_sb"), F.col("o")).otherwise(F.col("m")), F.col("_m")))
        jumped = now.join(after, "next", "left").select("id", F.coalesce("_n", "next").alias("next"), two("o", "_o").alias("o"), m.alias("m"), (F.col("sb") | F.coalesce("_sb", F.lit(False))).alias("sb"), F.col("_n").isNotNull().alias("moved"))
        before, now = now, materialise(jumped, "runs")
        discard(before)
        if now.where("moved").isEmpty():
            return now.select("id", F.col("next").alias("head"), "o", "m", "sb"), now.where("moved").select("id", "o")
    return now.where("not moved").select("id", F.col("next").alias("head"), "o", "m", "sb"), now.where("moved").select("id", "o")


def lattice(values: DataFrame, edges: DataFrame, combine, unresolved: int | None = 0) -> DataFrame:
    """(id, value) for all nodes of values(id, value, fixed): a node that is fixed, or has no parent in the table, keeps its
    value; any other has combine(parents' values). Nodes that a cycle keeps from ever being resolved get ``unresolved`` or, if that
    is None, the fixpoint of combine from their own values and all that reaches them.

    Each round folds the parents that are resolved into their children, then contracts every run of nodes with one open parent to
    its head; children of a run look at the head from then on. Rounds grow with the logarithm of a chain, and with the depth of
    what has several open parents at every level. A node that holds the extreme value is resolved at once."""
    spark, two = values.sparkSession, combine_two(combine)
    values = materialise(values.select("id", F.col("value").cast("int").alias("value"), "fixed"), "lattice")
    own = edges.select("child", "parent").distinct()
    own = own.join(values.select(F.col("id").alias("parent")), "parent", "left_semi").join(values.where(~F.col("fixed")).select(F.col("id").alias("child")), "child", "left_semi")
    none = F.lit(None).cast("int")
    # w: what lies on the way to the parent; wo: the same with the nodes' own values; eb: an unresolved node lies on it
    left = materialise(own.select("child", "parent", none.alias("w"), none.alias("wo"), F.lit(False).alias("eb")), "lattice")
    resolved, deferred = _Store(spark, "lattice-done", f"id {dict(values.dtypes)['id']}, value int, bad boolean"), []
    open_ = values.join(left.select(F.col("child").alias("id")).distinct(), "id", "left_semi").select("id", none.alias("acc"), F.col("value").alias("own"), F.lit(False).alias("bad"))
    layer = resolved.add(values.join(left.select(F.col("child").alias("id")).distinct(), "id", "left_anti").select("id", "value", F.lit(False).alias("bad")))
    extreme = values.agg(combine("value")).first()[0]
    if unresolved is not None and extreme is not None:
        extreme = min(extreme, unresolved) if combine is F.min else max(extreme, unresolved)
        extreme = extreme if extreme == unresolved else None
    final = F.when(F.col("bad"), two("acc", "own") if unresolved is None else F.lit(unresolved)).otherwise(F.col("acc")).cast("int")
    while True:
        met = left.join(layer.select(F.col("id").alias("parent"), F.col("value").alias("pv"), F.col("bad").alias("pb")), "parent", "left")
        met = materialise(met.select("child", "parent", "w", "wo", "eb", "pv", "pb"), "lattice")
        on = F.col("pb").isNotNull()
        came = two(F.when(F.col("pb"), F.col("wo")).otherwise(F.col("w")), F.col("pv"))
        folds = met.groupBy(F.col("child").alias("id")).agg(
            combine(F.when(on, came)).alias("v"), F.coalesce(F.max(F.when(on, F.col("pb") | F.col("eb"))), F.lit(False)).alias("b"), F.count_distinct(F.when(~on, F.col("parent"))).alias("n"),
            *(f.alias(c) for c, f in (("p", F.max(F.when(~on, F.col("parent")))), ("w", combine(F.when(~on, F.col("w")))), ("wo", combine(F.when(~on, F.col("wo")))), ("eb", F.coalesce(F.max(F.when(~on, F.col("eb"))), F.lit(False))))),
        )
        state = open_.join(folds, "id").select("id", two("acc", "v").alias("acc"), "own", (F.col("bad") | F.col("b")).alias("bad"), "n", "p", "w", "wo", "eb")
        state = materialise(state, "lattice")
        ended = (F.col("n") == 0) | (F.col("bad") if unresolved is not None else F.lit(False)) | (F.coalesce(F.col("acc") == F.lit(extreme), F.lit(False)) if extreme is not None else F.lit(False))
        done = state.where(ended).select("id", final.alias("value"), "bad")
        rest = state.where(~ended)
        sb = F.col("bad") | F.col("eb")
        o = two("acc", "own", "wo")
        run = rest.where("n = 1").select("id", F.col("p").alias("next"), o.alias("o"), F.when(F.col("bad"), two(o, "w")).otherwise(two("acc", "w")).alias("m"), sb.alias("sb"))
        # of a node behind an unresolved part of its way, the own value counts, too
        run = run.join(rest.select("id", "own", "eb"), "id").select("id", "next", "o", F.when(F.col("eb"), two("m", "own")).otherwise(F.col("m")).alias("m"), "sb")
        heads_, stuck = _runs(run, two)
        heads_ = materialise(heads_, "lattice")
        done = done.unionByName(stuck.select("id", (F.col("o") if unresolved is None else F.lit(unresolved)).cast("int").alias("value"), F.lit(True).alias("bad")))
        layer = resolved.add(done)
        deferred.append(heads_)
        core = rest.where("n > 1").select("id", "acc", "own", "bad")
        hop = heads_.select(F.col("id").alias("parent"), "head", F.col("o").alias("_o"), F.col("m").alias("_m"), F.col("sb").alias("_sb"))
        # edges from resolved parents are folded for good, those from a run go to its head
        kept = met.where("pb is null").join(core.select(F.col("id").alias("child")), "child", "left_semi").join(hop, "parent", "left")
        w = F.when(F.col("head").isNull(), F.col("w")).otherwise(two(F.when(F.col("_sb"), F.col("wo")).otherwise(F.col("w")), F.col("_m")))
        kept = kept.select("child", F.coalesce("head", "parent").alias("parent"), w.alias("w"), two("wo", "_o").alias("wo"), (F.col("eb") | F.coalesce("_sb", F.lit(False))).alias("eb"))
        before, left = (left, met), materialise(kept.groupBy("child", "parent").agg(combine("w").alias("w"), combine("wo").alias("wo"), F.max("eb").alias("eb")), "lattice")
        open_ = materialise(core, "lattice")
        for old in before:
            discard(old)
        if open_.isEmpty():
            break
        if layer.isEmpty() and heads_.isEmpty():  # all that is left stands on a cycle or below one
            resolved.add(_core(open_, left, combine, unresolved))
            break
    for heads_ in reversed(deferred):
        if heads_.isEmpty():
            continue
        known = resolved.all().select(F.col("id").alias("head"), F.col("value").alias("hv"), F.col("bad").alias("hb"))
        bad = F.col("sb") | F.col("hb")
        value = two(F.when(F.col("hb"), F.col("o")).otherwise(F.col("m")), F.col("hv"))
        value = value if unresolved is None else F.when(bad, F.lit(unresolved)).otherwise(value)
        resolved.add(heads_.join(known, "head").select("id", value.cast("int").alias("value"), bad.alias("bad")))
    return resolved.all().select("id", "value")


def _core(open_: DataFrame, left: DataFrame, combine, unresolved: int | None) -> DataFrame:
    """Nodes of which each waits for another: ``unresolved``, or the fixpoint from what they hold."""
    if unresolved is not None:
        return open_.select("id", F.lit(unresolved).cast("int").alias("value"), F.lit(True).alias("bad"))
    two = combine_two(combine)
    now = materialise(open_.select("id", two("acc", "own").alias("value")), "lattice")
    while True:
        came = left.join(now, left["parent"] == now["id"]).groupBy("child").agg(combine(two("wo", "value")).alias("_v"))
        new = now.join(came, now["id"] == came["child"], "left").select("id", two("value", "_v").alias("value"), (two("value", "_v") != F.col("value")).alias("moved"))
        before, now = now, materialise(new, "lattice")
        discard(before)
        if now.where("moved").isEmpty():
            return now.select("id", "value", F.lit(True).alias("bad"))
        now = now.select("id", "value")


def combine_two(combine):
    return F.least if combine is F.min else F.greatest


def neighborhood(nodes: DataFrame, rel: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, id, hop, path_min): widest paths of at most hops edges over rel(a, b) read both ways. nodes(id, label, conducts):
    only conducting nodes are entered. Level by level: path_min of a hop uses the hop before only."""
    both = rel.select(F.col("a").alias("u"), F.col("b").alias("v")).union(rel.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct()
    step = both.join(nodes.where("conducts").select(F.col("id").alias("v"), F.col("label").alias("lv")), "v")
    best = seeds.join(nodes, "id").select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop"), F.col("label").alias("path_min"))
    for hop in range(1, hops + 1):
        new = best.join(step, best["id"] == step["u"]).select("seed", F.col("v").alias("id"), F.lit(hop).alias("hop"), F.least("path_min", "lv").alias("path_min"))
        before, best = best, materialise(best.unionByName(new).groupBy("seed", "id").agg(F.min("hop").alias("hop"), F.max("path_min").alias("path_min")), "hops")
        discard(before)
    return best.where("seed <> id")


def explain_tree(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, position, depth, id, elided): the ancestry of each seed of a stated set as a depth-first walk prints it, parents in order
    of their ids; a node that was shown before is shown again, elided, without what is above it. Works on cycles; a seed is its own
    first row.

    A walk in order reaches each node by the least of its simple paths, compared from the front, so the walk is a relaxation of
    least paths: rounds grow with the deepest of them."""
    step = materialise(edges.select("child", "parent").where("parent is not null").distinct(), "explain")
    best = materialise(seeds.select(F.col("id").alias("seed"), "id").where("id is not null").distinct().select("seed", "id", F.array("id").alias("path"), F.lit(True).alias("new")), "explain")
    while not best.where("new").isEmpty():
        grown = best.where("new").join(step, F.col("id") == F.col("child")).select("seed", F.col("parent").alias("id"), F.concat("path", F.array("parent")).alias("path"))
        both = best.select("seed", "id", "path", F.lit(0).alias("k")).unionByName(grown.select("seed", "id", "path", F.lit(1).alias("k"))).groupBy("seed", "id").agg(F.min("path").alias("path"), F.min_by("path", "k").alias("was"), F.min("k").alias("k"))
        before, best = best, materialise(both.select("seed", "id", "path", ((F.col("k") == 1) | (F.col("path") != F.col("was"))).alias("new")), "explain")
        discard(before)
    shown = best.join(step, F.col("id") == F.col("child")).select("seed", F.col("parent").alias("id"), F.concat("path", F.array("parent")).alias("at"))
    rows = best.where("seed = id").select("seed", "id", F.col("path").alias("at")).unionByName(shown)
    rows = rows.join(best.select("seed", "id", "path"), ["seed", "id"])
    w = Window.partitionBy("seed").orderBy("at")
    return rows.select("seed", F.row_number().over(w).alias("position"), (F.size("at") - 1).alias("depth"), "id", (F.col("at") != F.col("path")).alias("elided"))


def heads(links: DataFrame) -> DataFrame:
    """(id, head) for pointer chains links(id, next), one link for each id: the last node that a walk from the id sees for the
    first time. Pointer jumping, so rounds grow with the logarithm of a chain. On a cycle, and on a chain that runs into one, that
    is the node before the one where the walk comes back: a cycle's member ends at its predecessor, a chain at the predecessor
    of the member it enters at."""
    links = materialise(links.select("id", "next"), "heads")
    now = links.select("id", F.col("next").alias("head"))
    for _ in range(links.count().bit_length() + 1):
        after = now.select(F.col("id").alias("head"), F.col("head").alias("_h"))
        now = materialise(now.join(after, "head", "left").select("id", F.coalesce("_h", "head").alias("head"), F.col("_h").isNotNull().alias("moved")), "heads")
        if now.where("moved").isEmpty():
            return now.select("id", "head")
        now, last = now.select("id", "head"), now
    # after more jumps than there are nodes, those that still move stand on a cycle, and cover all of it
    stuck = last.where("moved")
    members = materialise(stuck.select(F.col("head").alias("id")).distinct(), "heads")
    before = links.join(members, "id", "left_semi").select(F.col("next").alias("enters"), F.col("id").alias("head"))
    tails = heads(links.join(stuck.select("id"), "id", "left_semi").join(members, "id", "left_anti")).select("id", F.col("head").alias("enters"))
    on_cycle = before.join(tails.unionByName(members.select("id", F.col("id").alias("enters"))), "enters").select("id", "head")
    return last.where("not moved").select("id", "head").unionByName(on_cycle)
