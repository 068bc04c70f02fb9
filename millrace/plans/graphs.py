"""Questions about graphs that are tables: ``nodes(node_id, ...)`` and ``edges(src, dst)``.

Iterations expand a frontier and cut lineage after each step; what is already known is taken out by anti
joins, so diamonds are walked once, not once for each path. Nothing but a step's row count reaches the
driver.
"""

from __future__ import annotations

import functools
import weakref

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.lineage import cut, cut_counted, dealt, rows


#: Steps whose results are read side by side before they are written as one.
UNIONS = 8
#: Tables that were counted are broadcast up to so many rows.
SMALL = 50_000
#: Seeds whose sets travel in one number.
BITS = 64
#: Ancestors that travel in one row.
PACK = 1000
#: Bits of a hash that name a word in a table of marks, or a slot in a table of levels: so large a broadcast gets, and no larger.
WORDS, SLOTS = 20, 16

_tables: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def edge_table(edges: DataFrame) -> DataFrame:
    """``src, dst``: the edges, each once, written and counted; what it gave before is left as it is."""
    if edges in _tables:
        return edges
    pairs = edges.select("src", "dst")
    out, _ = cut_counted(dealt(pairs, rows(edges), "src", "dst").distinct())
    _tables.add(out)
    return out


def _near(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def _inner(e: DataFrame) -> tuple[DataFrame, int]:
    """``node_id``: nodes with children, and their number."""
    return cut_counted(dealt(e.select(F.col("src").alias("node_id")).where("src is not null"), rows(e), "node_id").distinct())


def _marks(ids: DataFrame) -> DataFrame:
    """``word, bits``: each of ``ids(node_id)`` as two bits of a 64-bit word, words and bits by its hash; at most ``2 ** WORDS`` rows."""
    h = F.xxhash64("node_id")
    return ids.select(F.shiftright(h, 64 - WORDS).alias("word"), _two_bits(h).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _two_bits(h: Column) -> Column:
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    return bit(h).bitwiseOR(bit(F.shiftright(h, 6)))


def _marked(df: DataFrame, col: str, marks: DataFrame) -> DataFrame:
    """Rows whose ``col`` may be one of the ids that are marked: all that are, and where ids are fewer than some millions few others."""
    h = F.xxhash64(col)
    found = df.join(F.broadcast(marks), F.shiftright(h, 64 - WORDS) == F.col("word"))
    return found.where(F.col("bits").bitwiseAND(_two_bits(h)) == _two_bits(h)).select(*df.columns)


def _core(e: DataFrame, inner: DataFrame, n: int, marks: DataFrame | None) -> DataFrame:
    """Edges whose lower end has children too: what a walk needs but for its last step, and mostly a small part."""
    some = e if marks is None else dealt(*cut_counted(_marked(e, "dst", marks)), "dst")
    # an inner join, since Spark moves a semi join down to where all edges are dealt out
    core, _ = cut_counted(some.join(_near(inner.withColumnRenamed("node_id", "dst"), n), "dst").select("src", "dst"))
    _tables.add(core)
    return core


def _onwards(frontier: DataFrame, n: int, step: DataFrame, total: int, depth: int, starts: list[DataFrame]) -> tuple[DataFrame, int]:
    """A frontier's rows from which a step leads on, if there are many, so that the last step isn't taken for nothing."""
    if n <= SMALL or depth == 1:
        return frontier, n
    if not starts:
        starts.append(cut(dealt(step.select(F.col("__from").alias("node_id")), total, "node_id").distinct()))
    return cut_counted(frontier.join(starts[0], "node_id", "left_semi").select(*frontier.columns))


def _taken(frontier: DataFrame, n: int, step: DataFrame, total: int) -> DataFrame:
    way = step if n <= SMALL else dealt(step, total, "__from")
    return way.join(_near(frontier, n), F.col("node_id") == F.col("__from")).drop("node_id", "__from").withColumnRenamed("__to", "node_id")


def _step(edges: DataFrame, reverse: bool) -> tuple[DataFrame, int]:
    e = edge_table(edges)
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return e.select(F.col(a).alias("__from"), F.col(b).alias("__to")), rows(e)


def reach(edges: DataFrame, seeds: DataFrame, by: tuple[str, ...] = (), reverse: bool = False) -> DataFrame:
    """``by..., node_id, depth``: nodes reached from ``seeds(by..., node_id)`` and the least number of steps; seeds have 0.

    A step is one job: its rows are counted while they are written.
    """
    if by:
        sets, names, width = _reach_sets(edges, seeds, by, reverse)
        bit = F.explode(F.filter(F.lit(list(range(width))), lambda i: F.getbit("bits", i) == 1))
        found = sets.select("block", "node_id", "depth", bit.alias("bit"))
        return found.join(names, ["block", "bit"]).select(*by, "node_id", "depth")
    step, total = _step(edges, reverse)
    known, n = cut_counted(seeds.select("node_id").distinct().withColumn("depth", F.lit(0)))
    frontier, depth, starts = known, 0, []
    while True:
        depth += 1
        frontier, n = _onwards(frontier, n, step, total, depth, starts)
        if not n:
            return known
        new = dealt(_taken(frontier, n, step, total).select("node_id"), total, "node_id").distinct()
        new, n = cut_counted(new.join(known.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(depth)))
        if not n:
            return known
        known, frontier = known.union(new), new
        if depth % UNIONS == 0:
            known = cut(known)


def _reach_sets(edges: DataFrame, seeds: DataFrame, by: tuple[str, ...], reverse: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """``block, node_id, bits, depth``: in each step the sets of ``by`` that reach a node for the first time; ``block, bit, by...``; bits in use.

    A row has up to 64 of them, so that nodes which many seeds reach are not written once for each.
    """
    each = seeds.select(*by).distinct()
    k = each.count()
    number = F.monotonically_increasing_id()
    names = cut(dealt(each, k, *by).select(*by, number.alias("n")))
    names = names.select(F.floor(F.col("n") / BITS).alias("block"), (F.col("n") % BITS).cast("int").alias("bit"), *by)
    named = names.select("block", "bit", *[F.col(c).alias(f"__{c}") for c in by])
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    one = F.expr("shiftleft(1L, bit)")
    known, n = cut_counted(seeds.join(_near(named, k), same).groupBy("block", "node_id").agg(F.bit_or(one).alias("bits")).withColumn("depth", F.lit(0)))
    step, total = _step(edges, reverse)
    frontier, depth, starts = known, 0, []
    zero = F.lit(0).cast("long")
    while True:
        depth += 1
        frontier, n = _onwards(frontier, n, step, total, depth, starts)
        if not n:
            break
        ways = _taken(frontier.drop("depth"), n, step, total).select("block", "node_id", "bits", zero.alias("old"))
        both = dealt(ways.union(known.select("block", "node_id", zero, "bits")), max(total, n), "node_id").groupBy("block", "node_id")
        fresh = F.col("bits").bitwiseAND(F.bitwise_not("old"))
        new = both.agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old")).select("block", "node_id", fresh.alias("bits")).where("bits <> 0")
        new, n = cut_counted(new.withColumn("depth", F.lit(depth)))
        if not n:
            break
        known, frontier = known.union(new), new
        if depth % UNIONS == 0:
            known = cut(known)
    return known, names, min(k, BITS)


def reach_counts(edges: DataFrame, seeds: DataFrame, by: tuple[str, ...], reverse: bool = False) -> DataFrame:
    """``by..., depth, n``: how many nodes are reached in so many steps and not in fewer, seeds left out."""
    sets, names, width = _reach_sets(edges, seeds, by, reverse)
    counts = [F.count_if(F.getbit("bits", F.lit(i)) == 1).alias(f"b{i}") for i in range(width)]
    each = F.posexplode(F.array(*[f"b{i}" for i in range(width)])).alias("bit", "n")
    return sets.where("depth > 0").groupBy("block", "depth").agg(*counts).select("block", "depth", each).where("n > 0").join(names, ["block", "bit"]).select(*by, "depth", "n")


def downstream(edges: DataFrame, seeds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return reach(edges, seeds, by).where("depth > 0")


def upstream(edges: DataFrame, seeds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return reach(edges, seeds, by, reverse=True).where("depth > 0")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, level``: the longest distance from a node without parents. Raises on a cycle.

    One job a level among the nodes with children; those without follow all at once, when the result is read. Edges are read as they are,
    three times, and may repeat: they are neither made distinct nor written.
    """
    return _levels(nodes, edges)[0]


def _levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node_id, level`` of all nodes, not yet computed, and of those with children, written."""
    e = edges.select("src", "dst")
    seen = Observation()
    # most edges share their upper ends with others, so they are put together before they are dealt out
    ids = e.select(F.col("src").alias("node_id")).observe(seen, F.count(F.lit(1)).alias("n"), F.count("node_id").alias("whole"))
    inner, n = cut_counted(ids.where("node_id is not null").distinct())
    total = seen.get["n"]
    if seen.get["whole"] < total:
        raise ValueError("the graph has a cycle, or an edge without its upper end")
    marks = None if n <= SMALL else cut(_marks(inner))
    core = _core(e, inner, n, marks)
    own = nodes.select("node_id")
    upper, finished = _peeled((own if marks is None else _marked(own, "node_id", marks)).distinct().join(_near(inner, n), "node_id"), core)
    if finished < n:
        raise ValueError("the graph has a cycle")
    below = _upper_ends(e, total, upper, n).select(F.col("dst").alias("node_id"), (F.col("level") + 1).alias("level"))
    return dealt(below.union(nodes.select("node_id", F.lit(0))), total, "node_id").groupBy("node_id").agg(F.max("level").alias("level")), upper


def _upper_ends(e: DataFrame, total: int, upper: DataFrame, n: int) -> DataFrame:
    """``src, dst, level``: edges with the level of their upper ends, all of which are in ``upper``.

    A slot of the hash whose nodes are all on one level gives that level; only nodes of the other slots are looked up themselves.
    """
    at = upper.withColumnRenamed("node_id", "src")
    if n <= SMALL:
        return e.join(F.broadcast(at), "src")
    slot = F.shiftright(F.xxhash64("src"), 64 - SLOTS)
    slots = cut(at.groupBy(slot.alias("slot")).agg(F.min("level").alias("least"), F.max("level").alias("most")))
    mixed = slots.where("least < most").select("slot")
    single, k = cut_counted(at.withColumn("slot", slot).join(F.broadcast(mixed), "slot", "left_semi").select("src", F.col("level").alias("single")))
    if k > SMALL:
        return dealt(e, total, "src").join(at, "src")
    plain = F.broadcast(slots.where("least = most").select("slot", F.col("least").alias("level")))
    found = e.withColumn("slot", slot).join(plain, "slot", "left").join(F.broadcast(single), "src", "left")
    return found.select("src", "dst", F.coalesce("level", "single").alias("level"))


def _peeled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """``node_id, level`` of what can be reached level by level, and how many they are. One job a level."""
    total = rows(edges)
    ready, n = cut_counted(nodes.select("node_id").join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti").withColumn("level", F.lit(0)))
    done, level, finished = ready, 0, n
    waiting = dealt(edges.select("dst"), total, "dst").groupBy("dst").agg(F.count("*").alias("open"))
    while n:
        level += 1
        freed = edges.join(_near(ready, n), F.col("node_id") == F.col("src")).groupBy("dst").agg(F.count("*").alias("freed"))
        after = waiting.join(freed, "dst", "left").select("dst", (F.col("open") - F.coalesce("freed", F.lit(0))).alias("open"))
        after, n = cut_counted(after, F.col("open") == 0)
        ready, waiting = after.where("open = 0").select(F.col("dst").alias("node_id"), F.lit(level).alias("level")), after.where("open > 0")
        finished += n
        if n:
            done = done.union(ready)
            if level % UNIONS == 0:
                done = cut(done)
    return done, finished


def longest_depths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node_id, depth``: of what hangs on ``seeds(node_id)``, the longest way from a seed. Raises on a cycle among them."""
    edges = edge_table(edges)
    hit = cut(reach(edges, seeds).select("node_id"))
    # what hangs on a hit node is hit, so the upper end decides
    inner, _ = cut_counted(edges.join(hit.withColumnRenamed("node_id", "src"), "src", "left_semi").select("src", "dst"))
    _tables.add(inner)
    # a seed that hangs on another one is no start; what is on the way from it is further down by itself
    return levels(hit, inner).where("level > 0").withColumnRenamed("level", "depth")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, component``: weakly connected components, named by their least node.

    Least labels spread along edges and jump along labels, so rounds grow with the logarithm of the diameter.
    """
    pairs = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a <> b").distinct())
    labels = cut(nodes.select("node_id", F.col("node_id").alias("component")))
    while True:
        near = pairs.join(labels, F.col("b") == F.col("node_id")).groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node_id")
        low = labels.join(near, "node_id", "left").select("node_id", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        far = labels.select(F.col("node_id").alias("via"), F.col("component").alias("far"))
        new, moved = cut_counted(low.join(far, "via").select("node_id", "old", F.least("via", "far").alias("component")), F.col("old") != F.col("component"))
        labels = new.select("node_id", "component")
        if not moved:
            return labels


# --- degrees and shape -------------------------------------------------------------------------------------


def _with_degrees(nodes: DataFrame, edges: DataFrame, *which: str) -> DataFrame:
    e = edge_table(edges)
    out = dealt(nodes, rows(e), "node_id")
    for name in which:
        at = e.select(F.col("dst" if name == "fan_in" else "src").alias("node_id"))
        out = out.join(dealt(at, rows(e), "node_id").groupBy("node_id").agg(F.count("*").alias(name)), "node_id", "left")
    return out.na.fill(0, list(which))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``fan_in`` and ``fan_out``."""
    return _with_degrees(nodes, edges, "fan_in", "fan_out")


def degree_distribution(nodes: DataFrame, edges: DataFrame, which: str = "fan_in") -> DataFrame:
    return _with_degrees(nodes, edges, which).groupBy(F.col(which).alias("degree")).agg(F.count("*").alias("n"))


def complexity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of measures: counts, degrees, density, depth, width, and the entropy of fan-out shares."""
    edges = edge_table(edges)
    deep = levels(nodes, edges).groupBy("level").agg(F.count("*").alias("n")).agg((F.max("level") + 1).alias("depth"), F.max("n").alias("width")).first()
    out = F.col("fan_out")
    sums = degrees(nodes, edges).agg(
        F.count("*").alias("n_nodes"), F.sum(out).alias("n_edges"), F.max("fan_in").alias("max_fan_in"), F.max(out).alias("max_fan_out"), F.avg("fan_in").alias("avg_fan_in"),
        F.sum(F.when(out > 0, out * F.log2(out))).alias("__logs"),
    )
    n, m = F.col("n_nodes"), F.col("n_edges")
    density = F.when(n > 1, m / (n * (n - 1) / 2)).otherwise(0.0)
    # the sum of -s log s over shares s = f / m, taken apart, so that one pass does
    entropy = F.when(m > 0, F.log2(m) - F.col("__logs") / m).otherwise(0.0)
    fixed = {"depth": F.lit(deep["depth"]), "width": F.lit(deep["width"]), "entropy": entropy, "density": density}
    return sums.withColumns(fixed).drop("__logs")


def critical_nodes(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, share: float = 0.5) -> DataFrame:
    """Those of ``candidates(node_id)`` whose ancestors and descendants are at least ``share`` of all nodes."""
    total = nodes.count()
    edges = edge_table(edges)
    seeds = candidates.select(F.col("node_id").alias("of"), "node_id")
    both = reach_counts(edges, seeds, ("of",)).union(reach_counts(edges, seeds, ("of",), reverse=True))
    return both.groupBy(F.col("of").alias("node_id")).agg(F.sum("n").alias("related")).where((F.col("related") >= share * total) & F.lit(total > 2))


def fan_out_bottlenecks(nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    d = degrees(nodes, edges).where(F.col("fan_out") >= least)
    return d.select("node_id", "fan_out", F.least(F.lit(1.0), F.col("fan_out") / 10).alias("severity"))


def fan_in_aggregations(nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    d = degrees(nodes, edges).where(F.col("fan_in") >= least)
    return d.select("node_id", "fan_in", F.least(F.lit(1.0), F.col("fan_in") / 10).alias("severity"))


def diamonds(edges: DataFrame) -> DataFrame:
    """``node_id, n_shared``: nodes two of whose parents have an ancestor (or themselves) in common, and how many such.

    Only parents of nodes with two or more of them are followed upwards. A parent's ancestors travel along its edges in packs.
    """
    e = edge_table(edges)
    parents_of = F.count("*").over(Window.partitionBy("dst"))
    below, m = cut_counted(dealt(e, rows(e), "dst").where("src is not null and dst is not null").withColumn("n", parents_of).where("n > 1").select("src", "dst"))
    inner, k = _inner(e)
    core = _core(e, inner, k, None if k <= SMALL else cut(_marks(inner)))
    parents = cut(dealt(below.select(F.col("src").alias("node_id")), m, "node_id").distinct())
    up = reach(core, parents.select(F.col("node_id").alias("of"), "node_id"), ("of",), reverse=True)
    # a parent itself is shared only if it is above another one
    above = core.select(F.col("src").alias("of")).distinct()
    lines = up.where("depth > 0").select("of", "node_id").union(parents.select(F.col("node_id").alias("of"), "node_id").join(above, "of", "left_semi"))
    lines, n = cut_counted(lines)
    pack = F.pmod(F.hash("node_id"), F.ceil(F.count("*").over(Window.partitionBy("of")) / PACK))
    packs = dealt(lines, max(n, m), "of").withColumn("pack", pack).groupBy("of", "pack").agg(F.collect_list("node_id").alias("ancestors"))
    sent = dealt(below, max(n, m), "src").join(packs, F.col("src") == F.col("of")).select("dst", "ancestors")
    ways = dealt(sent, max(n, m), "dst").select("dst", F.explode("ancestors").alias("ancestor")).groupBy("dst", "ancestor").agg(F.count("*").alias("ways"))
    return ways.where("ways > 1").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n_shared"))


def chains(nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """``head, n``: maximal runs of nodes each with one child that has one parent; at least ``least`` long."""
    edges = edge_table(edges)
    d = degrees(nodes, edges).select("node_id", "fan_in", "fan_out")
    one_out = d.where("fan_out = 1").select(F.col("node_id").alias("src"))
    one_in = d.where("fan_in = 1").select(F.col("node_id").alias("dst"))
    link = cut(edges.join(one_out, "src").join(one_in, "dst").select("src", "dst"))
    members = link.select(F.col("src").alias("node_id")).union(link.select("dst")).distinct()
    groups = components(members, link)
    heads = members.join(link.select(F.col("dst").alias("node_id")), "node_id", "left_anti").join(groups, "node_id").select(F.col("node_id").alias("head"), "component")
    return groups.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(heads, "component").select("head", "n")


def patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All patterns as ``kind, node_id, severity``."""
    parts = [
        diamonds(edges).select(F.lit("DIAMOND").alias("kind"), "node_id", F.least(F.lit(1.0), (F.col("n_shared") + 1) / 10).alias("severity")),
        chains(nodes, edges, 3).select(F.lit("CHAIN").alias("kind"), F.col("head").alias("node_id"), F.least(F.lit(1.0), F.col("n") / 20).alias("severity")),
        fan_out_bottlenecks(nodes, edges).select(F.lit("FAN_OUT").alias("kind"), "node_id", "severity"),
        fan_in_aggregations(nodes, edges).select(F.lit("FAN_IN").alias("kind"), "node_id", "severity"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def pattern_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, n``: how many patterns of each kind there are."""
    return patterns(nodes, edges).groupBy("kind").agg(F.count("*").alias("n"))


def shape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: depth, width, nodes a level, and whether the graph is a line or wider than deep."""
    sizes = levels(nodes, edges).groupBy("level").agg(F.count("*").alias("n"))
    row = sizes.agg(F.count("*").alias("depth"), F.max("n").alias("width"), F.sum("n").alias("nodes"))
    return row.select("depth", "width", (F.col("nodes") / F.col("depth")).alias("parallelism"), (F.col("width") <= 1).alias("is_linear"), (F.col("width") > F.col("depth")).alias("is_wide"))


# --- impact ------------------------------------------------------------------------------------------------


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by..., affected, blast_radius, depth, is_localized, is_widespread``: how much of the derived nodes hangs on the seeds, and how deep.

    ``depth`` counts the fewest steps; ``longest_depths`` has the most.
    """
    n = nodes.where("kind = 'derived'").count()
    hit = reach_counts(edges, seeds, by) if by else downstream(edges, seeds).withColumn("n", F.lit(1).cast("long"))
    total = F.coalesce(F.sum("n"), F.lit(0).cast("long"))
    found = hit.groupBy(*by).agg(total.alias("affected"), (total / F.lit(max(n, 1))).alias("blast_radius"), F.max("depth").alias("depth"))
    return found.withColumns({"is_localized": F.col("blast_radius") < 0.2, "is_widespread": F.col("blast_radius") > 0.5})


def compare_impacts(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``node_id, side``: affected by ``a`` only, by ``b`` only, or by both."""
    x = downstream(edges, a).select("node_id", F.lit(True).alias("x"))
    y = downstream(edges, b).select("node_id", F.lit(True).alias("y"))
    side = F.when(F.col("x").isNull(), "only_b").when(F.col("y").isNull(), "only_a").otherwise("both")
    return x.join(y, "node_id", "full").select("node_id", side.alias("side"))


def shared_sources(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources that every one of ``targets(node_id)`` depends on."""
    n = targets.select("node_id").distinct().count()
    up = upstream(edges, targets.select(F.col("node_id").alias("of"), "node_id"), ("of",))
    sources = nodes.where("kind = 'source'").select("node_id")
    return up.join(sources, "node_id").groupBy("node_id").agg(F.count("*").alias("n")).where(F.col("n") == n).select("node_id")


def isolated_effects(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Affected nodes without affected children."""
    hit = cut(downstream(edges, seeds).select("node_id"))
    inner = edges.join(hit.withColumnRenamed("node_id", "dst"), "dst").select(F.col("src").alias("node_id"))
    return hit.join(inner, "node_id", "left_anti")


# --- pruning and integrity ---------------------------------------------------------------------------------


def dead_nodes(nodes: DataFrame, edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """Nodes that no output needs."""
    return nodes.select("node_id").join(reach(edges, outputs, reverse=True), "node_id", "left_anti")


def orphan_sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.where("kind = 'source'").select("node_id").join(edges.select(F.col("src").alias("node_id")), "node_id", "left_anti")


def bottleneck_levels(nodes: DataFrame, edges: DataFrame, most: int = 1) -> DataFrame:
    """Nodes on levels with at most so many nodes. Levels are counted first; nodes without children are taken only if some are on such levels."""
    found, upper = _levels(nodes, edges)
    sizes = found.groupBy("level").agg(F.count("*").alias("n"))
    inner = upper.groupBy("level").agg(F.count("*").alias("inner"))
    narrow, k = cut_counted(sizes.where(F.col("n") <= most).join(inner, "level", "left").select("level", (F.col("n") == F.coalesce("inner", F.lit(0))).alias("all_inner")))
    rest = narrow.where("not all_inner").count()
    return (found if rest else upper).join(_near(narrow, k), "level", "left_semi").select("node_id", "level")


def cost_rank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, cost``: the estimated cost of a node by its degrees; see ``optimize.Cost`` for the weights."""
    from millrace.plans.optimize import Cost

    d = degrees(nodes, edges)
    return d.select("node_id", Cost.column(F.col("fan_in"), F.col("fan_out")).alias("cost"))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All issues as ``severity, issue, node_id``: orphans, unreachable nodes, dangling edges, stale states."""
    ids = nodes.select("node_id")
    orphan = orphan_sources(nodes, edges).select(F.lit("WARNING").alias("severity"), F.lit("ORPHAN_SOURCE").alias("issue"), "node_id")
    fed = reach(edges, nodes.where("kind = 'source'").select("node_id")).select("node_id")
    cut_off = nodes.where("kind = 'derived'").select("node_id").join(fed, "node_id", "left_anti")
    unreached = cut_off.select(F.lit("ERROR").alias("severity"), F.lit("UNREACHABLE").alias("issue"), "node_id")
    ends = edges.select(F.col("dst").alias("at"), F.col("src").alias("node_id")).union(edges.select("src", "dst"))
    dangling = ends.join(ids, "node_id", "left_anti").select(F.lit("ERROR").alias("severity"), F.lit("MISSING_NODE").alias("issue"), F.col("at").alias("node_id")).distinct()
    out = orphan.union(unreached).union(dangling)
    if "state" in nodes.columns:
        stale = stale_children(nodes, edges).select(F.lit("WARNING").alias("severity"), F.lit("CLEAN_ON_DIRTY").alias("issue"), "node_id")
        out = out.union(stale)
    return out


def marked_dirty(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``nodes`` with ``state``: DIRTY for the derived nodes that hang on ``changed(node_id)``, else CLEAN."""
    hit = downstream(edges, changed).select("node_id", F.lit(True).alias("__hit"))
    state = F.when(F.col("__hit") & (F.col("kind") == "derived"), "DIRTY").otherwise("CLEAN")
    return nodes.join(hit, "node_id", "left").withColumn("state", state).drop("__hit")


def issue_summary(issues: DataFrame) -> DataFrame:
    """``rank, severity, issue, n``, errors first."""
    rank = F.when(F.col("severity") == "ERROR", 0).otherwise(1)
    return issues.groupBy(rank.alias("rank"), "severity", "issue").agg(F.count("*").alias("n")).orderBy("rank", "issue")


def is_healthy(issues: DataFrame) -> bool:
    """Whether there is no error; warnings do no harm."""
    return not issues.where("severity = 'ERROR'").limit(1).count()


def stale_children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes marked CLEAN one of whose parents is DIRTY."""
    s = nodes.select("node_id", "state")
    dirty = s.where("state = 'DIRTY'").select(F.col("node_id").alias("src"))
    clean = s.where("state = 'CLEAN'").select(F.col("node_id").alias("dst"))
    return edges.join(dirty, "src").join(clean, "dst").select(F.col("dst").alias("node_id")).distinct()
