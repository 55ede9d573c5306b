"""Graphs over edge tables: neighbours, bounded paths, components, levels, cycles, dominators, critical paths.

Iterative operators write each round to the checkpoint folder, so that plans stay small and lost
executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut

#: A round of folding that leaves more than this share of the edges is followed by other means.
SHRUNK = 0.75


def _dealt(df: DataFrame) -> DataFrame:
    """One side of a join that grows with the graph: dealt by the key, never sent through the driver, however small its files are."""
    return df.hint("merge")


def neighbours(edges: DataFrame, node: object) -> DataFrame:
    """Both directions, one row for each edge: (neighbour, direction)."""
    out = edges.where(F.col("src") == F.lit(node)).select(F.col("dst").alias("neighbour"), F.lit("out").alias("direction"))
    return out.unionAll(edges.where(F.col("dst") == F.lit(node)).select(F.col("src").alias("neighbour"), F.lit("in").alias("direction")))


def bounded_paths(edges: DataFrame, start: object, depth: int, reverse: bool = False, types: Sequence[str] = ()) -> DataFrame:
    """Distinct (node, distance) over paths of 1..depth edges that use no edge twice; a node can have several distances.

    Edges: src, dst, edge_id (and type, if ``types`` are named).
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    usable = edges.where(F.col("type").isin(list(types))) if types else edges
    step = usable.select(F.col(a).alias("from_node"), F.col(b).alias("to_node"), "edge_id")
    front = step.where(F.col("from_node") == F.lit(start)).select(F.col("to_node").alias("node"), F.array("edge_id").alias("used"))
    found = front.select("node", F.lit(1).alias("distance"))
    for d in range(2, depth + 1):
        front = front.join(step, F.col("node") == F.col("from_node")).where(~F.array_contains("used", F.col("edge_id"))).select(F.col("to_node").alias("node"), F.array_append("used", F.col("edge_id")).alias("used"))
        found = found.unionAll(front.select("node", F.lit(d).alias("distance")))
    return found.distinct()


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return out.groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


def density(nodes: int, edges: int) -> float:
    return edges / (nodes * (nodes - 1)) if nodes > 1 else 0.0


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable in either direction; labels jump, so rounds are few."""
    both = cut(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("component")))
    for _ in range(rounds):
        near = both.join(labels, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("component").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("dst"), "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("was"))
        lower = cut(lower)
        heads = lower.select(F.col("node").alias("h"), F.col("component").alias("top"))
        jumped = cut(lower.join(heads, F.col("component") == F.col("h"), "left").select("node", F.least("component", F.coalesce("top", "component")).alias("component"), "was"))
        labels = jumped.select("node", "component")
        if jumped.where("component <> was").isEmpty():
            return labels
    raise RuntimeError("components have not settled")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 without predecessors, else one more than the highest predecessor; NULL on or behind a cycle.

    Edges to unknown nodes don't count.  A round settles the nodes without open predecessors, then folds every
    node with a single open predecessor into the top of its chain (or tree) by pointer doubling: its level is
    the larger of a floor and the top's level plus an offset, and such maps compose.  So chains and trees cost
    the logarithm of their depth; only nodes where several open ways meet are met round by round.
    """
    known = nodes.select("node").distinct()
    left = edges.select("src", "dst").distinct().join(known.select(F.col("node").alias("src")), "src").join(known.select(F.col("node").alias("dst")), "dst")
    left = cut(left.withColumn("weight", F.lit(1)))
    # open nodes with the level that settled predecessors ask for at least
    open_nodes = cut(known.withColumn("floor", F.lit(0)))
    settled, folded = [], []
    while True:
        entered = left.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ways"), F.min("src").alias("before"), F.min("weight").alias("weight"))
        state = cut(open_nodes.join(entered, "node", "left"))
        free = state.where("ways is null").select("node", F.col("floor").alias("level"))
        single = state.where("ways = 1 and before <> node")
        # the map of a single node: (top, floor, offset); tops are the first ancestors that are not single
        chain = _chained(single.select("node", F.col("before").alias("top"), "floor", F.col("weight").alias("offset")))
        if free.isEmpty() and chain.isEmpty():
            break
        settled.append(free)
        folded.append(chain)
        open_nodes = state.join(free, "node", "left_anti").join(chain, "node", "left_anti").select("node", "floor")
        # folded sources hand their edges to their tops, and settled sources raise floors
        handed = left.join(chain.select(F.col("node").alias("dst")), "dst", "left_anti").join(chain.select(F.col("node").alias("src"), "top", F.col("floor").alias("least"), "offset"), "src", "left")
        handed = handed.select(F.coalesce("top", "src").alias("src"), "dst", (F.col("weight") + F.coalesce("offset", F.lit(0))).alias("weight"), (F.col("least") + F.col("weight")).alias("ask"))
        handed = cut(handed.join(free.select(F.col("node").alias("src"), "level"), "src", "left"))
        asks = handed.select(F.col("dst").alias("node"), F.greatest(F.col("level") + F.col("weight"), "ask").alias("ask")).where("ask is not null").groupBy("node").agg(F.max("ask").alias("ask"))
        open_nodes = cut(open_nodes.join(asks, "node", "left").select("node", F.greatest("floor", F.coalesce("ask", F.lit(0))).alias("floor")))
        left = cut(handed.where("level is null").groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    out = cut(reduce(DataFrame.unionAll, settled, open_nodes.select("node", F.lit(None).cast("int").alias("level"))))
    for chain in reversed(folded):
        found = chain.join(out.select(F.col("node").alias("top"), "level"), "top").select("node", F.when(F.col("level").isNotNull(), F.greatest("floor", F.col("level") + F.col("offset"))).alias("level"))
        out = cut(out.unionAll(found))
    return out


def _chained(single: DataFrame) -> DataFrame:
    """The maps (node, top, floor, offset) of nodes whose ``top`` is a node before them, composed until no top has a map of its own.

    Nodes on a ring of such nodes, and behind one, have no top and are left out.
    """
    maps = cut(single)
    heads = maps.select(F.col("node").alias("top"), F.col("top").alias("next_top"), F.col("floor").alias("next_floor"), F.col("offset").alias("next_offset"))
    steps = max(1, maps.count()).bit_length() + 1
    for _ in range(steps):  # the way doubles, so after these steps only rings are left
        grown = maps.join(_dealt(heads), "top", "left")
        floor = F.greatest("floor", F.col("next_floor") + F.col("offset"))
        maps = cut(grown.select("node", F.coalesce("next_top", "top").alias("top"), floor.alias("floor"), (F.col("offset") + F.coalesce("next_offset", F.lit(0))).alias("offset"), F.col("next_top").isNotNull().alias("moved")))
        if maps.where("moved").isEmpty():
            break
        heads = maps.select(F.col("node").alias("top"), F.col("top").alias("next_top"), F.col("floor").alias("next_floor"), F.col("offset").alias("next_offset"))
    return maps.where("not moved").drop("moved")


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) with a place by level, then by node; a cycle is an error, found where it is read."""
    leveled = levels(nodes, edges)
    return leveled.withColumn("level", F.coalesce("level", F.raise_error(F.lit("the graph has a cycle")).cast("int"))).orderBy("level", "node")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the strongly connected component, named by its smallest node; nodes of no cycle are alone.

    Edges to unknown nodes don't count.  Rounds of: trimming nodes without a way in or out; folding chains (one way
    in, one way out) into single edges by pointer doubling, which also closes rings; and, where these took away little
    (less than 1 - ``SHRUNK`` of the edges), colouring by what stands above and below in a random order, after which only edges
    within a colour are left.  A folded node belongs to the component of its chain's ends if these are in one component.
    """
    known = cut(nodes.select("node").distinct())
    left = edges.select("src", "dst").where("src <> dst").distinct().join(known.select(F.col("node").alias("src")), "src").join(known.select(F.col("node").alias("dst")), "dst")
    left = cut(left.select("src", "dst"))
    found, folded = [], []
    size = left.count()
    while size:
        ins = left.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("src").alias("before"))
        outs = left.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.min("dst").alias("after"))
        inner = cut(ins.join(outs, "node").withColumn("link", (F.col("ins") == 1) & (F.col("outs") == 1)))
        left = left.join(inner.select(F.col("node").alias("src")), "src", "left_semi").join(inner.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
        many, links = inner.agg(F.count(F.lit(1)), F.count_if("link")).first()
        if links > many * (1 - SHRUNK):
            chains, rings = _rings(inner.where("link"))
            found.append(rings)
            folded.append(chains)
            gone = inner.where("link")
            ends = chains.select(F.col("start").alias("src"), F.col("stop").alias("dst")).where("src <> dst")
            rest = left.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
            left = rest.unionAll(ends).distinct()
        left = cut(left)
        rest = left.count()
        if rest > size * SHRUNK:
            colours = _colours(left)
            # what stands above and below the same node is in a cycle with it
            found.append(colours.where("above = below").select("node", F.col("above.node").alias("component")))
            open_nodes = colours.where("above <> below")
            left = left.join(open_nodes.select(F.col("node").alias("src"), F.col("above").alias("a"), F.col("below").alias("b")), "src").join(open_nodes.select(F.col("node").alias("dst"), F.col("above").alias("c"), F.col("below").alias("d")), "dst")
            left = cut(left.where("a = c and b = d").select("src", "dst"))
            rest = left.count()
        size = rest
    out = reduce(DataFrame.unionAll, found) if found else known.limit(0).select("node", F.col("node").alias("component"))
    for chains in reversed(folded):
        # an end that stands in no list is alone, unless both ends are the same node
        ends = chains.join(out.select(F.col("node").alias("start"), F.col("component").alias("a")), "start", "left").join(out.select(F.col("node").alias("stop"), F.col("component").alias("b")), "stop", "left")
        ends = ends.withColumn("a", F.coalesce("a", "start")).withColumn("b", F.coalesce("b", "stop"))
        joined = ends.where("a = b").select("node", F.col("a").alias("component"))
        alone = ends.where("a = b and a = start").select(F.col("start").alias("node"), F.col("a").alias("component")).distinct().join(out, "node", "left_anti")
        out = cut(out.unionAll(joined).unionAll(alone))
    named = out.groupBy("component").agg(F.min("node").alias("name"))
    return known.join(out.join(named, "component").select("node", "name"), "node", "left").select("node", F.coalesce("name", "node").alias("component"))


def _rings(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains (node, start, stop: the nodes before and behind the chain) and rings (node, component) of nodes with one way in and one out."""
    ways = cut(links.select("node", "before", "after", F.col("node").alias("low")))
    for _ in range(max(1, ways.count()).bit_length() + 1):  # the way doubles, so after these steps only rings have ends that are inside
        a = ways.select(F.col("node").alias("before"), F.col("before").alias("further"), F.col("low").alias("l"))
        z = ways.select(F.col("node").alias("after"), F.col("after").alias("later"))
        grown = ways.drop("moved").join(a, "before", "left").join(z, "after", "left")
        ways = cut(grown.select("node", F.coalesce("further", "before").alias("before"), F.coalesce("later", "after").alias("after"), F.least("low", "l").alias("low"), (F.col("further").isNotNull() | F.col("later").isNotNull()).alias("moved")))
        if ways.where("moved").isEmpty():
            break
    # every node of a ring has seen the whole ring by now
    return ways.where("not moved").select("node", F.col("before").alias("start"), F.col("after").alias("stop")), ways.where("moved").select("node", F.col("low").alias("component"))


def _colours(edges: DataFrame) -> DataFrame:
    """(node, above, below): the first of all nodes that reach a node, and of all that it reaches, in an order by hash, as (h, node).

    Both also jump to what their own node has found, so long ways take few rounds; the order is random, so that rows of
    components fall apart in halves and not one by one.
    """
    name = F.struct(F.xxhash64("node").alias("h"), "node")
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).distinct()
    now = cut(ends.select("node", name.alias("above"), name.alias("below")))
    while True:
        down = edges.join(now.select(F.col("node").alias("src"), "above"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("above").alias("a"))
        up = edges.join(now.select(F.col("node").alias("dst"), "below"), "dst").groupBy(F.col("src").alias("node")).agg(F.max("below").alias("b"))
        near = now.join(down, "node", "left").join(up, "node", "left").select("node", F.greatest("above", "a").alias("above"), F.greatest("below", "b").alias("below"), F.col("above").alias("was_above"), F.col("below").alias("was_below"))
        far = near.join(now.select(F.col("node").alias("i"), F.col("above").alias("top")), F.col("above.node") == F.col("i")).join(now.select(F.col("node").alias("j"), F.col("below").alias("end")), F.col("below.node") == F.col("j"))
        after = far.select("node", F.greatest("above", "top").alias("above"), F.greatest("below", "end").alias("below"), "was_above", "was_below")
        after = cut(after.select("node", "above", "below", ((F.col("above") != F.col("was_above")) | (F.col("below") != F.col("was_below"))).alias("moved")))
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, node) of every component that holds a cycle: of two nodes or more, or a node with an edge to itself."""
    parts = cut(strong_components(nodes, edges))
    some = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(parts, "node").select("component")
    return parts.join(some.unionAll(loops).distinct(), "component", "left_semi").select("component", "node")


def cycle_members(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] = ()) -> DataFrame:
    """(members): each cycle's nodes as a sorted array; ``kinds`` of edges, if named, are the only ones that count."""
    usable = edges.where(F.col("kind").isin(list(kinds))) if kinds else edges
    return cycles(nodes, usable).groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members")).select("members")


def cycle_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, place, node): one closed way a component, from its smallest node round to it again.

    In a component every node keeps its smallest successor there.  Following these ends on rings, found by
    doubling the steps; of several rings of a component the one with the smallest node is told.
    """
    inside = cut(cycles(nodes, edges))
    known = edges.select("src", "dst").distinct().join(inside.select(F.col("node").alias("src"), "component"), "src").join(inside.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst")
    step = cut(known.where("component = other").groupBy("component", F.col("src").alias("node")).agg(F.min("dst").alias("next")))
    far, rounds = step.select("node", "next"), max(1, step.count()).bit_length()
    for _ in range(rounds):  # where 2 ** rounds steps lead is on a ring
        far = cut(far.join(far.select(F.col("node").alias("next"), F.col("next").alias("later")), "next").select("node", F.col("later").alias("next")))
    ring = cut(step.join(far.select(F.col("next").alias("node")).distinct(), "node", "left_semi").select("component", "node", "next"))
    # the smallest node of a ring by doubling, then the way to it from each node
    low = ring.select("node", "next", F.col("node").alias("low"))
    for _ in range(rounds):
        low = cut(low.join(low.select(F.col("node").alias("next"), F.col("next").alias("later"), F.col("low").alias("l")), "next").select("node", F.col("later").alias("next"), F.least("low", "l").alias("low")))
    told = low.join(ring.select("component", "node"), "node").withColumn("best", F.min("low").over(Window.partitionBy("component"))).where("low = best").select("node", "component", "low")
    left = cut(ring.join(told.select("node", "low"), "node").select("component", "node", "low", F.when(F.col("next") != F.col("low"), F.col("next")).alias("next"), F.lit(1).alias("steps")))
    for _ in range(rounds):
        ahead = left.select(F.col("node").alias("next"), F.col("next").alias("later"), F.col("steps").alias("more"))
        left = cut(left.join(ahead, "next", "left").select("component", "node", "low", F.col("later").alias("next"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    size = left.groupBy("component").agg(F.max("steps").alias("n"), F.first("low").alias("low"))
    placed = left.join(size.select("component", "n"), "component").select("component", (F.col("n") - F.col("steps")).alias("place"), "node")
    return placed.unionAll(size.select("component", F.col("n").alias("place"), F.col("low").alias("node")))


def reachable(edges: DataFrame, start: object) -> DataFrame:
    """(node): every node that can be reached from ``start``, itself only through a cycle."""
    step = cut(edges.select("src", "dst").distinct())
    first = step.select(F.lit(start).alias("node")).limit(1)
    found = cut(_spanning(step.where("src <> dst"), first).select("node"))
    back = step.where(F.col("dst") == F.lit(start)).join(found.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).limit(1)
    return found.where(F.col("node") != F.lit(start)).unionAll(back)


def _spanning(step: DataFrame, start: DataFrame) -> DataFrame:
    """(node, parent): a tree of distinct edges without loops over all that the ``start`` nodes reach.

    Nodes that only one other group of nodes leads to are folded into it, whole chains and trees at once by pointer doubling; ways within a
    group fall away, so that in the next round more nodes have one way in.  Nodes that no start leads to lose their ways out.  Only what
    is left when a round folds little is met round by round.
    """
    start = cut(start.select("node"))
    hops = cut(step.join(_dealt(start.select(F.col("node").alias("dst"))), "dst", "left_anti").select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("src").alias("via")))
    folded, size = [], hops.count()
    while size:
        entered = cut(hops.groupBy(F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("from").alias("top"), F.min("via").alias("parent")))
        single = entered.where("n = 1")
        chain = cut(_chained(single.select("node", "top", F.lit(0).alias("floor"), F.lit(1).alias("offset"))).select("node", "top").join(_dealt(single.select("node", "parent")), "node"))
        folded.append(chain)
        # nodes with one way in that no chain holds stand on or behind a ring that nothing leads to
        sources = start.select("node", F.col("node").alias("top")).unionAll(entered.where("n > 1").select("node", F.col("node").alias("top"))).unionAll(chain.select("node", "top"))
        ways = hops.join(_dealt(entered.where("n > 1").select(F.col("node").alias("to"))), "to", "left_semi").join(_dealt(sources.select(F.col("node").alias("from"), "top")), "from").where("top <> to")
        hops = cut(ways.groupBy(F.col("top").alias("from"), "to").agg(F.min("via").alias("via")))
        rest = hops.count()
        if rest > size * SHRUNK:
            break
        size = rest
    seen = front = cut(start.select("node", F.lit(None).cast(dict(start.dtypes)["node"]).alias("parent")))
    while size and not front.isEmpty():
        ahead = front.join(_dealt(hops), F.col("from") == F.col("node")).groupBy("to").agg(F.min("via").alias("parent"))
        front = cut(ahead.select(F.col("to").alias("node"), "parent").join(_dealt(seen), "node", "left_anti"))
        seen = cut(seen.unionAll(front))
    for chain in reversed(folded):
        seen = cut(seen.unionAll(chain.join(_dealt(seen.select(F.col("node").alias("top"))), "top").select("node", "parent")))
    return seen


def creates_cycle(edges: DataFrame, src: object, dst: object) -> bool:
    """Whether a new edge src -> dst would close a cycle."""
    return src == dst or not reachable(edges, dst).where(F.col("node") == F.lit(src)).isEmpty()


def dominator_tree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, parent, depth) of every node that the ``roots`` (node) reach: ``parent`` is the immediate dominator.

    NULL is the parent of a root and of a node that several roots reach by separate ways (depth 1).  Begins with a
    tree of shortest ways and moves every node up to the deepest node that all its predecessors stand below, until
    nothing moves; dominators of a node are above it all the time, so the last tree is the dominator tree.
    Where predecessors meet is found by lifting them to one depth and then together, by powers of two.
    """
    step = cut(edges.select("src", "dst").where("src <> dst").distinct())
    start = cut(roots.select("node").distinct())
    tree = depths(_spanning(step, start))
    inside = tree.select("node")
    ways = cut(step.join(_dealt(inside.select(F.col("node").alias("src"))), "src").join(_dealt(start.select(F.col("node").alias("dst"))), "dst", "left_anti").select(F.col("dst").alias("node"), F.col("src").alias("at")))
    # only nodes with several predecessors can move
    several = ways.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    ways = cut(ways.join(_dealt(several), "node", "left_semi"))
    while not ways.isEmpty():
        met = _meeting(ways, tree)
        moved = tree.join(_dealt(met), "node", "left").withColumn("new", F.when(F.col("found"), F.col("top")).otherwise(F.col("parent")))
        moved = cut(moved.select("node", F.col("new").alias("parent"), (~F.col("new").eqNullSafe(F.col("parent"))).alias("changed")))
        if moved.where("changed").isEmpty():
            break
        tree = depths(moved.select("node", "parent"))
    return tree


def depths(tree: DataFrame) -> DataFrame:
    """(node, parent, depth) of a tree (node, parent), its roots at depth 1, by pointer doubling."""
    now = cut(tree.select("node", "parent", F.col("parent").alias("up"), F.lit(1).alias("depth")))
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        # nodes that are there already would all meet at one key
        climbed = now.where("up is not null").join(_dealt(above), "up", "left").select("node", "parent", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        now = cut(now.where("up is null").unionAll(climbed))
    return now.select("node", "parent", "depth")


def _lifts(tree: DataFrame) -> list[DataFrame]:
    """Tables (node, up) of the ancestors 1, 2, 4, ... steps above."""
    out, now = [], cut(tree.where("parent is not null").select("node", F.col("parent").alias("up")))
    while not now.isEmpty():
        out.append(now)
        now = cut(now.join(_dealt(now.select(F.col("node").alias("up"), F.col("up").alias("next"))), "up").select("node", F.col("next").alias("up")))
    return out


def _meeting(ways: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, found, top): the deepest tree node at or above all nodes ``at`` of a node's ``ways``; NULL if only the place above the roots is."""
    lifts = _lifts(tree)
    now = ways.join(_dealt(tree.select(F.col("node").alias("at"), "depth")), "at")
    now = now.withColumn("least", F.min("depth").over(Window.partitionBy("node")))
    for k in range(len(lifts) - 1, -1, -1):
        up = lifts[k].select(F.col("node").alias("at"), "up")
        high = F.col("depth") - (1 << k) >= F.col("least")
        now = now.join(_dealt(up), "at", "left").select("node", F.when(high, F.col("up")).otherwise(F.col("at")).alias("at"), F.when(high, F.col("depth") - (1 << k)).otherwise(F.col("depth")).alias("depth"), "least")
    now = cut(now.select("node", "at").distinct())
    for k in range(len(lifts) - 1, -1, -1):
        up = lifts[k].select(F.col("node").alias("at"), "up")
        mine = Window.partitionBy("node")
        higher = now.join(_dealt(up), "at", "left").withColumn("apart", F.min("up").over(mine) < F.max("up").over(mine))
        now = cut(higher.select("node", F.when(F.col("apart"), F.col("up")).otherwise(F.col("at")).alias("at")).distinct())
    now = now.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("node"))).join(_dealt(tree.select(F.col("node").alias("at"), "parent")), "at")
    return now.select("node", F.lit(True).alias("found"), F.when(F.col("n") > 1, F.col("parent")).otherwise(F.col("at")).alias("top")).distinct()


def dominated(tree: DataFrame) -> DataFrame:
    """(node, dominates): how many other nodes each node of a tree (node, parent) has below it, by doubling."""
    counts = cut(tree.select("node", F.lit(1).cast("long").alias("n")))
    for up in _lifts(tree):
        below = up.join(_dealt(counts), "node").groupBy(F.col("up").alias("node")).agg(F.sum("n").alias("more"))
        counts = cut(counts.join(_dealt(below), "node", "left").select("node", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    return counts.select("node", (F.col("n") - 1).alias("dominates"))


def dominator_pairs(tree: DataFrame) -> DataFrame:
    """(node, dominator): every node on all ways to ``node``, itself included; as many rows as the depths add up to."""
    pairs = cut(tree.select("node", F.col("node").alias("dominator")))
    for up in _lifts(tree):
        pairs = cut(pairs.unionAll(pairs.join(_dealt(up.select(F.col("node").alias("dominator"), "up")), "dominator").select("node", F.col("up").alias("dominator"))))
    return pairs


def dominators(nodes: DataFrame, edges: DataFrame, root: object, kinds: Sequence[str] = ()) -> DataFrame:
    """(node, dominators): the nodes on every path from ``root``, sorted; only nodes that can be reached, none if ``root`` isn't there.

    Edges of other ``kinds`` than those named (all if none) don't count.
    """
    usable = edges.where(F.col("kind").isin(list(kinds))) if kinds else edges
    tree = dominator_tree(usable, nodes.where(F.col("node") == F.lit(root)))
    # each node's list of the 1, 2, 4, ... nodes from itself upwards, and the node that comes next
    now = cut(tree.select("node", F.col("parent").alias("up"), F.array("node").alias("above")))
    while not now.where("up is not null").isEmpty():
        lists = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("above").alias("more"))
        climbed = now.where("up is not null").join(_dealt(lists), "up").select("node", F.col("next").alias("up"), F.concat("above", "more").alias("above"))
        now = cut(now.where("up is null").unionAll(climbed))
    return now.select("node", F.sort_array("above").alias("dominators"))


#: Bands of an edge's confidence, from the least on.
BANDS = ("weak", "likely", "proven")


def topology(edges: DataFrame, missing: DataFrame | None = None, entries: DataFrame | None = None, least: str = "weak", many: int = 3, hard: Sequence[str] = ("sync_call",)) -> DataFrame:
    """One row a service: fan-in, fan-out, cycle, entry, unnamed callers, services that depend on it alone, and why it is critical.

    Edges: src, dst, kind, band (of ``BANDS``); those under ``least`` don't count.  ``missing`` has a row (callee) for each span
    whose caller was not seen.  Entries are the given services, or those that nothing calls.  Cycles count all
    edges; dominators only the ``hard`` ones, from all entries together, and a service that dominates ``many`` others or more is a
    single point of failure.
    """
    kept = cut(edges.where(F.array_position(F.array(*map(F.lit, BANDS)), F.col("band")) > BANDS.index(least)).select("src", "dst", "kind").distinct())
    pairs = kept.select("src", "dst").distinct()
    nodes = cut(pairs.select(F.col("src").alias("node")).unionAll(pairs.select(F.col("dst").alias("node"))).distinct())
    table = nodes.join(degrees(pairs), "node", "left")
    table = table.join(cycles(nodes, pairs).select("node", F.lit(True).alias("in_cycle")), "node", "left")
    starts = cut(entries.select("node").distinct().join(nodes, "node", "left_semi") if entries is not None else nodes.join(pairs.select(F.col("dst").alias("node")), "node", "left_anti"))
    below = dominated(dominator_tree(kept.where(F.col("kind").isin(list(hard))), starts))
    table = table.join(below, "node", "left").join(starts.withColumn("is_entry", F.lit(True)), "node", "left")
    if missing is not None:
        table = table.join(missing.groupBy(F.col("callee").alias("node")).agg(F.count(F.lit(1)).alias("unnamed")), "node", "left")
    unnamed = F.coalesce("unnamed", F.lit(0)).cast("long") if missing is not None else F.lit(0).cast("long")
    table = table.select("node", "fan_in", "fan_out", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"), F.coalesce("is_entry", F.lit(False)).alias("is_entry"), unnamed.alias("unnamed_callers"), F.coalesce("dominates", F.lit(0)).cast("long").alias("dominates"))
    reasons = F.array_compact(F.array(
        F.when(F.col("fan_in") >= many, "high_fan_in"), F.when(F.col("dominates") >= many, "dominates_many"), F.when(F.col("in_cycle"), "in_cycle"), F.when(F.col("unnamed_callers") > 0, "unobserved_dependents"),
    ))
    return table.withColumn("single_point_of_failure", F.col("dominates") >= many).withColumn("criticality_inputs", reasons)


def valid_chain(jobs: DataFrame, target: object) -> DataFrame:
    """Walks parent links from a job to its root, however many: (step, job_id, problem); NULL problem: the link is sound.

    Jobs: job_id, parent_id, kind, status.
    """
    root, sound = F.col("kind").isin("full", "snapshot", "continuous"), F.col("status").isin("completed", "verified")
    front, out = jobs.where(F.col("job_id") == F.lit(target)).withColumn("step", F.lit(0)).withColumn("seen", F.array("job_id")), None
    while True:  # a repeated job is a problem, so this ends
        problem = F.when(~sound, "not_completed").when(~root & F.col("parent_id").isNull(), "no_parent").when(F.array_contains("seen", F.col("parent_id")), "cycle")
        here = cut(front.withColumn("problem", problem))
        out = here if out is None else out.unionByName(here)
        ahead = here.where(problem.isNull() & ~root).select("parent_id", "seen", "step")
        if ahead.isEmpty():
            break
        up = ahead.withColumnRenamed("parent_id", "_p").withColumnRenamed("step", "_s").withColumnRenamed("seen", "_seen").join(jobs, F.col("_p") == F.col("job_id"), "left")
        missing = up.where("job_id is null").select(F.col("_p").alias("job_id"), (F.col("_s") + 1).alias("step"), F.lit("missing_parent").alias("problem"))
        if not missing.isEmpty():
            return out.select("step", "job_id", "problem").unionByName(missing.select("step", "job_id", "problem"))
        front = up.select(*jobs.columns, (F.col("_s") + 1).alias("step"), F.array_append("_seen", F.col("job_id")).alias("seen"))
    return out.select("step", "job_id", "problem")


def self_times(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, blocking, self_time): a span's time less its merged blocking children.

    Spans: trace_id, span_id, parent_span_id, start_at, duration, blocking.  Children's intervals are
    clipped to the parent and merged by a running maximum of ends.
    """
    kids = spans.where("blocking and parent_span_id is not null").select("trace_id", F.col("parent_span_id").alias("span_id"), F.col("start_at").alias("s"), (F.col("start_at") + F.col("duration")).alias("e"))
    inside = kids.join(spans.select("trace_id", "span_id", F.col("start_at").alias("ps"), (F.col("start_at") + F.col("duration")).alias("pe")), ["trace_id", "span_id"])
    clipped = inside.withColumn("s", F.greatest("s", "ps")).withColumn("e", F.least("e", "pe")).where("e > s")
    w = Window.partitionBy("trace_id", "span_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = clipped.withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(w), F.col("s")))))
    busy = fresh.groupBy("trace_id", "span_id").agg(F.sum("new").alias("blocking_time"))
    return spans.join(busy, ["trace_id", "span_id"], "left").select("trace_id", "span_id", F.coalesce("blocking_time", F.lit(0)).alias("blocking_time"), (F.col("duration") - F.coalesce("blocking_time", F.lit(0))).alias("self_time"))


def critical_path(spans: DataFrame) -> DataFrame:
    """(trace_id, depth, span_id): from each root to its last-finishing blocking child, and so on; ties by id."""
    end = F.col("start_at") + F.col("duration")
    last = spans.where("blocking and parent_span_id is not null").groupBy("trace_id", "parent_span_id").agg(F.max(F.struct(end.alias("e"), F.col("span_id"))).alias("m")).select(F.col("trace_id").alias("t"), F.col("parent_span_id").alias("p"), F.col("m.span_id").alias("child"))
    front = cut(spans.where("parent_span_id is null").select("trace_id", F.lit(0).alias("depth"), "span_id"))
    out, d = front, 0
    while True:  # each span has one parent, and roots have none, so no span comes twice
        d += 1
        front = cut(front.join(last, (F.col("trace_id") == F.col("t")) & (F.col("span_id") == F.col("p"))).select("trace_id", F.lit(d).alias("depth"), F.col("child").alias("span_id")))
        if front.isEmpty():
            break
        out = out.unionAll(front)
    return out


def criticality(nodes: DataFrame, edges: DataFrame, weights: DataFrame | None = None, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, score): how much of the graph leans on a node, by power iteration along the edges (src depends on dst).

    Every node passes ``damping`` of its score on to what it depends on, in equal parts; a node that depends on
    nothing keeps it, so nothing has to be summed over all nodes.  ``weights`` (node, weight) gives declared criticality,
    by which a score is multiplied in the end; 1 where none is given.  A round is one join and one sum by node.
    """
    known = cut(nodes.select("node").distinct())
    step = edges.select("src", "dst").where("src <> dst").distinct().join(known.select(F.col("node").alias("src")), "src").join(known.select(F.col("node").alias("dst")), "dst")
    step = cut(step.join(step.groupBy("src").agg(F.count(F.lit(1)).alias("ways")), "src"))
    ends = known.join(step.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("_end", F.lit(True))
    now = cut(known.join(ends, "node", "left").select("node", F.coalesce("_end", F.lit(False)).alias("_end"), F.lit(1.0).alias("score")))
    for _ in range(rounds):
        given = step.join(now.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") / F.col("ways")).alias("given"))
        kept = F.when(F.col("_end"), F.col("score")).otherwise(0.0)
        now = cut(now.join(given, "node", "left").select("node", "_end", (F.lit(1 - damping) + damping * (F.coalesce("given", F.lit(0.0)) + kept)).alias("score")))
    if weights is None:
        return now.select("node", "score")
    return now.join(weights.groupBy("node").agg(F.max("weight").alias("weight")), "node", "left").select("node", (F.col("score") * F.coalesce("weight", F.lit(1.0))).alias("score"))


def graph_statistics(nodes: DataFrame, edges: DataFrame, weights: DataFrame | None = None, top: int = 10) -> DataFrame:
    """One row: node_count, relationship_count, orphan_count, average_degree, max_degree, density, components and the ``top`` critical assets."""
    known = cut(nodes.select("node").distinct())
    pairs = cut(edges.select("src", "dst").distinct().join(known.select(F.col("node").alias("src")), "src", "left_semi").join(known.select(F.col("node").alias("dst")), "dst", "left_semi"))
    degree = known.join(degrees(pairs).select("node", (F.col("fan_in") + F.col("fan_out")).alias("degree")), "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    sums = degree.agg(F.count(F.lit(1)).alias("node_count"), F.sum((F.col("degree") == 0).cast("long")).alias("orphan_count"), F.round(F.avg("degree"), 4).alias("average_degree"), F.max("degree").alias("max_degree"), F.sum("degree").alias("ends"))
    n = F.col("node_count")
    parts = connected_components(known, pairs).agg(F.count_distinct("component").alias("components"))
    ranked = criticality(known, pairs, weights).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "node").limit(top)
    best = ranked.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "node"))), lambda x: x["node"]).alias("critical_assets"))
    # each side is one row, met by a constant
    one = F.lit(1).alias("_one")
    whole = sums.withColumn("relationship_count", (F.coalesce("ends", F.lit(0)) / 2).cast("long")).withColumn("density", F.when(n > 1, F.col("relationship_count") / (n * (n - 1))).otherwise(0.0)).drop("ends")
    return whole.select("*", one).join(parts.select("*", one), "_one").join(best.select("*", one), "_one").drop("_one")
