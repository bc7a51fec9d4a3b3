"""Recursive graph operators as rounds of joins.

Every round reads what the last one wrote, so plans stay short and lost executors cost one round. `keep(df, label)`
writes a table where all executors read it. Joins of rounds ask for sorted merges: a table that Spark takes for small enough
to broadcast would else go through the driver once a round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattika.operators.rounds import Growing, drop

Keep = Callable[[DataFrame, str], DataFrame]


def until_empty(start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], keep: Keep, label: str = "closure") -> DataFrame:
    """Semi-naive closure: `step(frontier, known)` gives new rows, until it gives none. A round writes its new rows alone."""
    rounds = Growing(keep, label)
    frontier = rounds.add(start)
    while not frontier.isEmpty():
        frontier = rounds.add(step(frontier, rounds.all()))
    return rounds.all()


def terminal_owner(nodes: DataFrame, keep: Keep) -> DataFrame:
    """node, terminal, hops, state for a forest of (node, parent): the last ancestor of each node.

    state: `root` where the chain ends in a node without parent, `missing` where it leaves the table, `cycle` where it
    never ends (terminal is null). Pointers double in each round, so a chain of n nodes takes log n rounds; when none moves, all are where they end.
    """
    count = nodes.count()
    start = nodes.select("node", F.coalesce("parent", "node").alias("at"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("hops"))
    ids = nodes.select(F.col("node").alias("known"), F.col("parent").isNull().alias("root"))
    now, reach, moved = keep(start, "owners"), 1, True
    while reach <= count and moved:
        ahead = now.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"))
        further = (F.col("next") != F.col("at")).alias("moved")
        before, now = now, keep(now.join(ahead.hint("merge"), "at", "left").select("node", F.coalesce("next", "at").alias("at"), F.expr("hops + coalesce(more, 0)").alias("hops"), further), "owners")
        drop(before)
        reach, moved = 2 * reach, not now.where("moved").isEmpty()
    out = now.join(ids.hint("merge"), now.at == ids.known, "left")
    state = F.when(F.col("known").isNull(), "missing").when(F.col("root"), "root").otherwise("cycle")
    return out.select("node", F.when(state != "cycle", F.col("at")).alias("terminal"), F.when(state != "cycle", F.col("hops")).alias("hops"), state.alias("state"))


def leads_to_cycle(nodes: DataFrame, keep: Keep) -> DataFrame:
    """Nodes of (node, parent) whose chain of parents comes back to a node: on a cycle or before one."""
    return terminal_owner(nodes, keep).where("state = 'cycle'").select("node")


def _cycles_of_pointers(pointers: DataFrame, keep: Keep) -> DataFrame:
    """Nodes on cycles where each node of (a, b) points to one other at most: where all are after as many steps as there are nodes. Steps double in each round."""
    count, reach = pointers.count(), 1
    now = keep(pointers.select("a", "b"), "pointers")
    while reach <= count:
        ahead = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        before, now = now, keep(now.join(ahead.hint("merge"), "b").select("a", F.col("c").alias("b")), "pointers")
        drop(before)
        reach *= 2
    return now.select(F.col("b").alias("node")).distinct()


def _trimmed(edges: DataFrame, keep: Keep) -> DataFrame:
    """Edges that are left when nodes without way in or out go, round after round."""
    left, count = keep(edges, "edges"), -1
    while count != (count := left.count()):
        ends = left.select(F.col("a").alias("n")).intersect(left.select(F.col("b").alias("n")))
        before, left = left, keep(left.join(ends, left.a == ends.n, "left_semi").join(ends, left.b == ends.n, "left_semi"), "edges")
        drop(before)
    return left


def on_cycles(edges: DataFrame, keep: Keep) -> DataFrame:
    """Nodes of directed edges (a, b) that lie on a cycle, loops included; null ends count for nothing.

    Where each node has one way out, or one way in, at most, rounds double and a chain of n nodes takes log n of them. Else strongly
    connected components are found by colouring: each node takes the least node that reaches it, and those that reach that one again
    are its component. Rounds then follow the longest path.
    """
    plain = keep(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    for way in (plain, plain.select(F.col("b").alias("a"), F.col("a").alias("b"))):
        if way.groupBy("a").count().where("count > 1").isEmpty():
            return _cycles_of_pointers(way, keep)
    found = Growing(keep, "cycles")
    found.add(plain.where("a = b").select(F.col("a").alias("node")))
    left = _trimmed(plain.where("a <> b"), keep)
    while not left.isEmpty():
        colours = keep(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("colour"), F.lit(True).alias("fell")), "colours")
        while not colours.where("fell").isEmpty():
            near = left.join(colours.where("fell"), left.a == colours.node).groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("near"))
            least = F.least("colour", "near")
            before, colours = colours, keep(colours.join(near, "node", "left").select("node", least.alias("colour"), (least < F.col("colour")).alias("fell")), "colours")
            drop(before)
        inside = left.join(colours.select(F.col("node").alias("a"), F.col("colour").alias("from")), "a").join(colours.select(F.col("node").alias("b"), F.col("colour").alias("to")), "b")
        back = keep(inside.where("from = to").select("a", "b"), "back")
        step = lambda new, old: new.join(back, new.node == back.b).select(F.col("a").alias("node"), "colour").distinct().join(old, ["node", "colour"], "left_anti")
        whole = until_empty(colours.where("node = colour").select("node", "colour"), step, keep, "components")
        large = whole.groupBy("colour").count().where("count > 1").select("colour")
        found.add(whole.join(large, "colour", "left_semi").select("node"))
        done = whole.select(F.col("node").alias("done"))
        left = _trimmed(left.join(done, left.a == done.done, "left_anti").join(done, left.b == done.done, "left_anti"), keep)
    return found.all().distinct()


def closure(edges: DataFrame, keep: Keep) -> DataFrame:
    """All (a, b) where b is reached from a over one edge or more. For graphs whose closure is meant to be listed."""
    start = edges.select("a", "b").distinct()
    hop = edges.select(F.col("a").alias("b"), F.col("b").alias("c")).distinct()
    return until_empty(start, lambda new, old: new.join(hop, "b").select("a", F.col("c").alias("b")).distinct().join(old, ["a", "b"], "left_anti"), keep)


def availability(elements: DataFrame, keep: Keep, variant: str = "ancestors") -> DataFrame:
    """(element, page) for elements (element, parent, owner_kind, page, pages array).

    `ancestors`: any element on the chain lists the page, or its own page; `application`: only lists of elements owned by
    the application count; `draft`: the own page, and lists of such owners.
    """
    rows = elements.select("element", "parent", "owner_kind", "page", "pages")
    up = rows.select("element", F.col("element").alias("at"))
    parent = rows.select(F.col("element").alias("at"), F.col("parent").alias("next")).where("next IS NOT NULL")
    chain = until_empty(up, lambda new, old: new.join(parent.hint("merge"), "at").select("element", F.col("next").alias("at")).distinct().join(old.hint("merge"), ["element", "at"], "left_anti"), keep)
    lists = rows if variant == "ancestors" else rows.where("owner_kind = 'application'")
    listed = chain.join(lists.select(F.col("element").alias("at"), F.explode("pages").alias("p")).hint("merge"), "at").select("element", F.col("p").alias("page"))
    if variant == "application":
        return listed.distinct()
    return listed.union(rows.where("page IS NOT NULL").select("element", "page")).distinct()


def depths(edges: DataFrame, starts: DataFrame, keep: Keep, floors: DataFrame | None = None) -> DataFrame:
    """node, depth over undirected edges (a, b) from the nodes of `starts`; unreached nodes lie one beyond the deepest. floors (node, least): nodes that lie no nearer."""
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    start = starts.select("node").distinct().withColumn("depth", F.lit(0))

    def step(new: DataFrame, old: DataFrame) -> DataFrame:
        near = new.join(both, new.node == both.a).select(F.col("b").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        return near.join(old.select("node"), "node", "left_anti")

    known = until_empty(start, step, keep)
    beyond = known.agg((F.coalesce(F.max("depth"), F.lit(-1)) + 1).alias("depth"))
    rest = both.select(F.col("a").alias("node")).distinct().join(known.select("node"), "node", "left_anti")
    found = known.unionByName(rest.crossJoin(F.broadcast(beyond)))  # beyond is one row
    return found if floors is None else found.join(floors, "node", "left").select("node", F.greatest("depth", F.coalesce("least", "depth")).alias("depth"))


def routes(edges: DataFrame, starts: DataFrame, keep: Keep, goals: DataFrame | None = None) -> DataFrame:
    """start, node, cost, steps, tie, path: the best route from every start to every node it reaches.

    edges: a, b, key, cost (not negative), kind (verified edges are `0`, others `1`). Routes compare by cost, then steps, then tie,
    the keys of the edges with their kinds, joined by `>`, in binary order. Each round relaxes all improved nodes at once: their offers and what is settled meet in
    one grouping, which is the next round's settled table and marks the nodes that fell. goals (start, node): a start whose goals are all reached goes on only where a route may still be better;
    other nodes are then listed as far as they were met.
    """
    none = F.array().cast("array<struct<kind:string,key:string>>")
    begin = starts.select(F.col("node").alias("start"), "node").distinct()
    settled = keep(begin.select("start", "node", F.lit(0).cast("double").alias("cost"), F.lit(0).alias("steps"), F.lit("").alias("tie"), none.alias("path"), F.lit(True).alias("fell")), "routes")
    hop = keep(edges.select("a", "b", "key", F.col("cost").cast("double").alias("w"), F.col("kind").cast("string").alias("kind")), "edges")
    part = F.concat("kind", F.lit(":"), "key")
    while not (frontier := settled.where("fell")).isEmpty():
        found = frontier.join(hop, frontier.node == hop.a).select(
            "start", F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("steps") + 1).alias("steps"), F.when(F.col("tie") == "", part).otherwise(F.concat("tie", F.lit(">"), part)).alias("tie"),
            F.lit(1).alias("fresh"), F.concat("path", F.array(F.struct("kind", "key"))).alias("path"),
        )
        if goals is not None:
            met = goals.select("start", "node").distinct().join(settled, ["start", "node"], "left").groupBy("start").agg(F.max("cost").alias("limit"), F.bool_and(F.col("cost").isNotNull()).alias("all"))
            found = found.join(met.where("all").select("start", "limit"), "start", "left").where("limit IS NULL OR cost <= limit").drop("limit")
        every = settled.select("start", "node", "cost", "steps", "tie", F.lit(0).alias("fresh"), "path").unionByName(found)
        best = every.groupBy("start", "node").agg(F.min(F.struct("cost", "steps", "tie", "fresh", "path")).alias("b"))  # of equals the settled one
        before, settled = settled, keep(best.select("start", "node", "b.cost", "b.steps", "b.tie", "b.path", (F.col("b.fresh") == 1).alias("fell")), "routes")
        drop(before)
    drop(hop)
    return settled.select("start", "node", "cost", "steps", "tie", F.transform("path", lambda p: p["key"]).alias("path"))


def neighbours(edges: DataFrame) -> DataFrame:
    """node, neighbour: both directions of (a, b), each once."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("neighbour")).union(edges.select("b", "a")).distinct()


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, inbound, outbound: sorted distinct neighbours of every node, empty where there are none."""
    out = edges.groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_set("b")).alias("outbound"))
    into = edges.groupBy(F.col("b").alias("node")).agg(F.array_sort(F.collect_set("a")).alias("inbound"))
    empty = F.array().cast(out.schema["outbound"].dataType)
    return nodes.select("node").join(into, "node", "left").join(out, "node", "left").select("node", F.coalesce("inbound", empty).alias("inbound"), F.coalesce("outbound", empty).alias("outbound"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.select("node").join(neighbours(edges).select("node"), "node", "left_anti")


def children_in_order(elements: DataFrame) -> DataFrame:
    """parent, children: of (id, key, parent, pos), in the order already known (pos), new ones after by key."""
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit(2**31 - 1)).alias("pos"), "key", "id")))
    return elements.where("parent IS NOT NULL").groupBy("parent").agg(F.transform(ranked, lambda x: x["id"]).alias("children"))


def preferred_edges(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair of (a, b, kind, key): verified ones (`0`) first, then by key."""
    pair = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")]
    rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("kind", "key", "a"))
    return edges.select("*", *pair).withColumn("__rank", rank).where("__rank = 1").drop("__rank", "x", "y")


def flatten_tree(nodes: DataFrame, keep: Keep) -> DataFrame:
    """node, depth, place: preorder of (node, parent, pos) trees; orphans are roots. Nodes on a cycle of parents, and those below one, hang on no root and are left out."""
    known = nodes.select(F.col("node").alias("parent"))
    linked = nodes.join(known, "parent", "left_semi").select("node", "parent", "pos")
    roots = nodes.join(linked.select("node"), "node", "left_anti").select("node", F.lit(0).alias("depth"), F.array(F.col("pos").cast("long")).alias("place"))
    down = linked.select("parent", F.col("node").alias("child"), F.col("pos").cast("long").alias("p"))
    step = lambda new, _: new.join(down, new.node == down.parent).select(F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("place", F.array("p")).alias("place"))
    return until_empty(roots, step, keep)


def visible_parent(nodes: DataFrame, keep: Keep) -> DataFrame:
    """node, parent of (node, parent, visible): the nearest ancestor that is visible, null where there is none. Pointers to hidden nodes double in each round. For forests without cycles."""
    unseen = nodes.where("NOT coalesce(visible, false)").select(F.col("node").alias("at"))
    now = keep(nodes.select("node", F.col("parent").alias("at")), "parents")
    while not (hidden := now.join(unseen, "at", "left_semi")).isEmpty():
        through = now.select(F.col("node").alias("at"), F.col("at").alias("next"))
        moved = hidden.join(through, "at").select("node", F.col("next").alias("at"))
        before, now = now, keep(now.join(hidden.select("node"), "node", "left_anti").select("node", "at").unionByName(moved), "parents")
        drop(before)
    return now.select("node", F.col("at").alias("parent"))


def preorder(nodes: DataFrame, keep: Keep) -> DataFrame:
    """node, tree, place, depth, parent of the visible nodes of (node, parent, pos, visible) trees, in the order of a walk from the root down.

    place counts the visible nodes of a tree from 1; depth counts all ancestors, hidden ones too; parent is the nearest visible ancestor. A hidden node goes, and what hangs on it moves
    up in its place. Children go by (pos, node); a node whose parent is unknown is a root; tree is the root's node. Nodes on a cycle of parents, and those below one, hang on no root and are left out.

    The walk is a list: into a node, through its children, out of it. Its places come from list ranking, in which every entry learns in each round what lies
    twice as far ahead, so a chain of n nodes takes some log n rounds and no row grows with the depth.
    """
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("__known")).distinct()
    linked = nodes.join(known, "parent", "left").select("node", F.when(F.col("__known"), F.col("parent")).alias("parent"), "pos", F.coalesce("visible", F.lit(False)).alias("visible"))
    roots = terminal_owner(linked, keep).where("terminal IS NOT NULL").select("node", F.col("terminal").alias("tree"), F.col("hops").alias("depth"))
    rows = keep(linked.join(roots, "node"), "tree")
    among = Window.partitionBy("parent").orderBy("pos", "node")
    placed = rows.where("parent IS NOT NULL").select("node", "parent", F.lead("node").over(among).alias("right"), F.row_number().over(among).alias("n"))
    first = placed.where("n = 1").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    into = rows.join(first, "node", "left").select("node", F.lit(0).alias("side"), F.coalesce("child", "node").alias("next"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("next_side"), F.col("visible").cast("long").alias("ahead"))
    none = F.lit(None).cast(rows.schema["node"].dataType)
    out = rows.select("node", "parent").join(placed.select("node", "right"), "node", "left").select("node", F.lit(1).alias("side"), F.coalesce("right", "parent", none).alias("next"), F.when(F.col("right").isNull(), 1).otherwise(0).alias("next_side"), F.lit(0).cast("long").alias("ahead"))
    now = keep(into.unionByName(out), "walk")
    while not now.where("next IS NOT NULL").isEmpty():
        further = now.select(F.col("node").alias("next"), F.col("side").alias("next_side"), F.col("next").alias("__next"), F.col("next_side").alias("__side"), F.col("ahead").alias("__ahead"))
        step = now.join(further, ["next", "next_side"], "left")
        before, now = now, keep(step.select("node", "side", F.col("__next").alias("next"), F.coalesce("__side", "next_side").alias("next_side"), (F.col("ahead") + F.coalesce("__ahead", F.lit(0))).alias("ahead")), "walk")
        drop(before)
    ranked = now.where("side = 0").select("node", "ahead").join(rows, "node").where("visible")
    held = rows.where("visible").groupBy("tree").agg(F.count("*").alias("held"))
    up = visible_parent(rows, keep)
    return ranked.drop("parent").join(held, "tree").join(up, "node").select("node", "tree", (F.col("held") - F.col("ahead") + 1).alias("place"), "depth", "parent")
