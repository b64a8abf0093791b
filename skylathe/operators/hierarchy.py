"""Parent-child rows to full hierarchies, by heavy-path decomposition after cycle separation.

1. Names become integer ids (``nodes``); each child keeps one parent (``links``).
2. Subtree sizes come by doubling: in round k each node knows its 2^k-th ancestor and how many
   descendants lie nearer than 2^k. A round in which no node runs out of ancestors proves that those still
   left are on or below a loop: they are separated, and the loops' nodes become roots of what is below.
3. Each parent's largest child continues its chain. A node's chain and place on it again come by doubling;
   chain links have one child each, so no key is hot here.
4. The chains form a tree at most log2(n) deep. Doubling over chains concatenates their segments: a node's
   path is a list of (chain, last place) pairs, and the descendants of the node at place p of chain c are
   the nodes with a segment (c, q), q >= p: an interval of the chain.

All rounds are joins on integers, cut by reliable checkpoints; their number is logarithmic in the depth.
Look-ups of hot parents go through ``skew_join``. Nothing is collected but counts and heavy keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..session import cut, cut_count
from .skew import HEAVY_FLOOR, heavy_keys, skew_join


def lookup(left: DataFrame, key: str, right: DataFrame, right_key: str, how: str = "left", floor: int = HEAVY_FLOOR, most: int | None = None) -> DataFrame:
    """``left`` with the columns of ``right`` (unique by ``right_key``) for the value in ``key``.

    ``most``: a known bound of the rows of ``left``; below the floor no key can be heavy.
    """
    if most is not None and most < floor:
        return left.join(right.withColumnRenamed(right_key, key), [key], how)
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    heavy = heavy_keys(counts, [key], "_c", floor=floor)
    return skew_join(left, right.withColumnRenamed(right_key, key), [key], heavy, how)


@dataclass
class Hierarchy:
    nodes: DataFrame  #: id, name
    places: DataFrame  #: id, chain, pos, chain_depth, segments, root, state, below, size
    loops: DataFrame  #: id, loop_min (the smallest name on the node's loop)
    count: int  #: number of nodes
    dropped: DataFrame  #: function_name, parent_name: further parents of functions that have several

    def found(self) -> DataFrame:
        """(function_name, root_name, depth, cycle_state) of every name."""
        named = lookup(self.places.select("id", "root", "state", (F.col("chain_depth") + F.col("pos")).alias("depth")), "root", self.nodes.select(F.col("id").alias("root_id"), F.col("name").alias("root_name")), "root_id", most=self.count)
        return self._looped(named).join(self.nodes, "id").select(
            F.col("name").alias("function_name"),
            F.coalesce("loop_min", "root_name").alias("root_name"),
            F.col("depth").cast("bigint").alias("depth"),
            F.col("state").cast("bigint").alias("cycle_state"),
        )

    def chains(self) -> DataFrame:
        """(chain, names): the names of each chain in order. No array is longer than the longest path."""
        member = self.places.select("id", "chain", "pos").join(self.nodes, "id")
        return member.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("m")).select("chain", F.transform("m", lambda m: m["name"]).alias("names"))

    def paths(self, between: str = " > ") -> DataFrame:
        """(function_name, path): the names from the root, or from the loop's node it hangs on, down to each one.

        What lies above a chain is put together once for the chain, from one piece for each chain above it, of
        which there are log2(n) at most; the chain's nodes add their part of the chain where they are.
        """
        chains = cut(self.chains())
        above = self.places.filter("pos = 0").select("chain", F.posexplode(F.slice("segments", 1, F.size("segments") - 1)).alias("k", "s")).select("chain", "k", F.col("s.chain").alias("up"), "s.upto")
        part = lambda upto: F.array_join(F.slice("names", F.lit(1), upto + 1), between)
        places = cut(above.groupBy("up", "upto").agg(F.count(F.lit(1)).alias("n")))
        pieces = lookup(places.drop("n"), "up", chains, "chain", "inner", most=self.count).select("up", "upto", part(F.col("upto")).alias("piece"))
        found = skew_join(above, pieces, ["up", "upto"], heavy_keys(places, ["up", "upto"], "n"), "inner")
        heads = found.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("p"))
        heads = heads.select("chain", F.array_join(F.transform("p", lambda p: p["piece"]), between).alias("head"))
        whole = chains.join(heads, "chain", "left").select("head", "names", F.posexplode("names").alias("pos", "function_name"))
        return whole.select("function_name", F.concat_ws(between, "head", part(F.col("pos"))).alias("path"))

    def _chain_names(self, df: DataFrame) -> DataFrame:
        named = self.nodes.select(F.col("id").alias("head"), F.col("name").alias("chain_name"))
        return lookup(df, "chain", named, "head")

    def _looped(self, df: DataFrame) -> DataFrame:
        """``df`` with the smallest name of the loop at or above each node; null where there is none."""
        if self.loops is None:
            return df.withColumn("loop_min", F.lit(None).cast("string"))
        return lookup(df, "root", self.loops, "id", most=self.count)

    def intervals(self) -> DataFrame:
        """(function_name, chain_kind, chain_name, first, last, n_below): where the functions below each one lie.

        They are those with a row in ``members`` of the same chain and a place from first to last, except the
        function itself. A chain has the name of its first node. A loop is a chain of one place under its smallest
        name; a function on it has all functions on and below it, itself included, as a walk along the links has.
        """
        ends = self.places.groupBy("chain").agg(F.max("pos").alias("last"))
        spots = self._looped(self.places.select("id", "chain", "pos", "root", "state", "size"))
        if self.loops is not None:
            tied = cut(spots.filter("state > 0").groupBy("loop_min").agg(F.count(F.lit(1)).alias("tied")))
            spots = spots.join(tied, "loop_min", "left")
        else:
            spots = spots.withColumn("tied", F.lit(None).cast("bigint"))
        on = F.col("state") == 1
        spots = self._chain_names(lookup(spots, "chain", ends.withColumnRenamed("chain", "c"), "c", most=self.count)).join(self.nodes, "id")
        return spots.select(
            F.col("name").alias("function_name"),
            F.when(on, "loop").otherwise("chain").alias("chain_kind"),
            F.when(on, F.col("loop_min")).otherwise(F.col("chain_name")).alias("chain_name"),
            F.when(on, 0).otherwise(F.col("pos")).cast("bigint").alias("first"),
            F.when(on, 0).otherwise(F.col("last")).cast("bigint").alias("last"),
            F.when(on, F.col("tied")).otherwise(F.col("size") - 1).cast("bigint").alias("n_below"),
        )

    def members(self) -> DataFrame:
        """(function_name, chain_kind, chain_name, place): each function's last place on every chain above it and
        on its own, log2(n) at most, and on the loop above it or its own."""
        segments = self.places.select("id", F.explode("segments").alias("s")).select("id", "s.chain", F.col("s.upto").alias("place"))
        rows = self._chain_names(segments).select("id", F.lit("chain").alias("chain_kind"), "chain_name", "place")
        if self.loops is not None:
            tied = self._looped(self.places.filter("state > 0").select("id", "root"))
            rows = rows.unionByName(tied.select("id", F.lit("loop").alias("chain_kind"), F.col("loop_min").alias("chain_name"), F.lit(0).alias("place")))
        return rows.join(self.nodes, "id").select(F.col("name").alias("function_name"), "chain_kind", "chain_name", F.col("place").cast("bigint").alias("place"))

    def below(self, functions: DataFrame | None = None) -> DataFrame:
        """(function_name, descendant_name) of the functions named in ``functions`` (function_name), or of all.

        All pairs are as many as the depths of all functions together; ask for those that are needed.
        """
        spans = self.intervals() if functions is None else self.intervals().join(functions.select("function_name").distinct(), "function_name", "left_semi")
        m = self.members().withColumnRenamed("function_name", "descendant_name")
        pairs = spans.join(m, ["chain_kind", "chain_name"]).filter("place BETWEEN first AND last AND (chain_kind = 'loop' OR function_name <> descendant_name)")
        return pairs.select("function_name", "descendant_name")


def _double(links: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Sizes of the subtrees of (id, parent) links, less the nodes without descendants; the links left on or
    below loops, if any, and their number. Sizes are right for the nodes not on or below a loop.

    Only nodes whose 2^k-th ancestor exists stay in round k. What they pass on to it is kept per round and
    summed up at the end, so nodes that have run out of ancestors are not carried along.
    """
    live, count = cut_count(links.filter(F.col("parent").isNotNull()).select("id", F.col("parent").alias("jump"), F.lit(1).cast("bigint").alias("size")))
    passed = [live.select(F.col("jump").alias("id"), F.col("size").alias("more"))]
    while count:
        given = live.groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("more"))
        ahead = live.select(F.col("id").alias("at"), F.col("jump").alias("next"))
        moved = lookup(live, "jump", ahead, "at", "inner", most=count)
        moved = moved.join(given, "id", "left").select("id", F.col("next").alias("jump"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        live, left = cut_count(moved)
        passed.append(live.select(F.col("jump").alias("id"), F.col("size").alias("more")))
        if left == count:  # nobody ran out of ancestors: the rest is on or below loops
            break
        count = left
    whole = passed[0]
    for given in passed[1:]:
        whole = whole.unionByName(given)
    return whole.groupBy("id").agg(F.sum("more").alias("below")), live.select("id") if count else None, count


def _with_size(links: DataFrame, below: DataFrame) -> DataFrame:
    return links.join(below, "id", "left").select("id", "parent", (F.coalesce("below", F.lit(0)) + 1).alias("size"))


def _loops(links: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(id, loop_min) of the nodes on loops, given the links of the nodes on or below loops.

    The images of f, f^2, f^4, ... shrink to the nodes on loops and then stay; a node's minimum over the
    first 2^k nodes of its walk is its loop's once it gets no smaller for any of them.
    """
    walk = links.join(names, "id").select("id", F.col("parent").alias("jump"), F.col("name").alias("low"))
    count = -1
    while True:
        ahead = walk.select(F.col("id").alias("at"), F.col("jump").alias("next"), F.col("low").alias("far"))
        walk, less = cut_count(lookup(walk, "jump", ahead, "at", "inner", most=most).select("id", F.col("next").alias("jump"), F.least("low", "far").alias("low"), (F.col("far") < F.col("low")).alias("less")), "less")
        on = walk.select(F.col("jump").alias("id")).distinct()
        now = on.count()
        walk = walk.drop("less")
        if now == count and not less:
            return walk.join(on, "id", "left_semi").select("id", F.col("low").alias("loop_min"))
        count = now


def _chains(forest: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(id, parent, size, chain, pos) given (id, parent, size): chain is the id of its first node. Of children with
    subtrees of one size, the first by name continues the chain."""
    child = forest.filter(F.col("parent").isNotNull()).join(nodes, "id")
    pick = child.groupBy("parent").agg(F.min_by("id", F.struct(-F.col("size"), F.col("name"))).alias("id"))
    heavy = pick.select("id", F.lit(True).alias("follows"))
    state = forest.join(heavy, "id", "left").select("id", "parent", "size", F.when(F.col("follows"), F.col("parent")).alias("up"))
    state = cut(state.withColumn("chain", F.coalesce("up", "id")).withColumn("pos", F.when(F.col("up").isNotNull(), 1).otherwise(0)))
    # nodes that have reached the first node of their chain are put aside; the others hop three times along the links
    # of the last round, so the links grow fourfold
    step = state.select("id", F.coalesce("up", "id").alias("up"), "pos", F.col("up").isNull().alias("there"))
    parts, open_ = [step.filter("there")], most
    step = step.filter(~F.col("there"))
    while True:
        ahead = step
        for p in parts:
            ahead = ahead.unionByName(p)
        ahead = ahead.select(F.col("id").alias("at"), F.col("up").alias("next"), F.col("pos").alias("more"), F.col("there").alias("then"))
        for _ in range(3):
            step = lookup(step, "up", ahead, "at", "inner", most=open_).select("id", F.col("next").alias("up"), (F.col("pos") + F.col("more")).alias("pos"), F.col("then").alias("there"))
        moved, n = cut_count(step, "NOT there")
        parts.append(moved.filter("there"))
        if not n:
            break
        step, open_ = moved.filter(~F.col("there")), n
    there = parts[0]
    for p in parts[1:]:
        there = there.unionByName(p)
    return cut(state.select("id", "parent", "size").join(there.select("id", F.col("up").alias("chain"), "pos"), "id"))


def _chain_tree(placed: DataFrame, most: int) -> DataFrame:
    """(chain, root, chain_depth, over): depth of the chain's first node and the segments above it."""
    heads = placed.filter(F.col("id") == F.col("chain")).select("chain", "parent")
    at = placed.select(F.col("id").alias("pid"), F.col("chain").alias("up"), F.col("pos").alias("upto"))
    tree = lookup(heads, "parent", at, "pid", most=most)
    seg = F.struct(F.col("up").alias("chain"), F.col("upto").alias("upto"))
    none = F.array().cast("array<struct<chain:bigint,upto:int>>")
    state = cut(
        tree.select(
            "chain",
            "up",
            F.coalesce("up", "chain").alias("root_chain"),
            F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.col("upto") + 1).cast("bigint").alias("chain_depth"),
            F.when(F.col("up").isNull(), none).otherwise(F.array(seg).cast("array<struct<chain:bigint,upto:int>>")).alias("over"),
        )
    )
    hanging = most
    while hanging:
        ahead = state.select(F.col("chain").alias("at"), F.col("up").alias("up2"), F.col("root_chain").alias("root2"), F.col("chain_depth").alias("depth2"), F.col("over").alias("over2"))
        done, open_ = state.filter(F.col("up").isNull()), state.filter(F.col("up").isNotNull())
        moved = lookup(open_, "up", ahead, "at", most=hanging).select(
            "chain",
            F.col("up2").alias("up"),
            F.col("root2").alias("root_chain"),
            (F.col("chain_depth") + F.col("depth2")).alias("chain_depth"),
            F.concat("over2", "over").alias("over"),
        )
        state, hanging = cut_count(done.unionByName(moved), "up IS NOT NULL")
    return state.select("chain", F.col("root_chain").alias("root"), "chain_depth", "over")


def hierarchy(df: DataFrame, parent: str, child: str) -> Hierarchy:
    """The forest of the parent-child rows of ``df``.

    Names differing only in case or white space are one. Blank children give no information (a named
    parent beside one is still a node); blank parents count only where the child has no named one. Should a
    child have several named parents, the smallest name counts; the others are given as ``dropped``. Repeated links count once. A child that is
    its own parent is a loop of one. An empty table gives no nodes.
    """
    pairs = df.select(name_key(F.col(parent)).alias("p"), name_key(F.col(child)).alias("c"))
    names = pairs.select(F.col("p").alias("name")).unionByName(pairs.select(F.col("c").alias("name"))).filter("name is not null").distinct()
    nodes, n = cut_count(names.withColumn("id", F.monotonically_increasing_id()))
    one = pairs.filter("c is not null").groupBy("c").agg(F.min("p").alias("p"))
    others = pairs.filter("c is not null and p is not null").distinct().join(one.select("c", F.col("p").alias("kept")), "c").filter("p <> kept")
    others = others.select(F.col("c").alias("function_name"), F.col("p").alias("parent_name"))
    ids = lookup(one, "p", nodes.select(F.col("name").alias("n"), F.col("id").alias("parent")), "n", most=n)
    links = cut(nodes.join(ids.select(F.col("c").alias("name"), "parent"), "name", "left").select("id", "parent"))

    sized, knotted, tied_count = _double(links)
    loops = None
    forest = _with_size(links, sized).withColumn("below", F.lit(False))
    if knotted is not None:
        tied = cut(links.join(knotted, "id", "left_semi"))
        loops = cut(_loops(tied, nodes, tied_count))
        hung = cut(tied.join(loops.select("id", F.lit(True).alias("on_loop")), "id", "left").select("id", F.when(F.col("on_loop").isNull(), F.col("parent")).alias("parent")))
        hung_size, _, _ = _double(hung)
        clear = forest.join(knotted, "id", "left_anti")
        forest = clear.unionByName(_with_size(hung, hung_size).withColumn("below", F.lit(True)))
    forest = cut(forest)
    placed = _chains(forest.select("id", "parent", "size"), nodes, n)
    tree = _chain_tree(placed, n)
    whole = lookup(placed, "chain", tree.withColumnRenamed("chain", "c"), "c", most=n).join(forest.select("id", "below"), "id")
    depth = F.col("chain_depth") + F.col("pos")
    places = whole.select(
        "id",
        "parent",
        "chain",
        F.col("pos").cast("int").alias("pos"),
        "chain_depth",
        "root",
        "size",
        F.concat("over", F.array(F.struct(F.col("chain"), F.col("pos").cast("int").alias("upto")))).alias("segments"),
        F.when(~F.col("below"), 0).when(depth == 0, 1).otherwise(2).alias("state"),
    )
    return Hierarchy(nodes, cut(places), loops, n, others)
