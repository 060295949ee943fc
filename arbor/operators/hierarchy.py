"""Parent/child trees by pointer doubling.

A tree table has a node and a nullable parent column and, where it holds several trees,
tree keys (tree=["tree_id"]): node ids are then unique within a tree only, and every
result carries the keys.  Each round doubles the reach of every node's jump pointer and
of what was gathered on the way, so that a tree of depth d takes about log2(d) rounds of
one row per node: neither (node, ancestor) pairs nor levels are ever written out.

A parent that is not in the table counts as none.  Repeated (tree, node) rows are not
allowed.  A cycle raises ValueError.  Empty tables give empty results."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import cut, dealt, drop


def _dealt_out(df: DataFrame) -> DataFrame:
    """df for a join with a row of every node: both sides are shuffled.  Broadcast, a table
    of nodes would go through the driver in every round."""
    return df.hint("merge")


def gather(tree: DataFrame, up: dict[str, tuple] | None = None, down: dict[str, tuple] | None = None, node: str = "node", parent: str = "parent",
           keys: Sequence[str] = ()) -> DataFrame:
    """keys, node and one column per name.  up: name -> (start, join), folded over the
    path from the node to its root, where join(a, b) puts the fold a of the lower part
    before b of the upper part.  down: name -> (start, aggregate, join), over the node
    and all below it; aggregate folds the values of many nodes, join two of them."""
    keys, up, down = list(keys), up or {}, down or {}
    starts = {n: v[0] for n, v in (up | down).items()}
    rows = tree.select(*keys, F.col(node).alias("_n"), F.col(parent).alias("_p"), *[v.alias(n) for n, v in starts.items()])
    here = tree.select(*keys, F.col(node).alias("_p"), F.col(node).alias("_j"))
    state = cut(rows.join(_dealt_out(here), [*keys, "_p"], "left").select(*keys, "_n", "_j", *starts))
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        live = state.where("_j is not null")
        if live.isEmpty():
            return state.select(*keys, F.col("_n").alias(node), *starts)
        above = state.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_n").alias("_a"), F.col("_j").alias("_aj"), *[F.col(n).alias(f"_u_{n}") for n in up])
        on = F.col("_j") == F.col("_a")
        for i, k in enumerate(keys):
            on = on & (F.col(k) == F.col(f"_k{i}"))
        moved = live.join(_dealt_out(above), on).select(*keys, "_n", F.col("_aj").alias("_j"), *[v[1](F.col(n), F.col(f"_u_{n}")).alias(n) for n, v in up.items()], *down)
        both = state.where("_j is null").unionByName(moved)
        if down:
            got = live.groupBy(*keys, F.col("_j").alias("_n")).agg(*[v[1](F.col(n)).alias(f"_d_{n}") for n, v in down.items()])
            both = both.join(_dealt_out(got), [*keys, "_n"], "left").select(
                *keys, "_n", "_j", *up, *[F.when(F.col(f"_d_{n}").isNull(), F.col(n)).otherwise(v[2](F.col(n), F.col(f"_d_{n}"))).alias(n) for n, v in down.items()])
        before, state = state, cut(both)
        drop(before)
    raise ValueError("the parent pointers do not end")


def _or(a: Column, b: Column) -> Column:
    return a | b


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def subtree_size(tree: DataFrame, node: str = "node", parent: str = "parent", keys: Sequence[str] = ()) -> DataFrame:
    """node, size: the node and all below it."""
    return gather(tree, down={"size": (F.lit(1).cast("long"), F.sum, lambda a, b: a + b)}, node=node, parent=parent, keys=keys)


def sibling_share(sized: DataFrame, parent: str = "parent", value: str = "size", keys: Sequence[str] = ()) -> DataFrame:
    """Adds share: value over its sum among the children of one parent (1 for roots)."""
    names = [*keys, parent]
    total = sized.where(F.col(parent).isNotNull()).groupBy(*names).agg(F.sum(value).alias("_total"))
    return sized.join(total, names, "left").withColumn("share", F.when(F.col(parent).isNull(), F.lit(1.0)).otherwise(F.col(value) / F.col("_total"))).select(*sized.columns, "share")


def pipe_radii(tree: DataFrame, root_radius: float, exponent: float = 2.0, node: str = "node", parent: str = "parent", keys: Sequence[str] = ()) -> DataFrame:
    """node, radius by the pipe model: r_child = (w r_parent^x)^(1/x) with w the child's
    share of subtree size; in closed form r0 (product of w along the path)^(1/x)."""
    sized = subtree_size(tree, node, parent, keys)
    shared = sibling_share(tree.select(*keys, node, parent).join(sized, [*keys, node]), parent, keys=keys)
    logs = gather(shared, up={"w": (F.log("share"), lambda a, b: a + b)}, node=node, parent=parent, keys=keys)
    return logs.select(*keys, node, (F.exp(F.col("w") / exponent) * root_radius).alias("radius"))


def children(tree: DataFrame, node: str = "node", parent: str = "parent", keys: Sequence[str] = ()) -> DataFrame:
    """node, children (ascending); nodes without children are absent."""
    return (tree.where(F.col(parent).isNotNull()).groupBy(*keys, F.col(parent).alias("node"))
            .agg(F.sort_array(F.collect_list(node)).alias("children")))


def roles(tree: DataFrame, node: str = "node", parent: str = "parent", keys: Sequence[str] = ()) -> DataFrame:
    """node, parent, is_shoot (the last of several children)."""
    kids = tree.where(F.col(parent).isNotNull()).groupBy(*keys, parent).agg(F.max(node).alias("_last"), F.count("*").alias("_kids"))
    return (tree.select(*keys, node, parent).join(_dealt_out(kids), [*keys, parent], "left")
            .select(*keys, node, parent, _flag((F.col("_kids") > 1) & (F.col(node) == F.col("_last"))).alias("is_shoot")))


def trunk_path(tree: DataFrame, node: str = "node", parent: str = "parent", keys: Sequence[str] = ()) -> DataFrame:
    """node, height: the ancestors of each tree's trunk top, bottom up.  The top is the
    node of least subtree (then least id) among those reached from a root without a shoot."""
    seen = cut(gather(roles(tree, node, parent, keys), up={"bent": (F.col("is_shoot"), _or), "height": (F.lit(1), lambda a, b: a + b)},
                      down={"size": (F.lit(1).cast("long"), F.sum, lambda a, b: a + b)}, node=node, parent=parent, keys=keys))
    top = seen.where("not bent").groupBy(*keys).agg(F.min_by(node, F.struct("size", node)).alias("_top"))
    marked = tree.select(*keys, node, parent).join(top, list(keys)) if keys else tree.select(node, parent).join(F.broadcast(top))
    path = gather(marked, down={"under": (F.col(node) == F.col("_top"), F.bool_or, _or)}, node=node, parent=parent, keys=keys)
    return path.where("under").join(_dealt_out(seen), [*keys, node]).select(*keys, node, (F.col("height") - 1).alias("height"))


def branch_order(cyl: DataFrame, node: str = "node", parent: str = "parent", branch: str = "branch", keys: Sequence[str] = ()) -> DataFrame:
    """node, order (branch changes on the way from the root), index_in_branch (place in
    the run of this branch that ends at the node)."""
    p = cyl.select(*keys, F.col(node).alias(parent), F.col(branch).alias("_b"))
    turns = (cyl.select(*keys, node, parent, branch).join(_dealt_out(p), [*keys, parent], "left")
             .select(*keys, node, parent, F.coalesce(F.col("_b") != F.col(branch), F.lit(False)).alias("_turn")))
    run = F.struct(F.lit(1).cast("long").alias("n"), F.col("_turn").alias("turn"))
    longer = lambda a, b: F.when(a["turn"], a).otherwise(F.struct((a["n"] + b["n"]).alias("n"), b["turn"].alias("turn")))
    got = gather(turns, up={"order": (F.col("_turn").cast("long"), lambda a, b: a + b), "_run": (run, longer)}, node=node, parent=parent, keys=keys)
    return got.select(*keys, node, "order", F.col("_run.n").alias("index_in_branch"))


def extension(cyl: DataFrame, node: str = "node", parent: str = "parent", branch: str = "branch", keys: Sequence[str] = ()) -> DataFrame:
    """node, extension: the first child of the same branch, null if none."""
    names = [*keys, "node", "_b"]
    kids = cyl.where(F.col(parent).isNotNull()).groupBy(*keys, F.col(parent).alias("node"), F.col(branch).alias("_b")).agg(F.min(node).alias("extension"))
    return cyl.select(*keys, F.col(node).alias("node"), F.col(branch).alias("_b")).join(kids, names, "left").select(*keys, "node", "extension")


def crown(cyl: DataFrame, node: str = "node", parent: str = "parent", order: str = "order", z: str = "sz", keys: Sequence[str] = ()) -> DataFrame:
    """node: each tree's crown.  Seeds are all nodes above order 3, or else of the highest
    order there is up to 3; then their ancestors off the stem, all descendants of those,
    and all others off the stem that start no lower than the lowest first-order seed."""
    base = cyl.select(*keys, node, parent, F.col(order).alias("_ord"), F.col(z).alias("_z"))
    level = base.groupBy(*keys).agg(F.least(F.max("_ord"), F.lit(4)).alias("_level"))
    with_ = (lambda d, one: d.join(one, list(keys), "left")) if keys else (lambda d, one: d.join(F.broadcast(one)))
    base = with_(base, level).withColumn("_seed", _flag(F.col("_ord") >= F.col("_level")))
    up = gather(base, down={"_over": (F.col("_seed"), F.bool_or, _or)}, node=node, parent=parent, keys=keys)
    first = base.join(_dealt_out(up), [*keys, node]).withColumn("_first", _flag(F.col("_seed") | F.col("_over") & (F.col("_ord") > 0)))
    first = cut(first.select(*keys, node, parent, "_ord", "_z", "_first"))
    down = gather(first, up={"_in": (F.col("_first"), _or)}, node=node, parent=parent, keys=keys)
    low = first.where("_first and _ord = 1").groupBy(*keys).agg(F.min("_z").alias("_low"))
    all_ = with_(first.join(_dealt_out(down), [*keys, node]), low)
    return all_.where(_flag(F.col("_in") | (F.col("_ord") > 0) & (F.col("_z") >= F.col("_low")))).select(*keys, F.col(node).alias("node"))


def touched(tree: DataFrame, node: str = "node", parent: str = "parent", gen: str = "gen", keys: Sequence[str] = ()) -> DataFrame:
    """node, last_gen: latest generation of the node's subtree."""
    return gather(tree, down={"last_gen": (F.col(gen), F.max, lambda a, b: F.greatest(a, b))}, node=node, parent=parent, keys=keys)


def numbered(rows: DataFrame, order: list[str], keys: Sequence[str] = (), out: str = "number") -> DataFrame:
    """Adds a dense number from 0 over the order, within keys where given.  Rows are dealt
    by ranges; counts per range give each range's first number, so that no task sorts a
    whole tree or table."""
    keys = list(keys)
    d = dealt(rows, [*keys, *order])
    sizes = d.groupBy("_part", *keys).count()
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", *keys, F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)) - 1
    return d.withColumn("_i", place).join(before, ["_part", *keys]).select(*rows.columns, (F.col("_i") + F.col("_before")).alias(out))


def prune(tree: DataFrame, least: int, node: str = "node", parent: str = "parent", gen: str = "gen", keys: Sequence[str] = ()) -> DataFrame:
    """Nodes of generation >= least, densely renumbered from 0 in each tree in order of the
    old id (new_node, new_parent); a dropped parent leaves a null."""
    kept = cut(numbered(tree.where(F.col(gen) >= least), [node], keys, "new_node"))
    ids = kept.select(*keys, F.col(node).alias(parent), F.col("new_node").alias("new_parent"))
    return kept.join(ids, [*keys, parent], "left").select(*tree.columns, "new_node", "new_parent")


def skeleton_to_cylinders(nodes: DataFrame) -> DataFrame:
    """One cylinder per edge of node(tree_id, node_id, parent_id, x, y, z, radius):
    start at the parent, unit axis, length, the child's radius; parent cylinder is the
    edge that enters the parent; a first child goes on its parent's branch."""
    p = nodes.select("tree_id", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"s{c}") for c in "xyz"], F.col("parent_id").alias("_up"))
    e = nodes.join(p, ["tree_id", "parent_id"])
    length = F.sqrt(sum((F.col(c) - F.col(f"s{c}")) ** 2 for c in "xyz"))
    kids = nodes.where("parent_id is not null").groupBy("tree_id", "parent_id").agg(F.min("node_id").alias("_first"))
    return e.join(kids, ["tree_id", "parent_id"]).withColumn("length", length).select(
        "tree_id", F.col("node_id").alias("cyl_id"), "sx", "sy", "sz",
        *[F.when(F.col("length") > 0, (F.col(c) - F.col(f"s{c}")) / F.col("length")).alias(f"a{c}") for c in "xyz"],
        "length", "radius", F.when(F.col("_up").isNotNull(), F.col("parent_id")).alias("parent_cyl"), (F.col("node_id") == F.col("_first")).alias("continues"))


def trunk_height(trunk: DataFrame, z: str = "z", keys: Sequence[str] = ()) -> DataFrame:
    """keys, height: greatest less least z over the trunk's nodes."""
    return trunk.groupBy(*keys).agg((F.max(z) - F.min(z)).alias("height"))


def most_of_children(tree: DataFrame, value: str, node: str = "node", parent: str = "parent", keys: Sequence[str] = ()) -> DataFrame:
    """node, most: the greatest value among a node's children; nodes without are absent."""
    return tree.where(F.col(parent).isNotNull()).groupBy(*keys, F.col(parent).alias(node)).agg(F.max(value).alias("most"))


def beside_parent(tree: DataFrame, value: str, node: str = "node", parent: str = "parent", keys: Sequence[str] = ()) -> DataFrame:
    """tree with parent_value, the parent's value; roots and orphans are left out."""
    up = tree.select(*keys, F.col(node).alias(parent), F.col(value).alias("parent_value"))
    return tree.join(up, [*keys, parent])
