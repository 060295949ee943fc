"""Space-colonisation growth of many trees in lockstep.

State is two tables: nodes(tree_id, node_id, parent_id, x, y, z, gen and the parent's
place, so that a node is also its edge) and endpoints(tree_id, ep_id, x, y, z, node_id,
dist).  A generation proposes all new nodes from one snapshot, drops those that would come
too near an edge of another tree, and settles conflicts between proposals in the order of
a keyed priority, like a sequential pass in that order.  Assignments are kept up to date:
only new nodes are held against the endpoints, and only endpoints of nodes that just got
their second child are searched again.  Both are done in one pass over the endpoints, who
look up the nodes around their cell: no endpoint is dealt to several cells, and a
generation takes a fixed number of passes.  New nodes are appended to the shared folder;
what a generation has used up is deleted there."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.scalars import apical_control, suppressed
from ..functions.vec import cols, with_segment_distance2
from ..plans.stage import Appended, cut, drop
from .spatial import around_cells, clear_edges, edge_conflicts, inside_mesh, nearest_around, nearest_by_rings, radius_pairs, segment_hits

DEAD, FAR = -1, -2
#: Nodes whose cells are broadcast to the endpoints (each is in 27 of them, and in two
#: sizes); with more, Spark chooses.
FEW = 4000


def with_room(nodes: DataFrame) -> DataFrame:
    """tree_id, node_id, x, y, z of nodes with at most one child."""
    kids = nodes.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_child"))
    return nodes.join(kids, ["tree_id", "node_id"], "left").where(F.coalesce("n_child", F.lit(0)) <= 1).select("tree_id", "node_id", "x", "y", "z")


def _own(df: DataFrame, params: DataFrame | None, **values: float) -> tuple[DataFrame, dict[str, Column]]:
    """df and a Column for each value: the tree's own of params (tree_id and the same
    names), or the value where there are none."""
    if params is None:
        return df, {k: F.lit(float(v)) for k, v in values.items()}
    return df.join(params.select("tree_id", *[F.col(k).alias(f"_{k}") for k in values]), "tree_id"), {k: F.col(f"_{k}") for k in values}


def assign(endpoints: DataFrame, nodes: DataFrame, influence: float, params: DataFrame | None = None) -> DataFrame:
    """endpoints with node_id (nearest node of the same tree with at most one child,
    FAR if none is nearer than influence) and dist.  params: a tree's own influence, no
    greater than influence."""
    e = _looked_up(endpoints.select("tree_id", "ep_id", "x", "y", "z"), with_room(nodes), influence, "_m")
    d, (e, own) = F.sqrt("_m.d2"), _own(e, params, influence=influence)
    near = F.coalesce(d < own["influence"], F.lit(False))
    return e.select("tree_id", "ep_id", "x", "y", "z", F.when(near, F.col("_m.n")).otherwise(FAR).alias("node_id"), F.when(near, d).alias("dist"))


def _alive(assigned: DataFrame, kill: float, params: DataFrame | None) -> DataFrame:
    d, own = _own(assigned, params, kill=kill)
    return d.where(F.col("dist").isNull() | (F.col("dist") > own["kill"])).select(assigned.columns)


def _looked_up(endpoints: DataFrame, nodes: DataFrame, influence: float, name: str, limit: str | None = None, where: str | None = None, few: bool = False) -> DataFrame:
    """endpoints with name: d2 and n of the nearest of nodes in the same tree and nearer
    than influence, found within a quarter of it or else in all of it."""
    places = nodes.groupBy("tree_id", "x", "y", "z").agg(F.min("node_id").alias("node_id"))
    return nearest_around(endpoints, around_cells(places, "node_id", (influence / 4, influence), ("tree_id",), few), name, ("tree_id",), limit, where)


def reassigned(assigned: DataFrame, nodes: DataFrame, grown: DataFrame, influence: float, kill: float, params: DataFrame | None = None, few: bool = False) -> DataFrame:
    """assigned after the new nodes of grown, which nodes holds too: updated() by them,
    then endpoints of nodes that have two children now are searched again.  Those that
    died are DEAD, and left out by the next call.  few: nodes are at most FEW."""
    full = (nodes.join(grown.select("tree_id", "parent_id").distinct(), ["tree_id", "parent_id"], "left_semi")
            .groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n")).where("n >= 2").select("tree_id", "node_id", F.lit(True).alias("_full")))
    rows = _looked_up(assigned.where(F.col("node_id") != DEAD), grown.select("tree_id", "node_id", "x", "y", "z"), influence, "_near", "dist", few=few)
    now = _overtaken(rows.withColumn("m", F.struct(F.sqrt("_near.d2").alias("d"), F.col("_near.n").alias("n"))), influence, kill, params)
    now = now.join(F.broadcast(full) if few else full, ["tree_id", "node_id"], "left")
    again, own = _own(_looked_up(now, with_room(nodes), influence, "_near", where="_full", few=few), params, influence=influence, kill=kill)
    d = F.sqrt("_near.d2")
    far = F.col("_near.d2").isNull() | (d >= own["influence"])
    node = F.when(F.col("_full").isNull(), F.col("node_id")).when(far, FAR).when(d <= own["kill"], DEAD).otherwise(F.col("_near.n"))
    dist = F.when(F.col("_full").isNull(), F.col("dist")).when(~far, d)
    return cut(again.select("tree_id", "ep_id", "x", "y", "z", node.alias("node_id"), dist.alias("dist")), "assigned")


def updated(assigned: DataFrame, new_nodes: DataFrame, influence: float, kill: float, params: DataFrame | None = None, first: float | None = None) -> DataFrame:
    """assigned (tree_id, ep_id, x, y, z, node_id, dist) after new nodes of the same trees:
    one takes an endpoint over where it is strictly nearer than the stored distance (of
    several the nearest, ties to the least id); nearer than or at kill the endpoint is
    DEAD, at influence or beyond FAR.  Only the new nodes are joined, no farther than the
    stored distance; first is nearest_by_rings()'s."""
    n = new_nodes.select("tree_id", "node_id", "x", "y", "z")
    open_ = assigned.where(F.col("node_id") != DEAD)
    near = (nearest_by_rings(open_.select("tree_id", "ep_id", "x", "y", "z", "dist"), n, influence, ["tree_id", "ep_id"], "node_id", first, also=("tree_id",), limit="dist")
            .select("tree_id", "ep_id", F.struct(F.sqrt("d2").alias("d"), F.col("node_id").alias("n")).alias("m")))
    return _overtaken(assigned.join(near, ["tree_id", "ep_id"], "left"), influence, kill, params)


def _overtaken(assigned: DataFrame, influence: float, kill: float, params: DataFrame | None) -> DataFrame:
    """assigned with m, the distance d and id n of the nearest new node, if any: as updated()."""
    better = F.col("m.d").isNotNull() & (F.col("dist").isNull() | (F.col("m.d") < F.col("dist"))) & (F.col("node_id") != DEAD)
    d = F.when(better, F.col("m.d")).otherwise(F.col("dist"))
    rows, own = _own(assigned, params, influence=influence, kill=kill)
    node = (F.when(F.col("node_id") == DEAD, DEAD).when(d.isNull() | (d >= own["influence"]), FAR).when(d <= own["kill"], DEAD)
            .when(better, F.col("m.n")).otherwise(F.col("node_id")))
    return rows.select("tree_id", "ep_id", "x", "y", "z", node.alias("node_id"), F.when(d < own["influence"], d).alias("dist"))


def proposals(endpoints: DataFrame, nodes: DataFrame, step: float, tropism: float = 0.0, params: DataFrame | None = None) -> DataFrame:
    """tree_id, parent_id, px, py, pz, x, y, z: one new node per active node, a step
    along the sum of the unit directions to its endpoints; a zero sum grows nothing."""
    n = nodes.select("tree_id", "node_id", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    d = endpoints.where("node_id >= 0 and dist > 0").join(n, ["tree_id", "node_id"])
    s = d.groupBy("tree_id", "node_id", "px", "py", "pz").agg(*[F.sum((F.col(c) - F.col(f"p{c}")) / F.col("dist")).alias(f"v{c}") for c in "xyz"])
    length = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    s, own = _own(s, params, step=step, tropism=tropism)
    return s.withColumn("_l", length).where(F.col("_l") > 1e-12).select(
        "tree_id", F.col("node_id").alias("parent_id"), "px", "py", "pz",
        *[(F.col(f"p{c}") + own["step"] * F.col(f"v{c}") / F.col("_l") + (own["tropism"] if c == "z" else F.lit(0.0))).alias(c) for c in "xyz"])


def settle(new: DataFrame, least: float, longest: float, seed: int, generation: int, rounds: int = 100) -> DataFrame:
    """Of proposed edges (edge_id, tree_id, p0*, p1*) those that a sequential pass in the
    order of the keyed priority would take: each round takes edges without an undecided
    rival of higher priority and drops the rivals of what was taken."""
    p = cut(new.withColumn("key", rng.uniform(seed, generation, "edge_id")))
    if least <= 0:
        return p.drop("key")
    pairs = _conflicting_pairs(p, least, longest)
    rivals = cut(pairs)
    open_, chosen = p.select("edge_id"), None
    if rivals.isEmpty():
        return p.drop("key")
    for _ in range(rounds):
        live = rivals.join(open_, "edge_id", "left_semi").join(open_.select(F.col("edge_id").alias("rival")), "rival", "left_semi")
        beaten = live.where("rival_key < key or rival_key = key and rival < edge_id").select("edge_id").distinct()
        won = cut(open_.join(beaten, "edge_id", "left_anti"))
        chosen = won if chosen is None else chosen.unionByName(won)
        gone = live.join(won, "edge_id", "left_semi").select(F.col("rival").alias("edge_id")).distinct()
        before, open_ = open_, cut(open_.join(won, "edge_id", "left_anti").join(gone, "edge_id", "left_anti"))
        drop(before)
        if open_.isEmpty():
            drop(rivals, open_)
            return p.drop("key").join(chosen, "edge_id", "left_semi")
    raise ValueError("proposals did not settle")


def _conflicting_pairs(p: DataFrame, least: float, longest: float) -> DataFrame:
    mid = p.select("*", *[((F.col(f"p0{n}") + F.col(f"p1{n}")) / 2).alias(n) for n in "xyz"])
    near = radius_pairs(mid, mid, least + longest).where(F.col("tree_id") != F.col("b_tree_id"))
    far = with_segment_distance2(near, cols("p0"), cols("p1"), cols("b_p0"), cols("b_p1"), "far2")
    pairs = far.groupBy("edge_id", "key", F.col("b_edge_id").alias("rival"), F.col("b_key").alias("rival_key")).agg(F.min("far2").alias("far2"))
    return pairs.where(F.col("far2") < least * least).drop("far2")


def edges(nodes: DataFrame) -> DataFrame:
    """edge_id, tree_id, p0*, p1* of every node with a parent."""
    if "px" not in nodes.columns:
        p = nodes.select("tree_id", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
        nodes = nodes.join(p, ["tree_id", "parent_id"])
    return nodes.where("parent_id is not null").select(F.xxhash64("tree_id", "node_id").alias("edge_id"), "tree_id", *[F.col(f"p{c}").alias(f"p0{c}") for c in "xyz"], *[F.col(c).alias(f"p1{c}") for c in "xyz"])


def unhindered(e: DataFrame, terrain: DataFrame | None, excluded: DataFrame | None, edge: float) -> DataFrame:
    """Proposed edges (edge_id, p0*, p1*) that meet no triangle of the terrain and do not
    end in the closed mesh of an exclusion group."""
    if terrain is not None:
        e = e.join(segment_hits(e, terrain, edge), "edge_id", "left_anti")
    if excluded is not None:
        ends = e.select("edge_id", *[F.col(f"p1{c}").alias(c) for c in "xyz"])
        e = e.join(inside_mesh(ends, excluded, "edge_id", edge), "edge_id", "left_anti")
    return e


def unsuppressed(new: DataFrame, nodes: DataFrame, generation: int, control: tuple[float, float, float, float], seed: int) -> DataFrame:
    """Proposals that apical control lets grow: control holds its strength, the generation
    at which it ends, factor and falloff; it keeps shoots (a second child) from growing."""
    c0, t0, factor, falloff = control
    kids = nodes.where("parent_id is not null").select("tree_id", F.col("parent_id")).distinct()
    c = apical_control(F.lit(float(c0)), F.lit(float(t0)), F.lit(float(generation)))
    u = rng.uniform(seed + 1, generation, "tree_id", "parent_id")
    shoots = new.join(kids, ["tree_id", "parent_id"], "left_semi").where(~suppressed(c, F.lit(float(factor)), F.lit(float(falloff)), u))
    return new.join(kids, ["tree_id", "parent_id"], "left_anti").unionByName(shoots)


def grow(roots: DataFrame, endpoints: DataFrame, generations: int, step: float | str, influence: float | str, kill: float | str, least: float = 0.8,
         tropism: float | str = 0.0, seed: int = 5, terrain: DataFrame | None = None, excluded: DataFrame | None = None,
         control: tuple[float, float, float, float] | None = None) -> DataFrame:
    """nodes after so many generations.  roots: tree_id, x, y, z; endpoints: tree_id,
    ep_id, x, y, z.  An endpoint dies when a node comes as near as kill.  terrain and
    excluded are triangles that edges may not meet and closed meshes that nodes may not
    lie in; control is unsuppressed()'s.  step, influence, kill and tropism are values of
    all trees or names of columns of roots with each tree's own."""
    given = {"step": step, "influence": influence, "kill": kill, "tropism": tropism}
    params = None
    if any(isinstance(v, str) for v in given.values()):
        params = cut(roots.select("tree_id", *[(F.col(v) if isinstance(v, str) else F.lit(v)).cast("double").alias(k) for k, v in given.items()]), "parameters")
        top = params.agg(F.max("step"), F.max("influence"), F.max("kill"), F.max(F.abs("tropism"))).first()
        step, influence, kill, tropism = (v or 0.0 for v in top)  # the greatest, as bounds
    columns = "tree_id", "node_id", "parent_id", "x", "y", "z", "gen", "px", "py", "pz"
    none = [F.lit(None).cast("double").alias(f"p{c}") for c in "xyz"]
    grown = cut(roots.select("tree_id", F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), "x", "y", "z", F.lit(0).alias("gen"), *none))
    store = Appended(grown, "nodes")
    nodes, longest, n_nodes = store.read(), step + abs(tropism), grown.count()
    alive = cut(_alive(assign(endpoints, nodes, influence, params), kill, params), "assigned")
    for g in range(1, generations + 1):
        new = proposals(alive, nodes, step, tropism, params)
        if control is not None:
            new = unsuppressed(new, nodes, g, control, seed)
        w = Window.partitionBy("tree_id").orderBy("parent_id")
        top = nodes.groupBy("tree_id").agg(F.max("node_id").alias("top"))
        numbered = cut(new.withColumn("r", F.row_number().over(w)).join(top, "tree_id").withColumn("node_id", F.col("top") + F.col("r")), "proposed")
        e = numbered.select(F.xxhash64("tree_id", "node_id").alias("edge_id"), "tree_id", *[F.col(f"p{c}").alias(f"p0{c}") for c in "xyz"],
                            *[F.col(c).alias(f"p1{c}") for c in "xyz"], "node_id", "parent_id")
        ok = settle(clear_edges(unhindered(e, terrain, excluded, max(step, 1e-6) * 2), edges(nodes), least, longest), least, longest, seed, g)
        before, grown = grown, cut(ok.select("tree_id", "node_id", "parent_id", *[F.col(f"p1{c}").alias(c) for c in "xyz"], F.lit(g).alias("gen"), *[F.col(f"p0{c}").alias(f"p{c}") for c in "xyz"]).select(*columns), "grown")
        drop(before, numbered)
        n = grown.count()
        if not n:
            break
        n_nodes += n
        nodes = store.add(grown)
        before, alive = alive, reassigned(alive, nodes, grown, influence, kill, params, n_nodes <= FEW)
        drop(before)
    return nodes.drop("px", "py", "pz")


def too_close(nodes: DataFrame, least: float, longest: float) -> DataFrame:
    """Edges that lie nearer than least to one of another tree: empty after grow()."""
    e = edges(nodes)
    return edge_conflicts(e, e, least, longest)
