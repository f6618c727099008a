"""Parent-child rows to full hierarchies by tree contraction.

Every round rakes the leaves (nodes that no active node names as parent) and splices out unary-chain nodes chosen by coin,
and records each removal with the parent it had at that time, its distance and its piece of path. A tree of any depth is
gone after a number of rounds that grows with the logarithm of its size; what never goes is a node that has become
its own parent: the core of a cycle. The records are then read back, last round first: whoever a node was recorded against is
already resolved, so root, depth, path and kind follow by one join a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import drop, stage


def resolve_hierarchy(df: DataFrame, id: str = "id", parent: str = "parent_id", name: str = "name", max_rounds: int = 400) -> DataFrame:
    """One row per id: (id, parent_id, name, kind, root_id, depth, path, id_path).

    kind: `tree` (reaches a root), `cycle` (own ancestor), `below_cycle`, `orphan` (its chain ends at a parent that no row
    is). depth is the number of parents on the chain; root_id, path (names from the root, joined by '/', a null name as
    empty) and id_path (ids from the top of the chain down to the node) are null for cycle and below_cycle. For an orphan they
    start at the highest existing ancestor and root_id is null.

    Rows without id are no nodes. Rows that came in twice count once; if an id has several parents or names, the smallest
    row (parent, then name; nulls last) holds. An empty table gives an empty result; other columns are ignored.
    """
    src = df.select(F.col(id).alias("id"), F.col(parent).alias("p"), F.col(name).alias("nm")).where("id is not null")
    nodes = src.groupBy("id").agg(F.min(F.struct(F.col("p").isNull().alias("n"), "p", F.col("nm").isNull().alias("m"), "nm")).alias("s")).select("id", "s.p", "s.nm")
    nodes = stage(nodes, "nodes")
    known = nodes.select(F.col("id").alias("k"))
    j = nodes.join(known, nodes.p == known.k, "left")
    # top: the chain ends here, at a root or at a missing parent
    act = stage(
        j.select(
            "id",
            F.when(F.col("k").isNotNull(), F.col("p")).alias("up"),
            F.when(F.col("p").isNull(), "tree").when(F.col("k").isNull(), "orphan").alias("top"),
            F.lit(1).alias("d"),
            F.array(F.coalesce("nm", F.lit(""))).alias("seg"),
            F.array("id").alias("ids"),
        ),
        "active",
    )
    logs = []
    for k in range(max_rounds):
        kids = act.where("up is not null").groupBy("up").agg(F.count("*").alias("c"), F.min("id").alias("kid"))
        s = act.join(kids.withColumnRenamed("up", "pid"), F.col("id") == F.col("pid"), "left")
        coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(k)), F.lit(2)) == 1
        s = s.withColumn("leaf", F.col("pid").isNull() & F.col("up").isNotNull())
        # the child's coin is 0 and the node's 1, so two neighbours are never spliced in one round
        s = s.withColumn("cut", (F.coalesce("c", F.lit(0)) == 1) & F.col("up").isNotNull() & (F.col("up") != F.col("id")) & coin("id") & ~F.coalesce(coin("kid"), F.lit(True)))
        s = stage(s.select("id", "up", "top", "d", "seg", "ids", "leaf", "cut", "kid"), "round")
        n = s.agg(F.count(F.when(F.col("leaf") | F.col("cut"), 1)).alias("gone"), F.count(F.when(F.col("up").isNotNull() & (F.col("up") != F.col("id")), 1)).alias("left")).first()
        drop(act)
        if n.gone == 0 and n.left == 0:
            act = s.select("id", "up", "top", "d", "seg", "ids")
            break
        # a cut node has one child, so it is joined by the child's id: the children of a hub never meet in one task
        cut = s.where("cut").select(F.col("kid").alias("x"), F.col("up").alias("xup"), F.col("d").alias("xd"), F.col("seg").alias("xseg"), F.col("ids").alias("xids"))
        rest = s.where("not cut").drop("kid").join(cut, F.col("id") == F.col("x"), "left")
        spliced = stage(
            rest.select(
                "id",
                F.coalesce("xup", "up").alias("up"),
                "top",
                (F.col("d") + F.coalesce("xd", F.lit(0))).alias("d"),
                F.when(F.col("x").isNull(), F.col("seg")).otherwise(F.concat("xseg", "seg")).alias("seg"),
                F.when(F.col("x").isNull(), F.col("ids")).otherwise(F.concat("xids", "ids")).alias("ids"),
                "leaf",
            ),
            "active",
        )
        if n.gone:
            cols = ["id", "up", "d", "seg", "ids"]
            logs.append(spliced.where("leaf").select(*cols, F.lit(None).cast(s.schema["kid"].dataType).alias("kid")).unionByName(s.where("cut").select(*cols, "kid")))
        act = spliced.where("not leaf").drop("leaf")
    else:
        raise RuntimeError("the hierarchy did not contract")

    # what is left: the tops of the chains, and cores of cycles that are their own parent
    cyc = F.col("top").isNull()
    known = act.select(
        "id",
        F.when(cyc, "cycle").otherwise(F.col("top")).alias("kind"),
        F.when(F.col("top") == "tree", F.col("id")).alias("root_id"),
        F.when(~cyc, F.lit(0)).alias("depth"),
        F.when(~cyc, F.col("seg")).alias("names"),
        F.when(~cyc, F.col("ids")).alias("id_path"),
    )
    # Records are read back last first; whoever one names is resolved by then. Each round at least doubles what is known or
    # nearly so, hence writing it anew each time costs no more than a few passes over all nodes.
    for log in reversed(logs):
        u = known.select(*[F.col(c).alias(f"u_{c}") for c in known.columns])
        c = known.select(F.col("id").alias("c_id"), F.col("kind").alias("c_kind"))
        r = log.join(u, F.col("up") == F.col("u_id")).join(c, F.col("kid") == F.col("c_id"), "left")
        bad = F.col("u_kind").isin("cycle", "below_cycle")
        out = r.select(
            "id",
            F.when(F.col("c_kind") == "cycle", "cycle").when(bad, "below_cycle").otherwise(F.col("u_kind")).alias("kind"),
            F.col("u_root_id").alias("root_id"),
            F.when(~bad, F.col("u_depth") + F.col("d")).alias("depth"),
            F.when(~bad, F.concat("u_names", "seg")).alias("names"),
            F.when(~bad, F.concat("u_id_path", "ids")).alias("id_path"),
        )
        new = stage(known.unionByName(out), "known")
        drop(known)
        known = new
    res = known
    return res.join(nodes, "id").select(
        "id", F.col("p").alias("parent_id"), F.col("nm").alias("name"), "kind", "root_id", "depth", F.array_join("names", "/").alias("path"), "id_path"
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) for every node of a resolved hierarchy that reaches an end, from its id_path."""
    e = resolved.where("id_path is not null").select(F.col("id").alias("descendant_id"), "depth", F.posexplode("id_path").alias("pos", "ancestor_id"))
    return e.where("ancestor_id <> descendant_id").select("ancestor_id", "descendant_id", (F.col("depth") - F.col("pos")).alias("distance"))


def with_descendants(resolved: DataFrame) -> DataFrame:
    """Adds descendants, the number of nodes below each node (null on cycles and below them)."""
    n = descendants(resolved).groupBy("ancestor_id").agg(F.count("*").alias("_n"))
    return (
        resolved.join(n, resolved.id == n.ancestor_id, "left")
        .withColumn("descendants", F.when(F.col("id_path").isNotNull(), F.coalesce("_n", F.lit(0))))
        .drop("ancestor_id", "_n")
    )


def hierarchy_faults(df: DataFrame, id: str = "id", parent: str = "parent_id", name: str = "name", lvl: str = "lvl") -> DataFrame:
    """(id, kind) of every node that lies on or below a cycle, ends at a missing parent, or whose stored level is null or wrong.

    If rows of one id store several levels, `lvl` holds if any of them is null or wrong. Each id once.
    """
    r = resolve_hierarchy(df, id, parent, name)
    stored = df.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("sid")).agg(F.min(F.coalesce(F.col(lvl), F.lit(-1))).alias("lo"), F.max(F.coalesce(F.col(lvl), F.lit(-1))).alias("hi"))
    j = r.join(stored, F.col("id") == F.col("sid"))
    kind = F.when(F.col("kind") != "tree", F.col("kind")).when((F.col("lo") != F.col("depth")) | (F.col("hi") != F.col("depth")), "lvl")
    return j.select("id", kind.alias("kind")).where("kind is not null")
