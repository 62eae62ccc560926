"""Signed weighted graphs and symbol graphs: degrees, paths, ranking, motifs, propagation.

A graph is a DataFrame of edges (src, dst, weight, cls). Traversals are frontier joins:
each hop shuffles the frontier and the edges by node, and what has been visited is left
out by an anti join, so work follows the edges reached. Nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewright.session import materialize

#: Edge classes in the order of their numbers, and their signs. Fixed values.
CLASSES = ("gaba", "ach", "glut", "oct", "ser", "da")
SIGNS = {"gaba": -1, "ach": 1, "glut": 1, "oct": 0, "ser": 0, "da": 0}


def sign(cls: Column) -> Column:
    out = F.lit(0)
    for i, name in enumerate(CLASSES):
        if SIGNS[name]:
            out = F.when(cls == i, SIGNS[name]).otherwise(out)
    return out


def signed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("signed_weight", F.col("weight") * sign(F.col("cls")))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, out_mass, in_mass) of every node that has an edge."""
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"), F.sum("weight").alias("out_mass"))
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"), F.sum("weight").alias("in_mass"))
    z = F.lit(0).cast("bigint")
    return o.join(i, "id", "full_outer").select("id", *[F.coalesce(c, z).alias(c) for c in ("out_degree", "in_degree", "out_mass", "in_mass")])


def class_mass(edges: DataFrame) -> DataFrame:
    return edges.groupBy("cls").agg(F.count("*").alias("edges"), F.sum("weight").alias("mass"), F.sum(F.col("weight") * sign(F.col("cls"))).alias("signed_mass"))


def rotor(edges: DataFrame) -> DataFrame:
    """(a, b, j): circulation J = A - A^T of signed weights over unordered pairs a < b, where not 0."""
    s = signed(edges).where("src != dst")
    up = F.col("src") < F.col("dst")
    one = s.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(up, F.col("signed_weight")).otherwise(-F.col("signed_weight")).alias("j"))
    return one.groupBy("a", "b").agg(F.sum("j").alias("j")).where("j != 0")


def rotor_top(edges: DataFrame, k: int) -> DataFrame:
    """The k strongest circulations as (src, dst, j > 0)."""
    r = rotor(edges).select(F.when(F.col("j") > 0, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("j") > 0, F.col("b")).otherwise(F.col("a")).alias("dst"), F.abs("j").alias("j"))
    return r.orderBy(F.desc("j"), "src", "dst").limit(k)


def neighbours(edges: DataFrame, node: str, limit: int) -> DataFrame:
    """A node's partners, heaviest first, ties by id."""
    return edges.where(F.col("src") == node).select(F.col("dst").alias("id"), "weight").orderBy(F.desc("weight"), "id").limit(limit)


def k_hop(edges: DataFrame, starts: DataFrame, k: int, want: int | None = None, both: bool = False) -> DataFrame:
    """(id, depth) of the nodes within k hops of `starts` (id), the least depth for each."""
    e = edges if want is None else edges.where(sign(F.col("cls")) == want)
    e = e.select("src", "dst").distinct()
    if both:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    if k > 1:
        e = materialize(e, "arcs")
    seen = starts.select("id", F.lit(0).alias("depth")).distinct()
    frontier = seen.select("id")
    for hop in range(1, k + 1):
        nxt = frontier.join(e, frontier["id"] == e["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        if hop < k:  # else each hop would be made again by all that follow
            nxt = materialize(nxt, "frontier")
        seen = seen.unionByName(nxt.select("id", F.lit(hop).alias("depth")))
        frontier = nxt
    return seen


def frontier_sizes(edges: DataFrame, starts: DataFrame, k: int, want: int | None = None) -> DataFrame:
    return k_hop(edges, starts, k, want).where("depth > 0").groupBy("depth").agg(F.count("*").alias("nodes"))


def weighted_k_hop(edges: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """(src, dst, depth, strength): edges reached within k hops, at weight * 0.5^depth of their source."""
    near = k_hop(edges, starts, k - 1)
    j = edges.join(near, edges["src"] == near["id"])
    return j.select("src", "dst", "depth", (F.col("weight") * F.pow(F.lit(0.5), "depth")).alias("strength"))


def shortest_path_length(edges: DataFrame, src: str, dst: str, limit: int) -> DataFrame:
    """(src, dst, hops): the least number of hops, no row beyond `limit`."""
    spark = edges.sparkSession
    seen = k_hop(edges, spark.createDataFrame([(src,)], "id string"), limit)
    return seen.where(F.col("id") == dst).select(F.lit(src).alias("src"), F.col("id").alias("dst"), F.col("depth").alias("hops"))


def shortest_path(edges: DataFrame, src: str, dst: str, limit: int) -> DataFrame:
    """(hop, id): the nodes of a shortest path from `src` to `dst`, no row where none has `limit` hops or
    fewer. Of several, the one whose nodes are the least, looked at from its end.

    The levels of the search are kept; from the end the path goes back through them, so at
    most one node a level comes to the driver.
    """
    spark = edges.sparkSession
    e = materialize(edges.select("src", "dst").distinct(), "arcs")
    level = materialize(k_hop(e, spark.createDataFrame([(src,)], "id string"), limit), "levels")
    end = level.where(F.col("id") == dst).first()
    path = [] if end is None else [(end["depth"], dst)]
    while path and path[-1][0] > 0:
        depth, node = path[-1]
        before = e.where(F.col("dst") == node).join(level.where(F.col("depth") == depth - 1), F.col("src") == F.col("id")).agg(F.min("src")).first()[0]
        path.append((depth - 1, before))
    return spark.createDataFrame(path[::-1], "hop int, id string")


def common_partners(edges: DataFrame, nodes: list[str]) -> DataFrame:
    """(id, mass): nodes that all of `nodes` (up to 32) point to, with the sum of the weights."""
    if len(set(nodes)) > 32:
        raise ValueError("at most 32 nodes")
    e = edges.where(F.col("src").isin(sorted(set(nodes))))
    return e.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n"), F.sum("weight").alias("mass")).where(F.col("n") == len(set(nodes))).select("id", "mass")


def weighted_page_rank(nodes: DataFrame, edges: DataFrame, iterations: int, damping: float = 0.85, want: int | None = None, tolerance: float | None = None) -> DataFrame:
    """(id, rank): start 1/n, weights of signed edges, the mass of nodes without outgoing
    edges spread evenly; damping is kept within 0.05 and 0.99. With a `tolerance` the rounds
    end before `iterations` once the ranks change by less in sum."""
    d = min(max(damping, 0.05), 0.99)
    e = signed(edges).where("signed_weight != 0")
    if want is not None:
        e = e.where(F.signum("signed_weight") == want)
    e = materialize(e.groupBy("src", "dst").agg(F.sum(F.abs("signed_weight")).alias("w")), "arcs")
    out = e.groupBy("src").agg(F.sum("w").alias("out"))
    link = materialize(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p")), "links")
    size = nodes.agg(F.count("*").alias("n"))
    node = materialize(nodes.join(out, nodes["id"] == out["src"], "left").crossJoin(F.broadcast(size)).select("id", F.col("out").isNull().alias("sink"), "n"), "nodes")
    rank = node.select("id", "sink", (1.0 / F.col("n")).alias("rank"))
    for i in range(iterations):
        loose = rank.where("sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        flow = link.join(rank.select("id", "rank"), link["src"] == rank["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("flow"))
        j = node.join(flow, node["id"] == flow["dst"], "left").crossJoin(F.broadcast(loose))
        was, rank = rank, j.select("id", "sink", ((1 - d) / F.col("n") + d * F.coalesce("flow", F.lit(0.0)) + d * F.col("loose") / F.col("n")).alias("rank"))
        if i < iterations - 1 or tolerance is not None:  # a round reads the ranks twice
            rank = materialize(rank, "rank")
        if tolerance is not None:
            moved = rank.join(was.select("id", F.col("rank").alias("was")), "id").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
            if moved < tolerance:
                break
    return rank.select("id", "rank")


def propagate(edges: DataFrame, seeds: DataFrame, steps: int, gamma: float = 0.5, leak: float = 0.9) -> DataFrame:
    """(id, x) after `steps` of x <- leak x + gamma A x over signed weights, seeds at 1, kept within 1e15."""
    e = signed(edges).where("signed_weight != 0").groupBy("src", "dst").agg(F.sum("signed_weight").alias("w"))
    if steps > 1:
        e = materialize(e, "arcs")
    x = seeds.select("id", F.lit(1.0).alias("x")).distinct()
    for i in range(steps):
        push = x.join(e, x["id"] == e["src"]).select(F.col("dst").alias("id"), (gamma * F.col("x") * F.col("w")).alias("x"))
        keep = x.select("id", (leak * F.col("x")).alias("x"))
        x = keep.unionByName(push).groupBy("id").agg(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), F.sum("x"))).alias("x"))
        if i % 3 == 2 and i < steps - 1:
            x = materialize(x, "signal")
    return x


def motifs(edges: DataFrame) -> DataFrame:
    """(id, reciprocal, feedforward, feedback3) for every node with outgoing edges: pairs u <-> v,
    triangles u -> v -> w with u -> w, and rings u -> v -> w -> u.

    Triangles are found from the pairs u -> v by joining v's edges and testing the closing
    edge; the pair list is salted by v's edges through the adaptive skew join.
    """
    e = materialize(edges.where("src != dst").select("src", "dst").distinct(), "arcs")
    a = e.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    b = e.select(F.col("src").alias("v"), F.col("dst").alias("w"))
    back = e.select(F.col("src").alias("v"), F.col("dst").alias("u"))
    rec = a.join(back, ["u", "v"], "left_semi").groupBy("u").agg(F.count("*").alias("reciprocal"))
    two = a.join(b, "v").where("w != u and w != v")
    ff = two.join(e.select(F.col("src").alias("u"), F.col("dst").alias("w")), ["u", "w"], "left_semi").groupBy("u").agg(F.count("*").alias("feedforward"))
    fb = two.join(e.select(F.col("dst").alias("u"), F.col("src").alias("w")), ["u", "w"], "left_semi").groupBy("u").agg(F.count("*").alias("feedback3"))
    nodes = a.select("u").distinct()
    z = F.lit(0).cast("bigint")
    j = nodes.join(rec, "u", "left").join(ff, "u", "left").join(fb, "u", "left")
    return j.select(F.col("u").alias("id"), *[F.coalesce(c, z).alias(c) for c in ("reciprocal", "feedforward", "feedback3")])


def danger(files: Column) -> Column:
    """Danger of a change by the number of files it reaches."""
    return F.when(files == 0, "LOW").when(files <= 3, "MEDIUM").when(files <= 10, "HIGH").otherwise("CRITICAL")


def impact(calls: DataFrame, symbols: DataFrame, depth: int) -> DataFrame:
    """(symbol, callers, files, danger): what calls each of `symbols` (id), directly or through others."""
    e = materialize(calls.where("src is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), "arcs")
    starts = symbols.select("id")
    reach = starts.select(F.col("id").alias("root"), F.col("id"), F.lit(0).alias("depth"))
    frontier = reach.select("root", "id")
    for hop in range(1, depth + 1):
        nxt = frontier.join(e, frontier["id"] == e["src"]).select("root", F.col("dst").alias("id")).distinct().join(reach.select("root", "id"), ["root", "id"], "left_anti")
        nxt = materialize(nxt, "reach")
        reach = reach.unionByName(nxt.withColumn("depth", F.lit(hop)))
        frontier = nxt
    up = reach.where("depth > 0").groupBy("root").agg(F.count("*").alias("callers"))
    whom = reach.select("root", F.col("id").alias("callee")).distinct()
    sites = calls.select(F.col("dst").alias("callee"), "file").distinct()
    files = whom.where("callee is not null").join(sites, "callee").groupBy("root").agg(F.countDistinct("file").alias("files"))
    z = F.lit(0).cast("bigint")
    j = starts.join(up, F.col("id") == up["root"], "left").drop("root").join(files, F.col("id") == files["root"], "left").drop("root")
    n = F.coalesce("files", z)
    return j.select(F.col("id").alias("symbol"), F.coalesce("callers", z).alias("callers"), n.alias("files"), danger(n).alias("danger"))


def reached(arcs: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, id, depth): what each of `roots` (id) reaches over `arcs` (src, dst) within `depth` hops, itself at 0."""
    e = materialize(arcs.where("src is not null and dst is not null").select("src", "dst").distinct(), "arcs")
    seen = frontier = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct()
    for hop in range(1, depth + 1):
        nxt = frontier.join(e, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id")).distinct().join(seen, ["root", "id"], "left_anti")
        frontier = materialize(nxt.select("root", "id", F.lit(hop).alias("depth")), "reach")
        seen = seen.unionByName(frontier)
    return seen


def passport(calls: DataFrame, symbols: DataFrame, depth: int) -> DataFrame:
    """(symbol, upstream, downstream, files, files_below, danger): for each of `symbols` (id) how many functions
    call it and how many it calls, directly or through others within `depth` hops, and in how
    many files either happens; `calls` has src, dst and file. The danger is that of all files."""
    down = reached(calls.select("src", "dst"), symbols, depth)
    up = reached(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")), symbols, depth)
    sites = calls.where("src is not null and dst is not null").select("src", "dst", "file").distinct()
    above = up.where(F.col("depth") < depth).select("root", F.col("id").alias("dst")).join(sites, "dst").select("root", "file")
    below = down.where(F.col("depth") < depth).select("root", F.col("id").alias("src")).join(sites, "src").select("root", "file")
    far = lambda r, name: r.where("depth > 0").groupBy("root").agg(F.count("*").alias(name))
    both = above.withColumn("up", F.lit(1)).unionByName(below.withColumn("up", F.lit(0)))
    files = both.groupBy("root", "file").agg(F.max("up").alias("up"), F.min("up").alias("low")).groupBy("root").agg(F.sum("up").alias("files"), F.sum(1 - F.col("low")).alias("files_below"), F.count("*").alias("all_files"))
    j = symbols.select(F.col("id").alias("root")).distinct().join(far(up, "upstream"), "root", "left").join(far(down, "downstream"), "root", "left").join(files, "root", "left")
    z = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return j.select(F.col("root").alias("symbol"), z("upstream").alias("upstream"), z("downstream").alias("downstream"), z("files").alias("files"), z("files_below").alias("files_below"), danger(z("all_files")).alias("danger"))


def dedup_triples(triples: DataFrame) -> DataFrame:
    """Distinct (s, p, o), the display name of each entity being its most capitalised spelling."""
    ent = triples.select(F.col("s").alias("name")).unionByName(triples.select(F.col("o").alias("name"))).where("name is not null")
    cap = F.length(F.regexp_replace("name", r"[^\p{Lu}]", ""))
    shown = ent.groupBy(F.lower("name").alias("k")).agg(F.max(F.struct(cap.alias("c"), F.col("name").alias("n")))["n"].alias("shown"))
    t = triples.select(F.lower("s").alias("s"), "p", F.lower("o").alias("o")).distinct()
    a = shown.select(F.col("k").alias("s"), F.col("shown").alias("s_name"))
    b = shown.select(F.col("k").alias("o"), F.col("shown").alias("o_name"))
    return t.join(a, "s").join(b, "o").select(F.col("s_name").alias("s"), "p", F.col("o_name").alias("o"))


def nexus(defs: DataFrame) -> DataFrame:
    """Symbols defined in more than one language or file, with their places."""
    g = defs.groupBy("symbol").agg(F.countDistinct("lang").alias("langs"), F.countDistinct("file").alias("files"), F.count("*").alias("places"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("lang_list"))
    return g.where("langs > 1 or files > 1")


def sql_export(edges: DataFrame, name: str = "edge") -> DataFrame:
    """(line): an INSERT statement for each edge (src, dst, weight), quotes doubled, for a text sink."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'"))
    return edges.select(F.concat(F.lit(f"INSERT INTO {name} (src, dst, weight) VALUES ("), quoted("src"), F.lit(", "), quoted("dst"), F.lit(", "), F.col("weight").cast("string"), F.lit(");")).alias("line"))
