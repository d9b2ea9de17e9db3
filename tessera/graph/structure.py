"""Strongly connected components and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph.components import connected_components
from tessera.session import discard, keep


def _reach_least(edges: DataFrame, nodes: DataFrame, salt: int) -> DataFrame:
    """node, low: of the nodes that reach each node, itself included, the one of the least hash, as a struct of hash and node.

    Each round takes the least of a node's own, its predecessors', and that of the node its own is named by: whoever reaches that one
    reaches this one too. As the order is random, the stretch of a way that a node has seen grows by a factor each round, whichever way ids run along it. It ends
    when nothing moves.
    """
    low = keep(nodes.select("node", F.struct(F.xxhash64("node", F.lit(salt)).alias("h"), F.col("node").alias("n")).alias("low")), "low")
    while True:
        pushed = edges.join(low, edges["src"] == low["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("low").alias("new"))
        jumped = low.select("node", F.col("low.n").alias("at")).join(low.select(F.col("node").alias("at"), F.col("low").alias("far")), "at").select("node", "far")
        both = low.join(pushed, "node", "left").join(jumped, "node", "left")
        least = F.least("low", F.coalesce("new", "low"), F.coalesce("far", "low"))
        new = keep(both.select("node", least.alias("low"), (least < F.col("low")).alias("moved")), "low")
        discard(low)
        low, done = new.drop("moved"), new.where("moved").isEmpty()
        low._kept_at = new._kept_at
        if done:
            return low


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component of nodes on a cycle; a component is named by its smallest node.

    Every node learns which node of the least hash reaches it, and which it reaches. If they are one, the node is in that one's component and done. Else it
    can share a component only with nodes that learned the same two, so all other edges go, and the rest is asked again in another random order. Each round splits
    what is left, ways as well as cycles, in stretches of a part of their length: rounds, and steps in a round, grow with the logarithm of the longest way, and nothing is
    trimmed node by node.
    """
    every = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    loops = every.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    rest, found, salt = keep(every.where("src <> dst"), "rest"), [], 0
    while not rest.isEmpty():
        nodes = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        ahead, back = _reach_least(rest, nodes, salt), _reach_least(rest.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes, salt)
        both = keep(ahead.select("node", F.col("low.n").alias("f")).join(back.select("node", F.col("low.n").alias("b")), "node"), "both")
        found.append(both.where("f = b").select("node", F.col("f").alias("root")))
        open_ = both.where("f <> b")
        x, y = open_.select(F.col("node").alias("src"), F.col("f").alias("xf"), F.col("b").alias("xb")), open_.select(F.col("node").alias("dst"), F.col("f").alias("yf"), F.col("b").alias("yb"))
        old, rest = rest, keep(rest.join(x, "src").join(y, "dst").where("xf = yf AND xb = yb").select("src", "dst"), "rest")
        discard(old, ahead, back)
        salt += 1
    if not found:
        return loops
    members = found[0]
    for part in found[1:]:
        members = members.unionByName(part)
    named = members.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    sized = members.join(named, "root").select("node", "component")
    return sized.unionByName(loops.join(sized.select("node"), "node", "left_anti"))


def _offers(graph: DataFrame, label: DataFrame, total: float, least: float) -> DataFrame:
    """node, own, degree, volume (of its own community), inside (weight to it), target: the community where a node gains most modularity, null where it gains none.

    What meets a node is dealt by node once, and all that follows stays where it lies. Rounds are many, so no table goes through the driver in one.
    """
    volume = label.groupBy("community").agg(F.sum("degree").alias("volume"))
    mine = label.join(volume.hint("shuffle_hash"), "community").select("node", "community", "degree", "volume")
    other = mine.select(F.col("node").alias("dst"), "community", F.col("volume").alias("there"))
    links = graph.where("src <> dst").join(other.hint("shuffle_hash"), "dst").select(F.col("src").alias("node"), "community", "there", "w").repartition("node")
    to = links.groupBy("node", "community").agg(F.sum("w").alias("to"), F.first("there").alias("there"))
    here = F.col("community") == F.col("own")
    gain = F.round(F.col("to") - F.col("degree") * (F.col("there") - F.when(here, F.col("degree")).otherwise(0.0)) / total, 9)
    told = mine.withColumnRenamed("community", "own").join(to.hint("shuffle_hash"), "node", "left")
    best = told.groupBy("node").agg(*(F.first(c).alias(c) for c in ("own", "degree", "volume")), F.min(F.when(F.col("to").isNotNull(), F.struct((-gain).alias("loss"), "community"))).alias("best"), F.max(F.when(here, gain)).alias("stay"), F.sum(F.when(here, F.col("to"))).alias("inside"))
    # alone, a node gains nothing by staying
    more = -F.col("best.loss") - F.coalesce("stay", F.round(-F.col("degree") * (F.col("volume") - F.col("degree")) / total, 9))
    return best.select("node", "own", "degree", "volume", F.coalesce("inside", F.lit(0.0)).alias("inside"), F.when(more > least, F.col("best.community")).alias("target"), more.alias("gain"))


#: A level is done when the rounds of both halves add less than this part of what the level has added: what is left is had sooner from the next level, whose nodes are this one's communities.
SMALL = 0.001


def _settled(graph: DataFrame, label: DataFrame, total: float) -> tuple[DataFrame, bool]:
    """node, community after moves that raise modularity, and whether there was any.

    Offers of one hashed half are taken at once, then those of the other. As moves that meet in a community can spoil each other, modularity is measured after each
    round; where it did not rise, the round is undone, and of the offers only those are taken that are the best of both communities they touch:
    these add up exactly. So modularity rises with every round that stays. A level of which nothing moves is one where no node gains.
    """
    least, last, before, first, turn, exact, small = 1e-9 * total, None, None, None, 0, False, 0
    while True:
        told = keep(_offers(graph, label, total, least), "offers")
        # the squares of the communities' volumes, node by node
        at = told.agg(F.coalesce(F.sum("inside"), F.lit(0.0)).alias("i"), F.coalesce(F.sum(F.col("degree") * F.col("volume")), F.lit(0.0)).alias("vv"), F.count("target").alias("n")).first()
        now = at.i - at.vv / total
        first = now if first is None else first
        if before is not None and not exact and now <= before + least:
            discard(told, tidy=False)
            told, exact = last, True
        else:
            discard(*([last] if last is not None else []), tidy=False)
            # both halves have to add little
            small = small + 1 if before is not None and now - before < SMALL * (now - first) else 0
            last, before, exact = told, now, False
            if not at.n or small > 1:
                return told.select("node", F.col("own").alias("community")), now > first
        open_ = F.col("target").isNotNull()
        if exact:
            rank = F.struct("gain", F.xxhash64("node", F.lit(turn)).alias("h"), "node")
            asked = told.where(open_).withColumn("rank", rank)
            best = asked.select(F.explode(F.array("own", "target")).alias("c"), "rank").groupBy("c").agg(F.max("rank").alias("top"))
            won = asked.join(best.select(F.col("c").alias("own"), F.col("top").alias("t1")), "own").join(best.select(F.col("c").alias("target"), F.col("top").alias("t2")), "target").where("rank = t1 AND rank = t2")
            moved = told.join(won.select("node", F.lit(True).alias("go")), "node", "left")
        else:
            moved = told.withColumn("go", open_ & (F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2))
        label = moved.select("node", F.when(F.col("go"), F.col("target")).otherwise(F.col("own")).alias("community"), "degree")
        turn += 1


def _merged(graph: DataFrame, label: DataFrame) -> DataFrame:
    """The graph of which the communities (node, next) are the nodes."""
    a, b = label.select(F.col("node").alias("src"), F.col("next").alias("ca")), label.select(F.col("node").alias("dst"), F.col("next").alias("cb"))
    return keep(graph.join(a.hint("shuffle_hash"), "src").join(b.hint("shuffle_hash"), "dst").groupBy(F.col("ca").alias("src"), F.col("cb").alias("dst")).agg(F.sum("w").alias("w")), "louvain")


def communities(edges: DataFrame) -> DataFrame:
    """node, community: weighted modularity moves in the manner of Louvain, on all nodes at once, until nothing gains.

    At each level nodes move while modularity rises noticeably, and communities are the nodes of the next level; the last level is the one where no node gains by a move (by
    a billionth of all weight at least), so no two communities gain by merging. Communities that have come apart are then split into their connected parts, which raises modularity too, and levels
    are added on top of the parts, until none changes: there is no cap on levels or rounds.
    Every community is connected. Deterministic: ties go to the smaller community, which in the end is named by its smallest node. Null ends and
    loops are ignored; repeated edges add their weights.
    """
    base = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("weight") if "weight" in edges.columns else F.lit(1.0)).cast("double").alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    base = keep(base, "links")
    # numbers in the order of nodes: rounds join and sort by them, whatever nodes are named
    named = keep(base.select(F.col("a").alias("name")).union(base.select("b")).distinct().repartitionByRange("name").sortWithinPartitions("name").select("name", F.monotonically_increasing_id().alias("node")), "names")
    a, b = (named.select(F.col("name").alias(c), F.col("node").alias(n)).hint("shuffle_hash") for c, n in (("a", "src"), ("b", "dst")))
    once = keep(base.join(a, "a").join(b, "b").select("src", "dst", "w"), "links")
    whole = keep(once.union(once.select("dst", "src", "w")), "louvain")
    discard(base, once, tidy=False)
    total = whole.agg(F.sum("w").alias("t")).first().t or 1.0
    graph, members = whole, keep(named.select("node", F.col("node").alias("community")), "members")
    while True:
        degree = keep(graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree")), "degree")
        found, any_move = _settled(graph, degree.select("node", F.col("node").alias("community"), "degree"), total)
        above, old = graph, members
        if any_move:
            label = found.withColumnRenamed("community", "next")
            members = keep(members.join(label.select(F.col("node").alias("community"), "next"), "community").select("node", F.col("next").alias("community")), "members")
            graph = _merged(graph, label)
        else:
            a, b = members.select(F.col("node").alias("src"), F.col("community").alias("ca")), members.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
            part = keep(connected_components(whole.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst")), "part")
            label = keep(members.select("node", "community").join(part, "node", "left").select("node", "community", F.coalesce("component", "node").alias("next")), "label")
            if label.groupBy("community").agg(F.min("next").alias("x"), F.max("next").alias("y")).where("x <> y").isEmpty():
                lead = named.select(F.col("node").alias("next"), F.col("name").alias("community"))
                return label.select("node", "next").join(named.hint("shuffle_hash"), "node").join(lead.hint("shuffle_hash"), "next").select(F.col("name").alias("node"), "community")
            members = label.select("node", F.col("next").alias("community"))
            members._kept_at = label._kept_at
            graph = _merged(whole, label)
        discard(degree, old, *([above] if above is not whole else []))


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """How much denser the communities are than chance."""
    w = (F.col("weight") if "weight" in edges.columns else F.lit(1.0)).alias("w")
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w)
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(pairs.select("b", "a", "w"))
    m = both.agg(F.sum("w").alias("t")).first().t or 1.0
    a, b = members.select(F.col("node").alias("src"), F.col("community").alias("ca")), members.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    joined = both.join(a, "src").join(b, "dst")
    inside = joined.where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("x")).first().x
    squares = joined.groupBy("ca").agg(F.sum("w").alias("v")).agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("x")).first().x
    return inside / m - squares / (m * m)
