"""Centralities, communities, modularity and link prediction.

Betweenness, PageRank and label propagation never cross a connected component (PageRank's share of the isolated
nodes' mass is the same for all, and follows from two counts), so components are worked on in parallel. Of one with more than
max_nodes nodes the nodes with a single neighbour are folded: those of one neighbour, on one side of it in order, have one rank
and one label, so they are one node that counts many times. Trees hang from the rest, and what they add to betweenness follows
from their sizes. A component that is small once folded is gathered after all. One that isn't iterates over DataFrames. There the
number of pivots chooses: with None betweenness searches from every node that is left without trees and communities take turns,
which gives at every size what a gathered component gives, at a cost of such nodes times edges; with a number betweenness is
estimated from so many nodes and communities come from synchronous rounds, and the column exact is false.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, cut, discard, numbered

DAMPING, ROUNDS, SWEEPS, MAX_NODES, MAX_EDGES = 0.85, 60, 20, 5_000, 200_000
#: Rounds in which the outermost nodes of trees are taken off where a component isn't gathered; deeper trees stay in the core.
PEELS = 64


def uniform_share(n: int, isolated: int, rounds: int = ROUNDS, damping: float = DAMPING) -> list[float]:
    """What every node gets in each round: the jump's share and its part of the isolated nodes' mass."""
    rank, out = 1.0 / n, []
    for _ in range(rounds):
        rank = (1 - damping) / n + damping * isolated * rank / n
        out.append(rank)
    return out


def adjacency_rows(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours as compressed rows: those of node v are ends[starts[v] : starts[v + 1]]."""
    tail, head = np.r_[a, b].astype(np.int64), np.r_[b, a].astype(np.int64)
    return np.r_[0, np.cumsum(np.bincount(tail, minlength=n))], head[np.argsort(tail, kind="stable")]


def betweenness(starts: np.ndarray, ends: np.ndarray, at_once: int = 1 << 22, weight: np.ndarray | None = None) -> np.ndarray:
    """Shortest-path betweenness of an undirected graph, each pair of ends counted once, or by the product of its weights.

    Many sources are searched together: a state is a node seen from a source, and one step takes all states of a level over
    all their edges. The steps' edges are kept, and dependencies flow back over them level by level.
    """
    n = len(starts) - 1
    total, width = np.zeros(n), max(1, at_once // max(1, n + len(ends)))
    weight = np.ones(n) if weight is None else weight
    for lo in range(0, n, width):
        k = min(n, lo + width) - lo
        roots = np.arange(lo, lo + k) * k + np.arange(k)
        met, paths, steps = np.zeros(n * k, bool), np.zeros(n * k), []
        level, met[roots], paths[roots] = roots, True, 1.0
        while len(level):
            node, source = np.divmod(level, k)
            degree = starts[node + 1] - starts[node]
            shift = np.repeat(starts[node] - np.r_[0, np.cumsum(degree)[:-1]], degree)
            there = ends[shift + np.arange(degree.sum())] * k + np.repeat(source, degree)
            new = ~met[there]
            here, there = np.repeat(level, degree)[new], there[new]
            np.add.at(paths, there, paths[here])
            steps.append((here, there))
            level = np.unique(there)
            met[level] = True
        flow = np.zeros(n * k)
        for here, there in reversed(steps):
            np.add.at(flow, here, (weight[there // k] + flow[there]) * paths[here] / paths[there])
        flow[roots] = 0
        total += flow.reshape(n, k) @ weight[lo : lo + k]
    return total / 2


def brokerage(starts: np.ndarray, ends: np.ndarray, size: np.ndarray, squares: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Betweenness of nodes that stand for size nodes each, themselves and trees hanging from them whose sizes have the squares'
    sum; those of size 0 are folded into a neighbour. Where there are several components, whole has the size of each node's.

    Trees are taken off from the outside. A pair with an end in a node's trees passes it unless both ends are in one of them;
    other pairs meet it only on ways through the core that has no trees left.
    """
    tail, on = np.repeat(np.arange(len(size)), np.diff(starts)), size > 0
    size, squares, n = size.astype(float), squares.astype(float), size.sum() if whole is None else whole
    while True:
        held = on[tail] & on[ends]
        tip = on & (np.bincount(tail[held], minlength=len(size)) == 1)
        off = held & tip[tail] & ~(tip[ends] & (tail < ends))
        if not off.any():
            break
        v, to = tail[off], ends[off]
        np.add.at(size, to, size[v])
        np.add.at(squares, to, size[v] ** 2)
        on[v] = False
    out = np.where(size > 0, ((n - 1) ** 2 - squares - (n - size) ** 2) / 2, 0.0)
    core, place = np.flatnonzero(on), np.cumsum(on) - 1
    arcs = held & (tail < ends)
    out[core] += betweenness(*adjacency_rows(len(core), place[tail[arcs]], place[ends[arcs]]), weight=size[core])
    return out


def communities(starts: np.ndarray, ends: np.ndarray, sweeps: int = SWEEPS, many: np.ndarray | None = None, late: np.ndarray | None = None) -> np.ndarray:
    """Labels after sweeps in which every node in its turn takes the label that most of its neighbours have at that moment,
    the smallest of equals; they end with the first sweep that changes none.

    A node may stand for many with its only neighbour. Late ones, whose turn follows their neighbour's, still have a label
    each when that has its first turn: the first one's counts, once.
    """
    label = np.arange(len(starts) - 1)
    many = np.ones(len(label)) if many is None else many
    votes = many if late is None else np.where(late, 1, many)
    for _ in range(sweeps):
        before = label.copy()
        for v in np.flatnonzero(np.diff(starts)):
            near = ends[starts[v] : starts[v + 1]]
            names, place = np.unique(label[near], return_inverse=True)
            label[v] = names[np.bincount(place, votes[near]).argmax()]
        votes = many
        if (label == before).all():
            break
    return label


def _component(shares: list[float], damping: float, start: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["b"].isna()].sort_values(["ord", "a"]).reset_index(drop=True)
        place = pd.Series(nodes.index, index=nodes["a"])
        pairs = pdf[pdf["b"].notna()]
        n, many = len(nodes), nodes["many"].to_numpy(float)
        starts, ends = adjacency_rows(n, place[pairs["a"]].to_numpy(), place[pairs["b"]].to_numpy())
        near = np.diff(starts)
        degree = np.bincount(np.repeat(np.arange(n), near), many[ends], n)
        rank = np.full(n, start)
        for share in shares:
            rank = share + damping * np.bincount(ends, np.repeat(many * rank / degree, near), n)
        label = communities(starts, ends, SWEEPS, many, nodes["late"].to_numpy(bool))
        between = brokerage(starts, ends, nodes["size"].to_numpy(float), nodes["squares"].to_numpy(float))
        return pd.DataFrame({"id": nodes["a"], "betweenness_raw": between, "rank": rank, "label": nodes["a"].to_numpy()[label], "exact": True})

    return run


def _core(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes = pdf[pdf["b"].isna()].reset_index(drop=True)
    place = pd.Series(nodes.index, index=nodes["a"])
    pairs = pdf[pdf["b"].notna()]
    starts, ends = adjacency_rows(len(nodes), place[pairs["a"]].to_numpy(), place[pairs["b"]].to_numpy())
    return pd.DataFrame({"id": nodes["a"], "betweenness_raw": brokerage(starts, ends, nodes["size"].to_numpy(float), nodes["squares"].to_numpy(float))})


def _cores(pdf: pd.DataFrame) -> pd.DataFrame:
    """(id, betweenness_raw, n) of several components at once; n is the size of the node's component."""
    nodes = pdf[pdf["b"].isna()].reset_index(drop=True)
    place = pd.Series(nodes.index, index=nodes["a"])
    pairs = pdf[pdf["b"].notna()]
    starts, ends = adjacency_rows(len(nodes), place[pairs["a"]].to_numpy(), place[pairs["b"]].to_numpy())
    tail, part, size = np.repeat(np.arange(len(nodes)), np.diff(starts)), np.arange(len(nodes)), nodes["size"].to_numpy(float)
    while True:
        low = part.copy()
        np.minimum.at(low, tail, part[ends])
        low = low[low]
        if (low == part).all():
            break
        part = low
    whole = np.bincount(part, size, len(nodes))[part]
    between = brokerage(starts, ends, size, nodes["squares"].to_numpy(float), whole)
    return pd.DataFrame({"id": nodes["a"], "betweenness_raw": between, "n": whole.astype(np.int64)})


def _gathered(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes (rep, id, ...) and, with b, pairs (rep, a, b) as rows of one table."""
    return nodes.withColumnRenamed("id", "a").withColumn("b", F.lit(None).cast("string")).unionByName(pairs, allowMissingColumns=True)


def _plain(nodes: DataFrame) -> DataFrame:
    """Nodes (rep, id, ord) that stand for themselves."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return nodes.select("rep", "id", "ord", one.alias("many"), F.lit(False).alias("late"), one.alias("size"), none.alias("squares"))


def _folded(nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (rep, id, ord) and pairs (rep, a, b) with the nodes of one neighbour folded: nodes (rep, id, ord, many, late, size,
    squares), pairs, and the tips (id, of), with of the node that stands for them."""
    both = pairs.select("a", "b").unionAll(pairs.select("b", "a"))
    met = cut(both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.min("b").alias("hub")))
    known = nodes.join(met, "id")
    hubs = known.where("degree > 1").select(F.col("id").alias("hub"), F.struct("ord", "id").alias("turn"))
    tips = cut(known.where("degree = 1").join(hubs, "hub").select("rep", "hub", "id", "ord", (F.struct("ord", "id") > F.col("turn")).alias("late")))
    groups = tips.groupBy("rep", "hub", "late").agg(F.min(F.struct("ord", "id")).alias("first"), F.count(F.lit(1)).alias("many"))
    groups = cut(groups.select("rep", "hub", "late", F.col("first.id").alias("of"), F.col("first.ord").alias("ord"), "many"))
    held = groups.groupBy(F.col("hub").alias("id")).agg(F.sum("many").alias("n"))
    none = F.lit(0).cast("long")
    inner = cut(_plain(nodes.join(tips, "id", "left_anti")).join(held, "id", "left").withColumns({"size": F.coalesce("n", none) + 1, "squares": F.coalesce("n", none)}).drop("n"))
    kept = inner.select(F.col("id").alias("a")), inner.select(F.col("id").alias("b"))
    links = pairs.join(kept[0], "a", "left_semi").join(kept[1], "b", "left_semi").select("rep", "a", "b")
    every = inner.unionByName(groups.select("rep", F.col("of").alias("id"), "ord", "many", "late", none.alias("size"), none.alias("squares")))
    links = links.unionAll(groups.select("rep", F.col("of").alias("a"), F.col("hub").alias("b")))
    return cut(every), cut(links), cut(tips.join(groups.select("hub", "late", "of"), ["hub", "late"]).select("id", "of"))


def _beyond(nodes: DataFrame, pairs: DataFrame, max_nodes: int, max_edges: int) -> DataFrame:
    """(rep) of the components that are too large to gather."""
    sizes = nodes.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).join(pairs.groupBy("rep").agg(F.count(F.lit(1)).alias("m")), "rep")
    return cut(sizes.where((F.col("n") > max_nodes) | (F.col("m") > max_edges)).select("rep"))


def _flows(chosen: DataFrame, both: DataFrame) -> DataFrame:
    """(id, share): what the shortest paths out of the chosen nodes (id, size) bring to every other node, by rounds of joins over
    both (a, b, size), the size of b. A path counts as often as the sizes of its ends say."""
    reached = cut(chosen.select(F.col("id").alias("p"), "id", F.lit(0).alias("far"), F.lit(1.0).alias("paths"), "size"))
    depth = 0
    while True:
        edge = reached.where(F.col("far") == depth)
        step = edge.drop("size").join(both, F.col("id") == F.col("a")).groupBy("p", F.col("b").alias("id")).agg(F.sum("paths").alias("paths"), F.first("size").alias("size"))
        fresh = cut(step.join(reached.select("p", "id"), ["p", "id"], "left_anti").select("p", "id", F.lit(depth + 1).alias("far"), "paths", "size"))
        if fresh.isEmpty():
            break
        old, reached, depth = reached, cut(reached.unionByName(fresh)), depth + 1
        discard(old, fresh)
    share = reached.where(F.col("far") == depth).select("p", "id", F.lit(0.0).alias("share"))
    out, spent = share, [reached]
    for d in range(depth - 1, 0, -1):
        below = reached.where(F.col("far") == d + 1).join(share, ["p", "id"]).select("p", F.col("id").alias("w"), ((F.col("size") + F.col("share")) / F.col("paths")).alias("part"))
        here = reached.where(F.col("far") == d)
        flow = below.join(both, F.col("w") == F.col("a")).groupBy("p", F.col("b").alias("id")).agg(F.sum("part").alias("part"))
        share = cut(here.join(flow, ["p", "id"], "left").select("p", "id", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share")))
        out, spent = out.unionByName(share), [*spent, share]
    total = cut(out.join(chosen.select(F.col("id").alias("p"), "size"), "p").groupBy("id").agg(F.sum(F.col("share") * F.col("size")).alias("share")))
    discard(*spent)
    return total


def _betweenness(nodes: DataFrame, both: DataFrame, pivots: int | None, at_once: int) -> DataFrame:
    """(id, betweenness_raw) from the shortest paths out of every node (id, size), at_once of them at a time, or out of the pivots
    with the smallest hashes, in proportion."""
    count = nodes.count()
    both = cut(both.join(nodes.select(F.col("id").alias("b"), "size"), "b").select("a", "b", "size"))
    if pivots is not None:
        chosen = nodes.orderBy(F.xxhash64("id"), "id").limit(pivots).select("id", "size")
        return _flows(chosen, both).select("id", (F.col("share") * count / min(pivots, max(count, 1)) / 2).alias("betweenness_raw"))
    blocks = max(1, -(-count // at_once))
    dealt, total = cut(nodes.select("id", "size", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))), None
    for i in range(blocks):
        part = _flows(dealt.where(F.col("block") == i).select("id", "size"), both)
        if total is None:
            total = part
        else:
            old, total = total, cut(total.unionByName(part).groupBy("id").agg(F.sum("share").alias("share")))
            discard(old, part)
    return total.select("id", (F.col("share") / 2).alias("betweenness_raw"))


def _turns(nodes: DataFrame, both: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """(id, label): communities by taking turns, as communities() finds them.

    A node's turn needs the new labels of its neighbours before it and the old ones of those after it. So a sweep goes by
    waves: a node's wave follows those of all neighbours before it, and the nodes of one wave take their turns together.
    """
    place = cut(numbered(nodes.select("ord", "id", "many", "late"), ["ord", "id"], "pos").select("id", "pos", "many", "late"))
    of = lambda old, new: place.select(F.col("id").alias(old), F.col("pos").alias(new))
    start = place.select(F.col("id").alias("a"), F.col("pos").alias("u"), F.when(F.col("late"), F.lit(1)).otherwise(F.col("many")).alias("once"), "many")
    arcs = cut(both.join(start, "a").join(of("b", "v"), "b").select("u", "v", "once", "many"))
    before = arcs.where("u < v")
    wave = cut(place.select("pos", F.lit(0).alias("wave")))
    while True:
        after = before.join(wave, F.col("u") == F.col("pos")).groupBy(F.col("v").alias("pos")).agg((F.max("wave") + 1).alias("next"))
        old, wave = wave, cut(wave.join(after, "pos", "left").select("pos", F.coalesce("next", F.lit(0)).alias("wave"), (F.coalesce("next", F.lit(0)) != F.col("wave")).alias("moved")))
        moved = not wave.where("moved").isEmpty()
        wave = wave.drop("moved") if not moved else wave
        discard(old)
        if not moved:
            break
    last = wave.agg(F.max("wave")).first()[0]
    arcs = cut(arcs.join(wave.select(F.col("pos").alias("v"), "wave"), "v").repartitionByRange("wave", "v").sortWithinPartitions("wave"))
    label = cut(place.select("pos", F.col("pos").alias("label")))
    for sweep in range(sweeps):
        new, weight = None, F.col("many" if sweep else "once").alias("weight")
        for w in range(last + 1):
            here = arcs.where(F.col("wave") == w)
            seen = here.where("u > v").join(label, F.col("u") == F.col("pos")).select("v", "label", weight)
            if new is not None:
                seen = seen.unionByName(here.where("u < v").join(new, F.col("u") == F.col("pos")).select("v", "label", weight))
            votes = seen.groupBy("v", "label").agg(F.sum("weight").alias("n"))
            best = votes.groupBy(F.col("v").alias("pos")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select("pos", F.col("m.label").alias("label"))
            old, new = new, cut(best if new is None else new.unionByName(best))
            if old is not None:
                discard(old)
        moved = not new.join(label.select("pos", F.col("label").alias("before")), "pos").where("label != before").isEmpty()
        discard(label)
        label = new
        if not moved:
            break
    return label.join(of("id", "pos"), "pos").join(of("name", "label"), "label").select("id", F.col("name").alias("label"))


def _trees(nodes: DataFrame, both: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, base), the core's nodes (rep, id, size, squares) and both ways of its pairs (rep, a, b): trees are taken off as in
    brokerage, in PEELS rounds at most; base is the betweenness by the trees' sizes."""
    whole = nodes.groupBy("rep").agg(F.sum("size").alias("n"))
    core = cut(nodes.where("size > 0").select("rep", "id", "size", "squares"))
    arcs = cut(both.join(core.select(F.col("id").alias("a")), "a", "left_semi").join(core.select(F.col("id").alias("b")), "b", "left_semi").select("rep", "a", "b"))
    done = None
    for _ in range(PEELS):
        tips = cut(arcs.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("to")).where("n = 1").select("id", "to"))
        stays = tips.join(tips.select(F.col("id").alias("to")), "to", "left_semi").where("id < to").select("id")
        off = cut(core.join(tips.join(stays, "id", "left_anti"), "id"))
        if off.isEmpty():
            break
        done = off.drop("to") if done is None else done.unionByName(off.drop("to"))
        gain = off.groupBy(F.col("to").alias("id")).agg(F.sum("size").alias("s"), F.sum(F.col("size") * F.col("size")).alias("q"))
        none = F.lit(0).cast("long")
        new = core.join(off.select("id"), "id", "left_anti").join(gain, "id", "left")
        core, old = cut(new.select("rep", "id", (F.col("size") + F.coalesce("s", none)).alias("size"), (F.col("squares") + F.coalesce("q", none)).alias("squares"))), (core, arcs)
        arcs = cut(arcs.join(off.select(F.col("id").alias("a")), "a", "left_anti").join(off.select(F.col("id").alias("b")), "b", "left_anti").select("rep", "a", "b"))
        discard(*old)
    every = core if done is None else core.unionByName(done)
    square = lambda c: c * c
    base = (square(F.col("n") - 1) - F.col("squares") - square(F.col("n") - F.col("size"))) / 2
    return cut(every.join(whole, "rep").select("id", base.alias("base"))), core, arcs


def _between(nodes: DataFrame, both: DataFrame, pivots: int | None, at_once: int, max_nodes: int, max_edges: int) -> DataFrame:
    """(id, betweenness_raw) of folded nodes: by the trees' sizes, and on the ways through what is left without trees."""
    base, core, arcs = _trees(nodes, both)
    pairs = arcs.where("a < b")
    big = _beyond(core, pairs, max_nodes, max_edges)
    small = _gathered(core.join(big, "rep", "left_anti"), pairs.join(big, "rep", "left_anti")).groupBy("rep").applyInPandas(_core, "id string, betweenness_raw double")
    if big.isEmpty():
        rest = small
    else:
        ways = _betweenness(core.join(big, "rep", "left_semi").select("id", "size"), arcs.join(big, "rep", "left_semi").select("a", "b"), pivots, at_once)
        ways = core.join(big, "rep", "left_semi").select("id").join(base, "id").join(ways, "id", "left")
        rest = small.unionByName(ways.select("id", (F.col("base") + F.coalesce("betweenness_raw", F.lit(0.0))).alias("betweenness_raw")))
    return base.join(rest, "id", "left").select("id", F.coalesce("betweenness_raw", "base").alias("betweenness_raw"))


def _large(nodes: DataFrame, pairs: DataFrame, shares: list[float], start: float, pivots: int | None, at_once: int, max_nodes: int, max_edges: int) -> DataFrame:
    both = cut(pairs.unionAll(pairs.select("rep", F.col("b").alias("a"), F.col("a").alias("b"))))
    degree = both.join(nodes.select(F.col("id").alias("b"), "many"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("many").alias("degree"))
    state = cut(nodes.join(degree, "id").select("id", "many", "degree", F.lit(start).alias("rank"), F.col("id").alias("label")))
    for i, share in enumerate(shares):
        flow = state.select(F.col("id").alias("a"), (F.col("many") * F.col("rank") / F.col("degree")).alias("out")).join(both, "a").groupBy(F.col("b").alias("id")).agg(F.sum("out").alias("in"))
        state = state.join(flow, "id").select("id", "many", "degree", (share + DAMPING * F.col("in")).alias("rank"), "label")
        if i % 5 == 4:
            state = cut(state)
    state = cut(state)
    if pivots is None:
        state = state.drop("label").join(_turns(nodes, both), "id")
    else:
        state = _rounds(state, both)
    between = _between(nodes, both, pivots, at_once, max_nodes, max_edges)
    return state.join(between, "id", "left").select("id", F.coalesce("betweenness_raw", F.lit(0.0)).alias("betweenness_raw"), "rank", "label", F.lit(pivots is None).alias("exact"))


def _rounds(state: DataFrame, both: DataFrame) -> DataFrame:
    """state with the labels after synchronous rounds; before the first one folded nodes have a label each."""
    for i in range(SWEEPS):
        votes = state.select(F.col("id").alias("a"), "label", F.col("many") if i else F.lit(1).alias("many")).join(both, "a").groupBy(F.col("b").alias("id"), "label").agg(F.sum("many").alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("v")).select("id", F.col("v.label").alias("new"))
        after = cut(state.join(best, "id"))
        moved = after.where("new != label").limit(1).count()
        state = after.drop("label").withColumnRenamed("new", "label")
        if not moved:
            break
    return state


def analyze(
    entities: DataFrame, pairs: DataFrame, rounds: int = ROUNDS, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES, pivots: int | None = 16, at_once: int = 1_024
) -> DataFrame:
    """(id, ord, betweenness, pagerank, community, exact) of entities (id, ord) over undirected pairs (a, b).

    pivots: how many nodes of a component that isn't gathered betweenness is estimated from, None for all, at_once at a time.

    Betweenness and PageRank are relative to the greatest; communities are numbered by their first node in ord.
    """
    nodes = cut(entities.select("id", "ord"))
    pairs = cut(pairs.select("a", "b"))
    rep = cut(connected_components(pairs))
    n, linked = nodes.count(), rep.count()
    shares = uniform_share(max(n, 1), n - linked, rounds)
    links = cut(pairs.join(rep, F.col("a") == F.col("node")).select("rep", "a", "b"))
    members = cut(nodes.join(rep, F.col("id") == F.col("node")).select("rep", "id", "ord"))
    big = _beyond(members, links, max_nodes, max_edges)
    whole, between, tips, large = _plain(members.join(big, "rep", "left_anti")), links.join(big, "rep", "left_anti"), None, None
    if not big.isEmpty():
        some, near, tips = _folded(members.join(big, "rep", "left_semi"), links.join(big, "rep", "left_semi"))
        big = _beyond(some, near, max_nodes, max_edges)
        whole, between = whole.unionByName(some.join(big, "rep", "left_anti")), between.unionByName(near.join(big, "rep", "left_anti"))
        if not big.isEmpty():
            large = _large(some.join(big, "rep", "left_semi"), near.join(big, "rep", "left_semi"), shares, 1.0 / n, pivots, at_once, max_nodes, max_edges)
    out = _gathered(whole, between).groupBy("rep").applyInPandas(_component(shares, DAMPING, 1.0 / max(n, 1)), "id string, betweenness_raw double, rank double, label string, exact boolean")
    out = out if large is None else out.unionByName(large)
    if tips is not None:
        out = cut(out)
        folded = tips.where("id != of").join(out.withColumnRenamed("id", "of"), "of")
        out = out.unionByName(folded.select("id", "betweenness_raw", "rank", "label", "exact"))
    alone = nodes.join(rep, F.col("id") == F.col("node"), "left_anti").select("id", F.lit(0.0).alias("betweenness_raw"), F.lit(shares[-1]).alias("rank"), F.col("id").alias("label"), F.lit(True).alias("exact"))
    every = cut(out.unionByName(alone).join(nodes, "id"))
    first = numbered(every.groupBy("label").agg(F.min(F.struct("ord", "id")).alias("first")), ["first"], "community").select("label", "community")
    top = every.agg(F.max("betweenness_raw").alias("b"), F.max("rank").alias("r")).first()
    return every.join(first, "label").select(
        "id", "ord", (F.col("betweenness_raw") / F.lit(top["b"] if top and top["b"] else 1.0)).alias("betweenness"),
        (F.col("rank") / F.lit(top["r"] if top and top["r"] else 1.0)).alias("pagerank"), "community", "exact",
    )


def _by_trees(rows: DataFrame) -> DataFrame:
    """(id, betweenness_raw, n) of nodes (id, size, squares, n) by the sizes of the trees that hang from them alone."""
    square = lambda c: c * c
    return rows.select("id", ((square(F.col("n") - 1) - F.col("squares") - square(F.col("n") - F.col("size"))) / 2).alias("betweenness_raw"), "n")


def brokers(entities: DataFrame, pairs: DataFrame, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES, pivots: int | None = None, at_once: int = 1_024) -> DataFrame:
    """(id, ord, betweenness) of entities (id, ord) over undirected pairs (a, b): the betweenness of analyze alone.

    Without ranks and communities nothing needs the components first. Trees are taken off before, in PEELS rounds at most or until
    what is left is few enough to gather at once; components are sought in that rest only. A tip from which nothing hangs lies on
    no way between others, so that only those that bear some are kept to the end.
    """
    both = lambda e: e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left, bear, off, none = cut(pairs.select("a", "b")), None, [], F.lit(0).cast("long")
    m = left.count()
    fits = lambda: 2 * m <= max_nodes and m <= max_edges
    for _ in range(PEELS):
        if fits():
            break
        met = cut(both(left).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("near"), F.min("b").alias("to")))
        hubs, tips = met.where("near > 1").select(F.col("id").alias("to"), F.lit(True).alias("hub")), met.where("near = 1").select("id", "to")
        # of two tips that face each other the smaller stays
        goes = lambda rows: rows.join(hubs, "to", "left").where("hub OR id > to").drop("hub")  # noqa: E731, B023
        size = F.lit(1).cast("long")
        if bear is not None:
            taken = cut(goes(tips.join(bear, "id")).select("id", "to", (F.col("held") + 1).alias("size"), "squares"))
            off.append(taken)
            tips, size = tips.join(bear.select("id", "held"), "id", "left"), F.coalesce("held", none) + 1
        gain = goes(tips.groupBy("to").agg(F.min("id").alias("id"), F.sum(size).alias("held"), F.sum(size * size).alias("squares"))).select(F.col("to").alias("id"), "held", "squares")
        old = [met, left]
        if bear is not None:
            old.append(bear)
            gain = bear.join(taken.select("id"), "id", "left_anti").unionByName(gain).groupBy("id").agg(F.sum("held").alias("held"), F.sum("squares").alias("squares"))
        bear = cut(gain)
        left = cut(left.join(hubs.select(F.col("to").alias("a")), "a", "left_semi").join(hubs.select(F.col("to").alias("b")), "b", "left_semi").select("a", "b"))
        before, m = m, left.count()
        discard(*old)
        if m == before:
            break
    ends = both(left).select(F.col("a").alias("id")).distinct()
    if bear is None:
        core = ends.select("id", F.lit(1).cast("long").alias("size"), none.alias("squares"))
    else:
        core = ends.join(bear, "id", "left").select("id", (F.coalesce("held", none) + 1).alias("size"), F.coalesce("squares", none).alias("squares"))
    if fits():
        one = F.lit(0).alias("rep")
        known = _gathered(core.select(one, "*"), left.select(one, "*")).groupBy("rep").applyInPandas(_cores, "id string, betweenness_raw double, n long")
    else:
        rep = cut(connected_components(left))
        core = cut(core.join(rep, F.col("id") == F.col("node")).select("rep", "id", "size", "squares"))
        ways = cut(both(left).join(rep, F.col("a") == F.col("node")).select("rep", "a", "b"))
        known = _between(core, ways, pivots, at_once, max_nodes, max_edges)
        known = known.join(core.select("id", "rep"), "id").join(core.groupBy("rep").agg(F.sum("size").alias("n")), "rep").select("id", "betweenness_raw", "n")
    if bear is not None:
        # trees of which nothing is left but one node
        known = known.unionByName(_by_trees(bear.join(ends, "id", "left_anti").select("id", (F.col("held") + 1).alias("size"), "squares", (F.col("held") + 1).alias("n"))))
    known = cut(known)
    for taken in reversed(off):
        known = cut(known.unionByName(_by_trees(taken.join(known.select(F.col("id").alias("to"), "n"), "to"))))
    top = known.agg(F.max("betweenness_raw")).first()[0]
    return entities.select("id", "ord").join(known, "id", "left").select("id", "ord", (F.coalesce("betweenness_raw", F.lit(0.0)) / F.lit(top or 1.0)).alias("betweenness"))


def top_broker(metrics: DataFrame) -> DataFrame:
    """The node with the greatest positive betweenness, of equals the first."""
    return metrics.where("betweenness > 0").orderBy(F.desc("betweenness"), "ord").limit(1)


def modularity(pairs: DataFrame, communities: DataFrame) -> DataFrame:
    """One row, modularity: the share of pairs inside communities less what degrees alone would put there."""
    of = lambda c: communities.select(F.col("id").alias(c), F.col("community").alias(f"c_{c}"))
    named = pairs.join(of("a"), "a").join(of("b"), "b")
    inside = named.groupBy(F.col("c_a").alias("c")).agg(F.count_if(F.col("c_a") == F.col("c_b")).alias("l"), F.count(F.lit(1)).alias("d"))
    other = named.groupBy(F.col("c_b").alias("c")).agg(F.lit(0).cast("long").alias("l"), F.count(F.lit(1)).alias("d"))
    sums = inside.unionByName(other).groupBy("c").agg(F.sum("l").alias("l"), F.sum("d").alias("d"))
    total = F.sum("d") / 2
    return sums.agg(F.coalesce(F.try_divide(F.sum("l"), total) - F.try_divide(F.sum(F.col("d") * F.col("d")), 4 * total * total), F.lit(0.0)).alias("modularity"))


def predict_links(edges: DataFrame, min_shared: int = 2, top_k: int | None = 12, most: int = 25) -> DataFrame:
    """(a, b, common, score): unconnected pairs with common neighbours of 2 to `most` neighbours, by Adamic-Adar.

    Hubs beyond that say nothing and are left out by their count before pairs are made; predicted links don't count.
    """
    from .correlate import pairs_within
    from .graph import undirected

    known = cut(undirected(edges.where("rel_type != 'predicted_link'")))
    both = known.select(F.col("a").alias("z"), F.col("b").alias("x")).unionAll(known.select(F.col("b").alias("z"), F.col("a").alias("x")))
    weight = both.groupBy("z").agg(F.count(F.lit(1)).alias("deg"))
    via = pairs_within(both, ["z"], "x", 2, most).join(weight, "z")
    sums = via.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.sum(1 / F.log(F.col("deg").cast("double"))).alias("score")).where(F.col("common") >= max(min_shared, 1))
    out = sums.join(known, ["a", "b"], "left_anti")
    return out.orderBy(F.desc(F.round("score", 9)), F.desc("common"), "a", "b").limit(top_k) if top_k else out


def predicted_edges(predictions: DataFrame) -> DataFrame:
    """Predictions as predicted_link edges; confidence grows from 0.3 to 0.7 with the score."""
    top = predictions.agg(F.max("score").alias("top"))
    return predictions.join(F.broadcast(top)).select(F.col("a").alias("source_id"), F.lit("predicted_link").alias("rel_type"), F.col("b").alias("target_id"), (0.3 + 0.4 * F.coalesce(F.try_divide("score", "top"), F.lit(0.0))).alias("confidence"), F.lit("predicted").alias("source_reference"), F.col("common").cast("string").alias("ord"))


def write_metrics(entities: DataFrame, metrics: DataFrame) -> DataFrame:
    """entities with the attributes betweenness and pagerank (three decimals) and community, and the tag broker on the top
    broker. Entities without metrics stay as they are."""
    m = metrics.select(F.col("id").alias("m_id"), "betweenness", "pagerank", "community")
    top = top_broker(metrics).select(F.col("id").alias("t_id"))
    j = entities.join(m, F.col("id") == F.col("m_id"), "left").join(F.broadcast(top), F.col("id") == F.col("t_id"), "left")
    values = F.create_map(
        F.lit("betweenness"), F.format_string("%.3f", "betweenness"), F.lit("pagerank"), F.format_string("%.3f", "pagerank"), F.lit("community"), F.col("community").cast("string"),
    )
    old = F.map_filter("attributes", lambda k, _: ~k.isin("betweenness", "pagerank", "community"))
    attributes = F.when(F.col("m_id").isNull(), F.col("attributes")).otherwise(F.map_concat(old, values))
    tags = F.when(F.col("t_id").isNull(), F.col("tags")).otherwise(F.array_union("tags", F.array(F.lit("broker"))))
    return j.withColumns({"attributes": attributes, "tags": tags}).select(*entities.columns)
