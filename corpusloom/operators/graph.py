"""Graph operators over edge tables: closures, reach, propagation, cycles, centrality.

Loops join the frontier with the edges and write it to the shared folder at each round;
they stop when nothing changes. Visited sets are anti-joins. Nothing is collected but
counts; betweenness and communities run in tasks that hold a graph's edges as plain arrays.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import Scratch


def edges_of(pairs: DataFrame) -> DataFrame:
    """Distinct (src, dst); self-loops stay."""
    return pairs.select("src", "dst").distinct()


def walk(edges: DataFrame, seeds: DataFrame, scratch: Scratch, depth: int = 10) -> DataFrame:
    """(root, node, depth): nodes reached from each seed, each at its least depth; roots at 0."""
    edges = edges_of(edges)
    front = seeds.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0))
    seen = front = scratch.save(front, "walk-0")
    for turn in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = scratch.save(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(turn)), f"walk-{turn}")
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def reach(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, callers): distinct nodes from which each node is reached, itself only by a cycle.

    It ends when no new pair is found, as pairs are finite and none comes twice.
    """
    back = edges_of(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    starts = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).distinct()
    first = scratch.save(starts.join(back, starts["node"] == back["src"]).select(F.col("node").alias("root"), F.col("dst").alias("node")).distinct(), "reach-0")
    seen, front, turn = first, first, 0
    while not front.isEmpty():
        turn += 1
        step = front.join(back, front["node"] == back["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = scratch.save(step.join(seen, ["root", "node"], "left_anti"), f"reach-{turn}")
        # Now and then one table takes the place of the union, whose plan grows with each round.
        seen = seen.unionAll(front) if turn % 16 else scratch.save(seen.unionAll(front), f"reach-seen-{turn}")
    counts = seen.groupBy(F.col("root").alias("node")).agg(F.count("*").alias("callers"))
    return starts.join(counts, "node", "left").select("node", F.coalesce("callers", F.lit(0)).cast("long").alias("callers"))


def fixpoint(edges: DataFrame, start: DataFrame, value: str, better: Column, combine, scratch: Scratch, rounds: int, name: str, repeats: bool = False) -> DataFrame:
    """(node, value): each round sends `better` along the edges and combines it with what is there.

    Repeated edges count once, or with `repeats` each. The join is by sorting: a table that
    just fits a broadcast would be sent to the driver in each round.
    """
    now, edges = scratch.save(start.select("node", value), f"{name}-0"), (edges if repeats else edges_of(edges)).hint("merge")
    before = None
    for turn in range(1, rounds + 1):
        sent = now.join(edges, now["node"] == edges["src"]).select(F.col("dst").alias("node"), better.alias(value))
        now = scratch.save(now.unionAll(sent).groupBy("node").agg(combine(value).alias(value)), f"{name}-{turn}")
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("node", value)), F.sum(F.xxhash64("node", value) % 1_000_003)).first())
        if mark == before:
            break
        before = mark
    return now


def propagate_labels(edges: DataFrame, seeds: DataFrame, scratch: Scratch, decay: float = 0.8, least: float = 0.1, rounds: int = 10, mode: str = "decay", direction: str = "down") -> DataFrame:
    """(node, strength): labels of the seeds spread along the edges (down), against them (up), or both ways.

    Modes: `decay` is the strongest seed, decayed by each step, above a floor; `max` the
    strongest seed; `reachability` 1 for what is reached, while seeds keep their strength;
    `accumulation` adds the strengths of the neighbours in each round.
    """
    once = edges_of(edges)
    back = once.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = {"down": once, "up": back, "both": once.unionAll(back)}[direction]
    start, value = seeds.select("node", F.col("strength").cast("double").alias("strength")), F.col("strength")
    sent, combine = {"decay": (F.when(value * decay >= least, value * decay), F.max), "max": (value, F.max), "reachability": (F.lit(1.0), F.max), "accumulation": (value, F.sum)}[mode]
    out = fixpoint(ways, start, "strength", sent, combine, scratch, rounds, "labels", mode == "accumulation")
    if mode == "reachability":
        own = start.groupBy("node").agg(F.max("strength").alias("own"))
        out = out.join(own, "node", "left").select("node", F.coalesce("own", "strength").alias("strength"))
    return out.where("strength is not null")


def transitive_effects(calls: DataFrame, direct: DataFrame, propagated: int, scratch: Scratch, rounds: int = 100, decay: float = 0.95, floor: float = 0.3) -> DataFrame:
    """(node, mask, confidence): the effects of a function, and those bits of `propagated` of any it calls.

    A function with such an effect of its own has confidence 1; each call from it outwards
    takes `decay`, down to the floor; the nearest counts. 0 is a mask of other effects alone.
    """
    up = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    own = direct.select("node", F.col("mask").cast("long").alias("mask"))
    sent = own.select("node", F.col("mask").bitwiseAND(propagated).alias("mask")).where("mask <> 0")
    far = fixpoint(up, sent, "mask", F.col("mask"), F.bit_or, scratch, rounds, "masks")
    near = fixpoint(up, sent.select("node", F.lit(1.0).alias("confidence")), "confidence", F.greatest(F.lit(floor), F.col("confidence") * decay), F.max, scratch, rounds, "confidence")
    masks = own.unionByName(far).groupBy("node").agg(F.bit_or("mask").alias("mask"))
    return masks.join(near, "node", "left").select("node", "mask", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of strong components: forward and backward reach by least labels, in rounds.

    Each round colours nodes by the least node that reaches them; those that reach their
    colour's node back within the colour are its component and leave.
    """
    left = scratch.save(edges_of(edges), "scc-edges")
    nodes = scratch.save(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "scc-nodes")
    out, turn = None, 0
    while not nodes.isEmpty():
        start = nodes.select("node", F.col("node").alias("colour"))
        colour = fixpoint(left, start, "colour", F.col("colour"), F.min, scratch, 10_000, f"scc-c{turn}")
        a, b = colour.select(F.col("node").alias("src"), F.col("colour").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("cb"))
        within = scratch.save(left.join(a, "src").join(b, "dst").where("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst")), f"scc-w{turn}")
        roots = colour.where("node = colour").select("node", F.col("colour").alias("hit"))
        back = fixpoint(within, roots, "hit", F.col("hit"), F.min, scratch, 10_000, f"scc-b{turn}")
        done = scratch.save(back.select("node", F.col("hit").alias("component")), f"scc-d{turn}")
        out = done if out is None else out.unionAll(done)
        nodes = scratch.save(nodes.join(done.select("node"), "node", "left_anti"), f"scc-n{turn}")
        gone = done.select("node")
        left = scratch.save(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), f"scc-l{turn}")
        turn += 1
    return out if out is not None else nodes.select("node", F.col("node").alias("component"))


def cycles(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(component, size) of strong components of several nodes, or of one that calls itself."""
    own = edges_of(edges).where("src = dst").select(F.col("src").alias("component")).distinct().withColumn("own", F.lit(1))
    sizes = components(edges, scratch).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.join(own, "component", "left").where("size > 1 or own = 1").select("component", "size")


def _compressed(heads: np.ndarray, tails: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, tail, weight): the edges of node v are first[v] to first[v + 1], rising; weight is how often each comes."""
    return _merged(heads, tails, np.ones(len(heads)), n)


def _merged(heads: np.ndarray, tails: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, place = np.unique(heads * n + tails, return_inverse=True)
    return np.searchsorted(keys, np.arange(n + 1) * n), keys % max(n, 1), np.bincount(place, weight, len(keys))


def betweenness(edges: DataFrame, most_edges: int | None = None, batches: int = 256) -> DataFrame:
    """(node, score): Brandes' shortest-path shares over (n-1)(n-2), in batches of sources.

    Each worker holds all edges as plain arrays, 16 bytes a node and 8 an edge; `most_edges` refuses more.
    """
    edges = edges_of(edges)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    if most_edges is not None and (m := edges.count()) > most_edges:
        raise ValueError(f"a graph of {m} edges is over the bound of {most_edges}")
    held = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).toPandas()
    ids, ends = np.unique(np.concatenate([held["src"].to_numpy(), held["dst"].to_numpy()]), return_inverse=True)
    src, dst = ends[: len(held)], ends[len(held) :]
    n, other = len(ids), src != dst
    first, tail, _ = _compressed(src[other], dst[other], n)
    shared = edges.sparkSession.sparkContext.broadcast((ids, first, tail))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, first, tail = shared.value
        first, tail, score = memoryview(first), memoryview(tail), defaultdict(float)
        for s in np.searchsorted(ids, group["node"].to_numpy()).tolist():
            order, paths, dist, before, todo = [], defaultdict(float, {s: 1.0}), {s: 0}, defaultdict(list), deque([s])
            while todo:
                v = todo.popleft()
                order.append(v)
                for w in tail[first[v] : first[v + 1]]:
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        todo.append(w)
                    if dist[w] == dist[v] + 1:
                        paths[w] += paths[v]
                        before[w].append(v)
            share = defaultdict(float)
            for w in reversed(order):
                for v in before[w]:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
                if w != s:
                    score[w] += share[w]
        return pd.DataFrame({"node": ids[list(score)] if score else [], "score": list(score.values())}, columns=["node", "score"])

    parts = nodes.select(F.col("node").cast("long"), F.pmod(F.xxhash64("node"), F.lit(batches)).alias("b")).groupBy("b").applyInPandas(run, "node long, score double")
    scale = max(1, (n - 1) * (n - 2))
    return parts.groupBy("node").agg((F.sum("score") / scale).alias("score"))


def _moves(first: np.ndarray, tail: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The community of each node after moves in the order of nodes, until none moves.

    A node is looked at again only after a community that it meets changed: else it would stay.
    """
    n = len(first) - 1
    heads = np.repeat(np.arange(n), np.diff(first))
    degrees = np.bincount(heads, weight, n)
    total, placed, loads = float(weight.sum()) or 1.0, np.arange(n), degrees.copy()
    first, tail, weight, degree, place, load = map(memoryview, (first, tail, weight, degrees, placed, loads))
    changed, seen = memoryview(np.zeros(n, dtype=np.int64)), memoryview(np.full(n, -1, dtype=np.int64))
    tick, moved = 0, True
    while moved:
        moved = False
        for v in range(n):
            own, last, at, stop = place[v], seen[v], first[v], first[v + 1]
            stale, near = changed[own] > last, {}
            for k in range(at, stop):
                if (u := tail[k]) != v:
                    c = place[u]
                    near[c] = near.get(c, 0.0) + weight[k]
                    stale = stale or changed[c] > last
            if not stale:
                continue
            d = degree[v]
            load[own] -= d
            stay = near.get(own, 0.0) - load[own] * d / total
            best, most, top = own, stay, round(stay, 12)
            for c, w in near.items():
                gain = w - load[c] * d / total
                rounded = round(gain, 12)
                if rounded > top or rounded == top and c < best:
                    best, most, top = c, gain, rounded
            if most <= stay + 1e-12:
                best = own
            load[best] += d
            if best != own:
                tick += 1
                place[v], changed[own], changed[best], moved = best, tick, tick, True
            seen[v] = tick
    return placed


def louvain(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, community) by modularity gains, ties to the lowest community; nodes in order of their number.

    A graph is plain arrays, some 330 bytes an edge at the peak.
    """
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    n, member = len(ids), np.arange(len(ids))
    first, tail, _ = _compressed(a, b, n)
    heads, tail = np.repeat(np.arange(n), np.diff(first)), tail
    first, tail, weight = _merged(np.concatenate([heads, tail]), np.concatenate([tail, heads]), np.ones(2 * len(tail)), n)
    while True:
        place = _moves(first, tail, weight)
        if (place == np.arange(n)).all():
            break
        kept, place = np.unique(place, return_inverse=True)
        member = place[member]
        heads, n = np.repeat(np.arange(n), np.diff(first)), len(kept)
        first, tail, weight = _merged(place[heads], place[tail], weight, n)
    _, least = np.unique(member, return_index=True)
    return ids, ids[least[member]]


def communities(edges: DataFrame, most_edges: int | None = None) -> DataFrame:
    """(node, community) per graph (`graph` column, or one in all), each graph in one task.

    The order of moves matters, so a graph isn't split; `most_edges` refuses larger ones.
    """
    if "graph" not in edges.columns:
        edges = edges.withColumn("graph", F.lit(0))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if most_edges is not None and len(group) > most_edges:
            raise ValueError(f"a graph of {len(group)} edges is over the bound of {most_edges}")
        node, community = louvain(group["src"].to_numpy(), group["dst"].to_numpy())
        return pd.DataFrame({"graph": group["graph"].iloc[0], "node": node, "community": community})

    return edges.select(F.col("graph").cast("long"), F.col("src").cast("long"), F.col("dst").cast("long")).distinct().groupBy("graph").applyInPandas(run, "graph long, node long, community long")


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(modularity) of an undirected reading of distinct edges."""
    a, b = member.select(F.col("node").alias("src"), F.col("community").alias("ca")), member.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    named = edges_of(edges).join(a, "src").join(b, "dst")
    ends = named.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    inside = named.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("i"))
    m = named.agg(F.count("*").alias("m"))
    each = ends.join(inside, "c", "left").crossJoin(F.broadcast(m))  # one row
    return each.agg(F.round(F.sum(F.coalesce("i", F.lit(0)) / F.col("m") - (F.col("d") / (2 * F.col("m"))) ** 2), 9).alias("modularity"))
