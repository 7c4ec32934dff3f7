"""Steps whose cost once grew faster than their input, against plain versions of them."""

import inspect
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import names as N
from corpusloom.functions import text as T
from corpusloom.operators import context as C
from corpusloom.operators import graph as G
from corpusloom.operators import index as X
from corpusloom.operators import metrics as M
from corpusloom.operators import similar as D
from corpusloom.operators import symbols as Y
from corpusloom.runtime import Scratch


def test_parents_against_brute_force(spark):
    """Spans of many symbols, some end before they start, ids that come again, lines of one to four digits."""
    rng, rows = random.Random(3), []
    for k in range(300):
        a = rng.choice([-12, -5, -3, 1, 4, 8, 9, 60, 95, 99, 100, 101, 990, 1000])
        rows.append((k if k % 30 else 7, k % 3, rng.choice(["a", "b", "c", None]), a, a + rng.choice([-2, 0, 1, 3, 9, 40, 950])))
    symbols = spark.createDataFrame([*rows, (900, 0, "far", 10, 20), (901, 0, "far", 100, 15), (None, 0, "a", 1, 9), (902, None, "a", 1, 9)], "symbol_id long, file_id long, name string, line int, end_line int").coalesce(1)
    want, every = {}, [*rows, (900, 0, "far", 10, 20), (901, 0, "far", 100, 15)]
    for i, f, _, l, e in every:
        for o, g, name, a, z in every:
            if f == g and i != o and l >= a and e <= z and (l > a or e < z):
                want[i, name] = min(want.get((i, name), "~"), f"{a}-{z}")
    got = C.parents(symbols).collect()
    assert {(r["symbol_id"], r["name"]): r["detail"] for r in got} == want and len(got) == len(want)


def test_references_meet_few_symbols(spark):
    """A name that all symbols and references share: the best candidates, and no row for each pair."""
    rng = random.Random(5)
    symbols = [(k, "x", rng.choice([*range(40), None]), rng.choice(["go", "rust", "unknown", None]), rng.random() < 0.3, rng.random() < 0.5, rng.choice(["T1", "T2", None])) for k in range(400)]
    refs = [(k, rng.choice(["x", "T1.x", "T2.x", "T9.x"]), rng.choice([*range(80), None]), rng.choice(["go", "zig", "unknown", None])) for k in range(300)]
    imports = {3, 60, 61, 62}
    want = {}
    for ref, name, file, family in refs:
        receiver, family = name.split(".")[0] if "." in name else None, family or "unknown"
        keys = []
        for s, _, target, kind, exported, test, typed in symbols:
            kind, typed, near = kind or "unknown", receiver is not None and receiver == typed, file is not None and file == target
            if typed or near or family == kind or "unknown" in (family, kind):
                hidden = not exported and file not in imports
                keys.append((not typed, not near, hidden, hidden and test, s))
        want[ref] = min(keys)[-1]
    frames = (
        spark.createDataFrame(refs, "ref_id long, referenced_name string, file_id long, family string"),
        spark.createDataFrame(symbols, "symbol_id long, name string, file_id long, family string, is_exported boolean, is_test boolean, receiver_type string"),
        spark.createDataFrame([(f, "x") for f in imports], "file_id long, imported_name string"),
    )
    found = Y.resolve(*(f.coalesce(1) for f in frames))
    assert {r["ref_id"]: r["target_symbol"] for r in found.collect()} == want


def test_postings_of_one_scan(spark):
    """Words and their first bytes as a plain scan finds them; no state is carried over an array of words."""
    text = "The cat the_CAT ab né thé naïve日本 cat\x00CAT Kelvin Kat " * 50
    rows = [(1, text), (2, None), (3, ""), (4, "ab"), (5, "xyz " + text), (5, "cat")]
    want = {}
    for f, t in rows:
        for m in re.finditer(rb"[A-Za-z0-9_]+", (t or "").encode()):
            if len(m[0]) >= 3:
                key = m[0].decode().translate(str.maketrans(T.UPPER, T.LOWER)), f
                want[key] = min(want.get(key, m.start()), m.start())
    found = X.postings(spark.createDataFrame(rows, "file_id long, content string").coalesce(1))
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.collect()
    assert {(r["token"], r["file_id"]): r["first_offset"] for r in got} == want and len(got) == len(want)


def test_binary_heads_at_their_bounds(spark):
    """Shares of odd bytes at the bounds, leading bytes and text of several bytes a character, by no loop over bytes."""
    heads = [b"", b"\x00", b"a" * 99 + b"\x00", b"a" * 200 + b"\x00" * 2, b"a" * 200 + b"\x00" * 3, b"\x01" * 30 + b"a" * 70, b"\x1f" * 31 + b"a" * 69, b"\t\n\r" * 50, "é日".encode() * 300, b"a" * 512 + b"\x00" * 90, b"\x1f\x8b", b"x\x1f\x8b", b"MZ", b"\xff\xd8\xff\xe0", b"\x80\x90\xff" * 9]
    want = {}
    for k, h in enumerate(heads):
        h = h[:512]
        odd = sum(b < 32 and b not in (9, 10, 13) for b in h)
        want[k] = h.hex().upper().startswith(X.MAGIC) or bool(h) and (h.count(0) > len(h) // 100 or odd > len(h) * 30 // 100)
    found = spark.createDataFrame([*enumerate(heads), (99, None)], "k long, content binary").coalesce(1).select("k", X.is_binary(F.lit("x"), F.col("content")).alias("b"))
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["k"]: r["b"] for r in found.collect()} == want | {99: False}


def test_vocabulary_of_distinct_names(spark):
    """Words of names that come again, and words twice in a name; no set of names for each word."""
    names = ["red_red_bolt", "redBolt", "redBolt", "red", "", None, "x9y"] * 3 + ["bolt"]
    found = M.vocabulary(spark.createDataFrame([(n,) for n in names], "name string").coalesce(1))
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["word"]: (r["n"], r["holders"]) for r in found.collect()} == {"red": (15, 3), "bolt": (10, 3), "x": (3, 1), "9": (3, 1), "y": (3, 1)}


def test_rounds_send_no_tables_to_the_driver(spark):
    """Joins of a loop's rounds are by sorting also where a table is small enough to broadcast."""
    plans = []

    class Watched(Scratch):
        def save(self, df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().save(df, name)

    edges, direct = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long").coalesce(1), spark.createDataFrame([(3, 32)], "node long, mask long").coalesce(1)
    got = G.transitive_effects(edges, direct, M.PROPAGATED, Watched(spark, "t")).collect()
    assert {r["node"]: r["mask"] for r in got} == {1: 32, 2: 32, 3: 32}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def _scattered(n: int, m: int) -> list[tuple[int, int]]:
    rng = random.Random(n)
    return [(rng.randrange(n) * 7 - 20, rng.randrange(n) * 7 - 20) for _ in range(m)]


def test_communities_against_plain_moves():
    """The same moves as by tables of tables: loops on a node, edges both ways, several levels."""
    for n, m in ((5, 12), (30, 40), (60, 75), (200, 260)):
        edges = _scattered(n, m)
        src, dst = np.array(sorted(set(edges))).T
        got = dict(zip(*(x.tolist() for x in G.louvain(src, dst)), strict=True))
        assert got == plain_louvain(edges)


def test_paths_through_nodes_against_brute_force(spark):
    edges = {(a, b) for a, b in _scattered(12, 22)}
    nodes, want = {v for e in edges for v in e}, {}
    paths = {(v, v): [[v]] for v in nodes}
    for s in nodes:
        front = [[s]]
        while front:
            seen = {t for a, t in paths if a == s}
            front = [[*p, b] for p in front for a, b in edges if a == p[-1] and b not in seen]
            for p in front:
                paths.setdefault((s, p[-1]), []).append(p)
    for (s, t), found in paths.items():
        for p in found:
            for v in p[1:-1]:
                want[v] = want.get(v, 0.0) + 1 / len(found)
    scale = (len(nodes) - 1) * (len(nodes) - 2)
    made = spark.createDataFrame(list(edges), "src long, dst long").coalesce(1)
    got = {r["node"]: round(r["score"], 9) for r in G.betweenness(made).collect() if r["score"]}
    assert got == {v: round(x / scale, 9) for v, x in want.items()}
    assert inspect.signature(G.betweenness).parameters["most_edges"].default is None  # no bound unless asked for


def test_scores_of_names_are_dealt(spark, small):
    """Each name is scored once, above the deal, and only names that can be alike are compared by letters."""
    plan = catalog.queries()["h08_semantic_scores"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Repartition") < plan.index("Aggregate")
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(2))
        assert N._can_reach(a, b, 0.85) or N.jaro_winkler(a, b) < 0.85


def plain_louvain(edges):
    weight: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for a, b in set(edges):
        weight[a][b] += 1.0
        weight[b][a] += 1.0
    member = {v: v for v in weight}
    while True:
        total = sum(sum(x.values()) for x in weight.values()) or 1.0
        degree = {v: sum(x.values()) for v, x in weight.items()}
        place, load = {v: v for v in weight}, dict(degree)
        moved, changed = True, False
        while moved:
            moved = False
            for v in sorted(weight):
                near: dict[int, float] = defaultdict(float)
                for u, w in weight[v].items():
                    if u != v:
                        near[place[u]] += w
                load[place[v]] -= degree[v]
                gain = lambda c: near.get(c, 0.0) - load.get(c, 0.0) * degree[v] / total  # noqa: B023, E731
                best = min([*near, place[v]], key=lambda c: (-round(gain(c), 12), c))
                if gain(best) <= gain(place[v]) + 1e-12:
                    best = place[v]
                load[best] = load.get(best, 0.0) + degree[v]
                if best != place[v]:
                    place[v], moved, changed = best, True, True
        member = {v: place[c] for v, c in member.items()}
        if not changed:
            break
        merged: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for v, x in weight.items():
            for u, w in x.items():
                merged[place[v]][place[u]] += w
        weight = merged
    least: dict[int, int] = {}
    for v in sorted(member):
        least.setdefault(member[v], v)
    return {v: least[c] for v, c in member.items()}


def test_similar_pairs_by_index_and_by_prefixes(spark, monkeypatch):
    """Both ways give what brute force gives; few sets on the right take no shuffle of the left."""
    rng = random.Random(9)
    made = [[(k, rng.sample("abcdefghij", rng.randrange(0, 7))) for k in range(60)] + [(99, None)] for _ in range(2)]
    left, right = (spark.createDataFrame(rows, "file_id long, tokens array<string>").coalesce(1) for rows in made)
    for least in (0.3, 0.5):
        want = {(i, j): round(len({*x} & {*y}) / len({*x} | {*y}), 6) for i, x in made[0] for j, y in made[1] if x and y and round(len({*x} & {*y}) / len({*x} | {*y}), 6) >= least}
        found = D.similar_pairs(left, right, least)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {(r["left_id"], r["right_id"]): r["similarity"] for r in found.collect()} == want
        with monkeypatch.context() as m:
            m.setattr(D, "MOST_HELD", 5)
            assert {(r["left_id"], r["right_id"]): r["similarity"] for r in D.similar_pairs(left, right, least).collect()} == want
