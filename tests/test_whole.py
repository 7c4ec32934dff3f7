"""Queries that leave no rows out."""

import itertools
import random
import re

import pytest

from corpusloom import catalog
from corpusloom.functions.names import jaro_winkler
from corpusloom.operators import facts
from corpusloom.operators import graph as G
from corpusloom.operators import metrics as M
from corpusloom.operators import search as S
from corpusloom.operators import similar
from corpusloom.operators import symbols as Y
from corpusloom.plans import code
from corpusloom.runtime import Scratch, read
from corpusloom.streaming import incremental as N


def test_edges_of_all_rows(spark, small):
    want = {(r["l_suppkey"], r["l_partkey"] % 100 + 1) for r in read(spark, small, "lineitem").collect()}
    rows = catalog.queries()["f01_call_graph"](spark, small).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    want = {(r["c_custkey"], r["c_custkey"] // 4 + r["c_nationkey"] % 5 + 1) for r in read(spark, small, "customer").collect()}
    assert {tuple(r) for r in code.sparse_calls(spark, small).collect()} == want
    assert {r["node"] for r in catalog.queries()["f03_incoming_reach"](spark, small).collect()} == {v for e in want for v in e}


def test_manifest_of_all_entries(spark, small):
    want = {r["s_suppkey"] for r in read(spark, small, "supplier").collect()}
    assert {r["entry"] for r in catalog.queries()["f12_manifest_expansion"](spark, small).collect()} == want


def test_reach_of_a_long_chain(spark):
    line = spark.createDataFrame([(k, k + 1) for k in range(70)], "src long, dst long").coalesce(1)
    assert {r["node"]: r["callers"] for r in G.reach(line, Scratch(spark, "t")).collect()} == {k: k for k in range(71)}


def test_depth_of_a_long_chain(spark):
    line = spark.createDataFrame([(k, k + 1) for k in range(103)] + [(200, 201), (201, 200), (201, 202)], "src long, dst long").coalesce(1)
    assert {r["node"]: r["depth"] for r in facts.dependency_depth(line, Scratch(spark, "t")).collect()} == {k: k for k in range(104)}


def test_similar_names_against_brute_force(spark):
    rng, names = random.Random(6), {"counter", "xcounter", "handler", "ahndler", "a", "ab", "abc", "", "naïve日本", "naïve日木"}
    for word in ("getUserName", "parse_config", "handler", "readAll", "counterValue"):
        for _ in range(25):
            chars = list(word)
            for _ in range(rng.randrange(1, 4)):
                at, what = rng.randrange(len(chars)), rng.randrange(3)
                chars[at : at + 1] = [[], [chars[at], rng.choice("abxyz")], [rng.choice("abxyz")]][what]
            names.add("".join(chars))
    rows = [(kind, n) for kind in ("function", "class") for n in sorted(names) if kind == "function" or rng.random() < 0.5]
    frame = spark.createDataFrame([*rows, ("class", None)], "type string, name string")
    for least in (0.9, 0.8, 0.6):
        got = [(r["type"], r["a"], r["b"]) for r in similar.similar_names(frame, least).collect()]
        want = {(t, a, b) for t in ("function", "class") for a, b in itertools.permutations([n for k, n in rows if k == t], 2) if a < b and jaro_winkler(a, b) >= least}
        assert set(got) == want and len(got) == len(want)
        assert least < 0.9 or {("function", "counter", "xcounter"), ("function", "ahndler", "handler")} <= want


def test_label_modes_and_directions(spark):
    pairs, seeds = [(1, 2), (2, 1), (2, 3), (3, 4), (5, 3), (6, 6)], {1: 0.5, 5: 1.0}
    edges, start = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame(list(seeds.items()), "node long, strength double")
    for direction in ("down", "up", "both"):
        ways = pairs * (direction != "up") + [(b, a) for a, b in pairs] * (direction != "down")
        for mode in ("reachability", "accumulation", "max"):
            want = dict(seeds)
            for _ in range(3):
                old = dict(want)
                for a, b in ways:
                    if a in old:
                        if mode == "accumulation":
                            want[b] = want.get(b, 0.0) + old[a]
                        elif b not in want or mode == "max":
                            want[b] = 1.0 if mode == "reachability" else max(want.get(b, 0.0), old[a])
            got = G.propagate_labels(edges, start, Scratch(spark, "t"), rounds=3, mode=mode, direction=direction).collect()
            assert {r["node"]: round(r["strength"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}, (mode, direction)


def test_hits_past_the_cap_of_a_file(spark, tmp_path):
    body = "".join(f"def f{k}():\n    return needle({k})\n\n" for k in range(150))
    (tmp_path / "a.py").write_text(body)
    from corpusloom.api import Corpus
    from corpusloom.sources.files import scan

    corpus = Corpus(spark, scan(spark, f"file://{tmp_path}"))
    assert corpus.search("needle", max=1000, kinds=["function"]).count() == 150
    assert corpus.query("kind:function symbol:f14 needle", max=1000).count() == 11


def test_manifest_past_its_bound(spark, tmp_path, monkeypatch):
    from corpusloom.sources import files as R

    monkeypatch.setattr(R, "MOST_ENTRIES", 5)
    R.write_manifest(spark.range(5), f"file://{tmp_path}/m")
    assert R.read_manifest(spark, f"file://{tmp_path}/m").count() == 5
    with pytest.raises(ValueError, match="at most 5"):
        R.write_manifest(spark.range(6), f"file://{tmp_path}/n")


def test_batch_that_ends_before_its_list(spark, tmp_path):
    """Nothing leaves the table; the next batch goes on from the last committed version; one file is one bucket."""
    folder = str(tmp_path / "t")
    put = lambda rows: spark.createDataFrame(rows, N.EVENT_SCHEMA)
    assert N.apply_batch(spark, folder, put([(k, f"p{k}", f"text {k}", False, 1) for k in range(40)]), 1) == 40
    put([(3, "p3", "half written", False, 2)]).write.parquet(f"{folder}/v00000002/data/bucket=0")
    assert N.current(spark, folder).count() == 40
    assert N.apply_batch(spark, folder, put([(5, "p5", "new", False, 3)]), 3) == 1
    got = {r["file_id"]: r["content"] for r in N.current(spark, folder).collect()}
    assert got == {k: f"text {k}" for k in range(40)} | {5: "new"}
    assert len([p for p in (tmp_path / "t/v00000003/data").iterdir() if p.is_dir()]) == 1
    assert N.apply_batch(spark, folder, put([(k, f"p{k}", None, True, 4) for k in range(40)]), 4) == 40
    assert N.current(spark, folder).count() == 0


def test_effects_of_callees(spark):
    """Closure writes stay; confidence is decayed by the calls to the nearest source, not below the floor."""
    calls = [(k, k + 1) for k in range(40)] + [(100, 101)]
    masks = [(40, 32), (101, 8)]
    edges, direct = spark.createDataFrame(calls, "src long, dst long").coalesce(1), spark.createDataFrame(masks, "node long, mask long").coalesce(1)
    got = {r["node"]: (r["mask"], round(r["confidence"], 9)) for r in G.transitive_effects(edges, direct, M.PROPAGATED, Scratch(spark, "t")).collect()}
    assert got == {k: (32, round(max(0.3, 0.95 ** (40 - k)), 9)) for k in range(41)} | {101: (8, 0.0)}


def test_references_by_receiver_and_family(spark):
    symbols = spark.createDataFrame(
        [(1, "Close", 10, "go", True, False, "File"), (2, "Close", 11, "go", True, False, "Conn"), (3, "Close", 12, "python", True, False, None), (4, "add", 13, "c_family", False, True, None), (5, "add", 14, "c_family", False, False, None)],
        "symbol_id long, name string, file_id long, family string, is_exported boolean, is_test boolean, receiver_type string",
    )
    asked = [(1, "Conn.Close", 20, "go"), (2, "Other.Close", 20, "go"), (3, "Close", 11, "go"), (4, "add", 21, "python"), (5, "add", 22, "c_family"), (6, "add", 23, "unknown"), (7, "add", 24, "c_family"), (8, "gone", 24, "go")]
    refs = spark.createDataFrame(asked, "ref_id long, referenced_name string, file_id long, family string")
    imports = spark.createDataFrame([(24, "add")], "file_id long, imported_name string")
    got = {r["ref_id"]: r["target_symbol"] for r in Y.resolve(refs, symbols, imports).collect()}
    assert got == {1: 2, 2: 1, 3: 2, 5: 5, 6: 5, 7: 4}


def test_seeds_of_nested_patterns():
    for pattern, seed in ((r"((abc)?def)?xyz", "xyz"), (r"\x41bcd", "Abcd"), (r"(abcd)e", ""), (r"foo.*barbaz[0-9]", "barbaz"), (r"a|bcd", ""), (r"colou?r", "colo"), (r"abc{2}def", "def"), (r"a\|bcd", "a|bcd")):
        assert S.literal_seed(pattern) == seed, pattern
    assert S.checked_regex("[]abc]+q") is None and S.checked_regex("[a[b]]") is None
    rng = random.Random(8)
    found = 0
    for _ in range(20_000):
        pattern = "".join(rng.choices(["a", "b", "abc", "cab", "(", ")", "[", "]", "?", "|", "{2}", "{", "}", "\\", ".", "*", "+", "^", "$", "\\x61", "\\."], k=rng.randrange(1, 8)))
        if S.checked_regex(pattern) is None:
            continue
        seed = S.literal_seed(pattern)
        for _ in range(20):
            text = "".join(rng.choices("abc.|", k=rng.randrange(0, 9)))
            if seed and re.search(pattern, text):
                found += 1
                assert seed in text, (pattern, text)
    assert found > 100
