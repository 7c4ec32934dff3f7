"""Operators that SQL can't state, and rules on small inputs."""

import itertools
import json
import random
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import names as N
from corpusloom.functions import text as T
from corpusloom.operators import graph as G
from corpusloom.operators import history as H
from corpusloom.operators import index as X
from corpusloom.operators import search as S
from corpusloom.operators import symbols as Y
from corpusloom.runtime import Scratch
from corpusloom.sources import files as R
from corpusloom.streaming import incremental as I

GO = """package main

// Add sums two numbers.
func Add(a int, b int) int {
\tif a > b && b > 0 {
\t\treturn a
\t}
\treturn helper(a, b)
}

type Shape interface {
\tArea() float64
}

func (s *Square) Area() float64 {
\treturn s.side
}
"""
PY = '''import os
from pkg.util import one, two

LIMIT = 3

class Box:
    """A box."""

    def size(self, scale=1, *more):
        for x in more:
            if x and scale or LIMIT:
                return one(x)
        return 0

def _hidden():
    pass
'''


def frame(spark, files):
    return spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(files)], "file_id long, path string, content string")


def test_extracted_symbols(spark):
    got = {r["name"]: r for r in Y.extract_symbols(frame(spark, [("a.go", GO), ("b.py", PY), ("c.py", "def broken(:"), ("d.xyz", GO)])).collect()}
    assert {n: r["type"] for n, r in got.items()} == {"Add": "function", "Shape": "interface", "Area": "method", "Box": "class", "size": "method", "_hidden": "function", "LIMIT": "variable"}
    assert (got["Add"]["line"], got["Add"]["end_line"], got["Add"]["complexity"], got["Add"]["parameter_count"], got["Add"]["doc_comment"]) == (4, 9, 3, 2, "Add sums two numbers.")
    assert (got["size"]["complexity"], got["size"]["parameter_count"], got["Box"]["doc_comment"], got["_hidden"]["is_exported"]) == (5, 3, "A box.", False)


@pytest.mark.parametrize(
    ("family", "source", "want"),
    [
        ("rust", "pub fn go(a: i32) -> i32 {\n  a\n}\nstruct P {\n}\nimpl P {\n  fn inner(&self) {}\n}\n", [("go", "function"), ("P", "struct"), ("P", "impl"), ("inner", "function")]),
        ("js_ts", "export class A {\n}\nconst f = (x) => {\n}\nexport function g() {}\ninterface I {}\n", [("A", "class"), ("f", "function"), ("g", "function"), ("I", "interface")]),
        ("java", "public class A {\n  public int add(int a, int b) {\n    return a;\n  }\n}\nenum E {}\n", [("A", "class"), ("add", "method"), ("E", "enum")]),
        ("ruby", "module M\n  class A\n    def go\n      1\n    end\n  end\nend\n", [("M", "module"), ("A", "class"), ("go", "method")]),
    ],
)
def test_extraction_by_family(family, source, want):
    assert [(s[0], s[1]) for s in Y.extract(source, family)] == want


def test_references_and_imports(spark):
    files = frame(spark, [("src/b.py", PY), ("src/pkg/util.py", "def one(x):\n    return x\n"), ("a.go", GO), ("m.ts", "import { x } from './pkg/util'\n")])
    calls = {(r["file_id"], r["referenced_name"]) for r in Y.extract_references(files).collect()}
    assert {(0, "one"), (2, "helper")} <= calls and (2, "Add") not in calls and (1, "one") not in calls
    found = {(r["file_id"], r["import_path"]) for r in Y.imports(S.lines(files)).collect()}
    assert found == {(0, "os"), (0, "pkg.util"), (3, "./pkg/util")}
    links = {(r["file_id"], r["target_file"]) for r in Y.import_links(Y.imports(S.lines(files)), files).collect()}
    assert links == {(0, 1), (3, 1)}
    marks = Y.annotations(S.lines(frame(spark, [("a.py", "# @code:labels[critical, slow] @code:owner team\nx = 1")]))).collect()
    assert {(m["key"], tuple(m["values"])) for m in marks} == {("labels", ("critical", "slow")), ("owner", ("team",))}
    assert [(r["line"], r["n"]) for r in Y.doc_comments(S.lines(frame(spark, [("a.go", GO)]))).collect()] == [(4, 1)]


def test_indexed_search_equals_scan(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("d/"), "source").alias("path"), F.col("text").alias("content"))
    path = f"file://{tmp_path}/grams"
    X.write_grams(X.all_trigrams(docs), path)
    for pattern in ("tion", "there", "zzqq", "é l"):
        by_index = docs.join(X.lookup(spark, path, pattern), "file_id", "left_semi").where(F.col("content").contains(pattern))
        assert {r[0] for r in by_index.select("file_id").collect()} == {r[0] for r in docs.where(F.col("content").contains(pattern)).select("file_id").collect()}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB_1. *", max_size=14))
def test_seed_is_in_every_match(pattern):
    import re

    if S.checked_regex(pattern) is None:
        return
    seed = S.literal_seed(pattern)
    rng = random.Random(pattern)
    for _ in range(20):
        line = "".join(rng.choice("abAB_1. ") for _ in range(20)) + pattern.replace("*", "").replace(".", "b")
        if re.search(pattern, line) and seed:
            assert seed in line


def test_regex_rules():
    assert S.checked_regex("(a)\\1") is None and S.checked_regex("(?<=a)b") is None and S.checked_regex("a(") is None and S.checked_regex("a+b") == "a+b"
    assert S.literal_seed("foo.*barbaz[0-9]") == "barbaz" and S.literal_seed("a|bcd") == "" and S.literal_seed("colou?r") == "colo"
    assert S.looks_like_regex("a.*b") and not S.looks_like_regex("plain text")
    assert S.parse_query('file:*.py kind:class word -not "a phrase"') == {"terms": ["word", "a phrase"], "excluded": ["not"], "file": ["*.py"], "kind": ["class"]}
    assert S.lexical_kind('x = "the end"  # the rest', 5) == "string" and S.lexical_kind("a() // b", 7) == "comment" and S.lexical_kind("a b", 2) == "code"
    assert S.expand_synonyms("find user", [["find", "get", "fetch"]]) == ["find user", "get user", "fetch user"]


def test_globs_and_ignores(spark):
    import re

    assert re.search(T.glob_regex("**/*.py"), "a/b/c.py") and re.search(T.glob_regex("**/*.py"), "c.py") and not re.search(T.glob_regex("*.py"), "a/c.py")
    paths = spark.createDataFrame([(p,) for p in ("a.log", "keep.log", "build/x.o", "src/build/y.o", "doc/a.txt", "sub/doc/a.txt")], "path string")
    got = {r["path"]: r["ignored"] for r in X.ignored(paths, ["*.log", "!keep.log", "build/", "/doc/*.txt"]).collect()}
    assert got == {"a.log": True, "keep.log": False, "build/x.o": True, "src/build/y.o": True, "doc/a.txt": True, "sub/doc/a.txt": False}


def test_binary(spark):
    rows = [("a.png", b"x"), ("a.txt", b"plain text"), ("b.txt", b"\x7fELF...."), ("c.txt", b"a\0b\0c\0"), ("x.min.js", b"var a"), ("e.txt", b"")]
    got = spark.createDataFrame(rows, "path string, content binary").select("path", X.is_binary(F.col("path"), F.col("content")).alias("b")).collect()
    assert [r["b"] for r in got] == [True, False, True, True, False, False]


def test_stems_and_ratios():
    words = {"running": "run", "generalizations": "general", "happily": "happili", "flies": "fli", "sky": "sky", "hopping": "hop", "hoping": "hope", "agreed": "agre", "national": "nation", "relational": "relat", "caresses": "caress", "ties": "tie", "cries": "cri", "dying": "die"}
    assert {w: N.porter2(w) for w in words} == words
    assert round(N.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611 and round(N.jaro_winkler("DIXON", "DICKSONX"), 4) == 0.8133 and N.jaro_winkler("", "a") == 0.0
    assert N.indel_ratio("abcd", "abxd") == 0.75 and N.token_set_ratio("new york mets", "mets york new") == 1.0
    assert N.semantic_score("getUser", "getUser") == (1.0, "exact") and N.semantic_score("user", "getUserName")[1] == "substring" and N.semantic_score("zz", "abc") == (0.0, "none")
    assert all(N.decode_id(N.encode_id(n)) == n for n in (0, 1, 62, 63, 10**15))


def test_log_parsing(spark):
    log = ["abcdef1|Ann|a@x|1700000000|one", "", "3\t1\tsrc/{old => new}/a.py", "-\t-\tb.png", "abcdef2|Bob|b@x|1700000100|two", "", "5\t0\ta.py => b.py"]
    rows = spark.createDataFrame([(0, k, v) for k, v in enumerate(log)], "log int, pos long, value string")
    got = sorted(tuple(r) for r in H.parse_log(rows).select("hash", "author", "path", "added", "deleted").collect())
    assert got == [("abcdef1", "Ann", "b.png", 0, 0), ("abcdef1", "Ann", "src/new/a.py", 3, 1), ("abcdef2", "Bob", "b.py", 5, 0)]
    assert H.window_days("quarter") == 90 and H.window_days("?") == 30


def closure(pairs):
    reach = {a: {b for x, b in pairs if x == a} for a in {v for p in pairs for v in p}}
    for k in reach:
        for i in reach:
            if k in reach[i]:
                reach[i] |= reach[k]
    return reach


def test_graph_against_brute_force(spark):
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(18)})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    reach = closure(pairs)
    want = {v: {u for u in reach if v in reach[u] and u in reach[v]} | {v} for v in reach}
    got = {r["node"]: r["component"] for r in G.components(edges, Scratch(spark, "t")).collect()}
    assert {v: min(s) for v, s in want.items()} == got
    callers = {r["node"]: r["callers"] for r in G.reach(edges, Scratch(spark, "t")).collect()}
    assert callers == {v: sum(v in reach[u] for u in reach) for v in reach}


def test_betweenness_and_communities(spark):
    line = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    got = {r["node"]: round(r["score"], 6) for r in G.betweenness(line).collect()}
    assert got[2] == got[3] == round(2 / 6, 6)
    with pytest.raises(ValueError, match="over the bound of 2"):
        G.betweenness(line, most_edges=2)
    two = [(a, b) for base in (0, 10) for a, b in itertools.combinations(range(base, base + 5), 2)] + [(0, 10)]
    member = {r["node"]: r["community"] for r in G.communities(spark.createDataFrame(two, "src long, dst long")).collect()}
    assert {member[v] for v in range(5)} == {0} and {member[v] for v in range(10, 15)} == {10}


def test_incremental_stream(spark, tmp_path):
    events, folder, mark = (str(tmp_path / n) for n in ("events", "table", "mark"))

    def send(rows):
        spark.createDataFrame(rows, I.EVENT_SCHEMA).coalesce(1).write.mode("append").json(events)
        query = I.watch(spark, events, folder, mark, once=True)
        query.awaitTermination()

    send([(1, "a", "one", False, 1), (2, "b", "two", False, 1), (1, "a", "uno", False, 2)])
    pinned = I.current(spark, folder)
    assert sorted(r["content"] for r in pinned.collect()) == ["two", "uno"]
    send([(2, "b", None, True, 3), (3, "c", "three", False, 3)])
    assert sorted(r["content"] for r in I.current(spark, folder).collect()) == ["three", "uno"]
    assert sorted(r["content"] for r in pinned.collect()) == ["two", "uno"]  # a reader keeps its version
    assert I.apply_batch(spark, folder, spark.createDataFrame([(3, "c", "three", False, 4)], I.EVENT_SCHEMA), 9) == 0


def test_sources(spark, tmp_path):
    root = tmp_path / "r"
    for name, text in {"a.py": PY, "sub/b.md": "# hi", ".hidden/c.py": "x", "node_modules/d.js": "x", "e.bin": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    assert [r["path"] for r in R.scan(spark, f"file://{root}").collect()] == ["a.py", "sub/b.md"]
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=A", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "a.py")
    run("commit", "-qm", "one")
    (root / "a.py").write_text(PY + "\nx = 2\n")
    assert [tuple(r) for r in R.git_changes(spark, str(root)).collect()] == [("M", "a.py", None)]
    assert R.git_content(str(root), "HEAD", "a.py") == PY
    assert [(r["author"], r["path"], r["added"]) for r in H.parse_log(R.git_log(spark, str(root))).collect()] == [("A", "a.py", PY.count("\n"))]
    R.write_manifest(spark.createDataFrame([(1, "x")], "id long, name string"), f"file://{tmp_path}/m")
    assert [tuple(r) for r in R.read_manifest(spark, f"file://{tmp_path}/m").collect()] == [(1, "x")]
    R.export_json(spark.createDataFrame([(1, 2)], "src long, dst long"), f"file://{tmp_path}/j")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("part*"))) == {"src": 1, "dst": 2}
    R.export_graph(spark.createDataFrame([(1, 2)], "src long, dst long"), f"file://{tmp_path}/g")
    assert '"1" -> "2";' in "".join(p.read_text() for p in (tmp_path / "g").glob("part*"))


def test_config():
    got = R.parse_config('index {\n  max-file-size 100 // small\n  exclude "**/x/**" "y"\n}\nsynonyms {\n  group "get" "fetch"\n}\n')
    assert got.max_file_size == 100 and got.exclude == ("**/x/**", "y") and got.synonyms == (("get", "fetch"),)
    with pytest.raises(ValueError, match="max_results"):
        R.parse_config("max-results lots")
