"""The corpus object over a small folder."""

import subprocess

import pytest

from corpusloom.api import TOOLS, Corpus
from corpusloom.operators import facts as X
from corpusloom.operators import search as S
from corpusloom.sources.files import Config

FILES = {
    "api/server.py": "from core.store import save\n\n# @code:labels[critical]\ndef handle(request):\n    for x in request:\n        save(x)\n    return save(request)\n",
    "core/store.py": "import os\n\nclass Base(object):\n    pass\n\nclass Store(Base):\n    def put(self, x):\n        return write_row(x)\n\ndef save(x):\n    if x and x > 1:\n        return write_row(x)\n    return None\n\ndef write_row(x):\n    return open(x)\n",
    "core/store_test.py": "from core.store import save\n\ndef test_save():\n    assert save(1) is None\n",
    "web/app.ts": "export class App extends Base implements One, Two {\n}\n",
    "README.md": "# save things\n",
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=A", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "all")
    made = Corpus.from_folder(spark, f"file://{root}", Config(synonyms=(("save", "store"),)))
    made.root = str(root)
    return made


def test_search(corpus):
    rows = corpus.search("save", max=50).collect()
    assert [r["path"] for r in rows][-1] == "README.md" and len(rows) == 8
    same = corpus.search("save", max=50, indexed=True).collect()
    assert rows == same
    assert {r["path"] for r in corpus.search("save", max=50, scopes=["core"]).collect()} == {"core/store.py", "core/store_test.py"}
    assert {r["line"] for r in corpus.search("write_row", kinds=["method"]).collect()} == {8}
    assert corpus.search("def .*row", regex=True).count() == 1 and corpus.search("import (", regex=True).count() == 0
    assert {r["path"] for r in corpus.query("file:*.py save -from", 50).collect()} == {"api/server.py", "core/store.py", "core/store_test.py"}
    assert corpus.search("save", max=50, synonyms=True).count() > 8
    assert corpus.grep("class Store", 1, 1).count() == 3
    with pytest.raises(ValueError, match="empty"):
        corpus.search("")


def test_symbols(corpus):
    assert [r["name"] for r in corpus.list_symbols("function").collect()] == ["handle", "save", "test_save", "write_row"]
    assert corpus.definition("save").first()["path"] == "core/store.py"
    assert {(r["path"], r["line"]) for r in corpus.usages("save").collect()} == {("api/server.py", 6), ("api/server.py", 7), ("core/store_test.py", 4)}
    assert {(r["depth"], r["name"]) for r in corpus.tree("handle").collect()} == {(0, "handle"), (1, "save"), (2, "write_row")}
    parts = {(r["part"], r["name"]) for r in corpus.get_context("save").collect()}
    assert {("caller", "handle"), ("caller", "test_save"), ("callee", "write_row"), ("file", "core/store.py")} <= parts
    assert [r["name"] for r in corpus.browse_file("core/store.py").collect()] == ["Base", "Store", "put", "save", "write_row"]
    assert corpus.find_files("store").first()["path"] == "core/store.py"
    assert {r["symbol_id"] for r in corpus.context(["save"], 100_000).collect()}


def test_analysis(corpus):
    effects = {r["name"]: (r["own"], r["mask"]) for r in corpus.side_effects().collect()}
    # 32 is the surveyed bit of I/O; write_row calls open, and no surveyed prefix begins its own name.
    assert effects["write_row"] == (32, 32) and effects["handle"][1] == 32 and effects["save"] == (0, 32)
    assert {r["name"]: r["how"] for r in corpus.semantic_annotations("critical").collect()} == {"handle": "direct", "save": "propagated", "write_row": "propagated"}
    for mode in ("overview", "statistics", "structure", "modules", "coupling", "smells", "hotspots", "vocabulary", "cycles", "load-bearing", "anti-patterns"):
        assert corpus.code_insight(mode).count() >= 0
    assert {r["language"]: r["symbols"] for r in corpus.index_stats().collect()} == {"python": 7, "typescript": 1, "unknown": 0}
    assert {r["table"]: r["rows"] for r in corpus.debug_info().collect()}["files"] == 5
    assert corpus.info().count() == len(TOOLS) and all(hasattr(corpus, t) for t in TOOLS)
    for report in ("churn", "hotspots", "collisions", "ownership", "active"):
        assert corpus.git_analysis(corpus.root, report).count() >= 0
    assert corpus.git_analysis(corpus.root).count() == len(FILES)


def test_facts(corpus):
    got = {(r["type"], r["super"], r["kind"]) for r in X.type_relations(corpus.lines).collect()}
    assert got == {("Store", "Base", "extends"), ("App", "Base", "extends"), ("App", "One", "implements"), ("App", "Two", "implements")}
    assert [(r["line"], r["calls"]) for r in X.loops(corpus.files).collect()] == [(5, 1)]
    assert X.docstring_lines(S.lines(corpus.files)).count() == 0
    assert X.nesting(corpus.files).where("nesting > 0").count() == 0
    assert X.check_request({"max": -1, "zz": 1}, {"max": int, "pattern": str}, ("pattern",)) == ["unknown parameter zz", "missing parameter pattern", "max must not be negative"]


def test_inspect_symbol(corpus):
    parts = lambda name: {(r["part"], r["name"], r["detail"] is not None) for r in corpus.inspect_symbol(name).where("part in ('parent_class', 'ancestor', 'variable', 'entry_point')").collect()}
    assert parts("Store") == {("parent_class", "Base", True), ("ancestor", "Base", True)}
    assert parts("App") == {("parent_class", "Base", False), ("parent_class", "One", False), ("parent_class", "Two", False)}
    assert "caller" in {r["part"] for r in corpus.inspect_symbol("save").collect()}
    assert [r["module"] for r in corpus.imported_modules("core/store.py").collect()] == ["os"]
