import textwrap

import pytest
from pyspark.sql import functions as F

from loomwright.plans import ask, index
from loomwright.sources import files, labelled, python_code, tables


@pytest.fixture
def tree(tmp_path):
    def put(path, body):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else textwrap.dedent(body).encode())

    put("src/pkg/__init__.py", "")
    put("src/pkg/sub/util.py", "def helper():\n    return 1\n")
    put("src/pkg/app.py", '''
        """Doc of the module."""
        import os
        from .sub.util import helper as h

        class Base:
            def run(self):
                return 0

        class App(Base):
            """An app."""
            name: str = ""

            def __init__(self):
                self.base = Base()

            def go(self, other: "Base | None"):
                self.base.run()
                other.run()
                self.stop()
                if h() and os.path:
                    return [x for x in ()]

        def main():
            a = App()
            a.go(None)
            a.invented()
        ''')
    put("web/index.ts", "let a = 1\n" * 5)
    put("bin.go", b"\x00\x01")
    put("min.js", "x" * 7000)
    put("node_modules/x.ts", "let a\n")
    put("README.md", "hello\n")
    put("notes.unknown", "hello\n")
    return str(tmp_path)


def test_scan_and_gates(spark, tree):
    found = files.discover(files.scan(spark, tree))
    assert {r["file_path"]: r["language"] for r in found.collect()} == {"README.md": "markdown", "bin.go": "go", "min.js": "javascript", "src/pkg/__init__.py": "python", "src/pkg/app.py": "python", "src/pkg/sub/util.py": "python", "web/index.ts": "typescript"}
    assert [r["file_path"] for r in found.orderBy("ordinal").collect()][0] == "README.md"
    assert {r["file_path"] for r in files.readable(found).collect()} >= {"README.md", "web/index.ts"}
    assert not {"bin.go", "min.js"} & {r["file_path"] for r in files.readable(found).collect()}


@pytest.mark.parametrize(("n", "windows"), [(0, []), (3, [(0, 3)]), (5, [(0, 3), (2, 5)]), (6, [(0, 3), (2, 5), (4, 6)])])
def test_windows(n, windows):
    assert files.line_windows(["x\n"] * n, max_lines=3, max_chars=100, overlap=1) == windows


def test_windows_by_characters():
    assert files.line_windows(["x" * 8, "y" * 8, "z"], max_lines=9, max_chars=10, overlap=0) == [(0, 1), (1, 3)]


def test_split_span():
    lines = ["x\n"] * 400
    lines[139] = "\n"
    assert python_code.split_span(lines, 1, 150) == [(1, 150)]
    assert python_code.split_span(lines, 1, 320) == [(1, 140), (141, 290), (291, 320)]


def test_cyclomatic():
    assert python_code.cyclomatic("if a and b:\n    pass\nelif c:\n    pass") == 4
    assert python_code.cyclomatic("    def f(self): pass") == 0


def test_graph_of_code(spark, tree):
    found = files.readable(files.discover(files.scan(spark, tree, glob="*.py")))
    named = python_code.name_modules(found)
    assert {r["file_path"]: r["module"] for r in named.collect()} == {"src/pkg/__init__.py": "pkg", "src/pkg/app.py": "pkg.app", "src/pkg/sub/util.py": "pkg.sub.util"}
    nodes, edges = python_code.code_graph(named)
    kinds = {r["symbol"]: r["kind"] for r in nodes.collect()}
    assert kinds["pkg.app.App.go"] == "method" and kinds["pkg.app.main"] == "function" and kinds["pkg.app"] == "module"
    have = {(r["src"], r["dst"], r["type"]) for r in edges.collect()}
    assert ("pkg.app.App", "pkg.app.Base", "inherits") in have
    assert ("pkg.app.App.go", "pkg.app.Base.run", "calls") in have
    assert ("pkg.app.App.go", "pkg.app.App.stop", "calls") in have  # self calls are taken as they are
    assert ("pkg.app.App.go", "pkg.sub.util.helper", "calls") in have
    assert ("pkg.app.main", "pkg.app.App.go", "calls") in have and ("pkg.app.main", "pkg.app.App", "calls") in have
    assert not any(d.endswith("invented") for _, d, _ in have)
    assert ("pkg.app", "pkg.sub.util.helper", "imports") in have and ("pkg.app", "os", "imports") in have


def test_code_chunks(spark, tree):
    named = python_code.name_modules(files.readable(files.discover(files.scan(spark, tree, glob="*.py"))))
    rows = {r["symbol"]: r for r in python_code.code_chunks(named).where("file_path = 'src/pkg/app.py'").collect()}
    assert set(rows) == {"pkg.app", "pkg.app.Base", "pkg.app.Base.run", "pkg.app.App", "pkg.app.App.__init__", "pkg.app.App.go", "pkg.app.main"}
    assert rows["pkg.app.App"]["content"].splitlines()[:2] == ["class App(Base):", "    An app."]
    assert "import os" in rows["pkg.app"]["content"] and "def main" not in rows["pkg.app"]["content"]
    assert rows["pkg.app.main"]["signature"] == "def main():"


def test_index_and_publish(spark, tree, tmp_path):
    built = index.build(spark, tree, "o/n@1")
    assert built.status == "indexed"
    assert {"web/index.ts", "src/pkg/app.py", "README.md"} <= {r["file_path"] for r in built.chunks.select("file_path").distinct().collect()}
    out = str(tmp_path / "store")
    assert index.publish(spark, built, out, "o/n@1", "u", "1") == "indexed"
    assert index.publish(spark, built, out, "o/n@1", "u", "1") == "already_indexed"
    assert tables.read_chunks(spark, f"{out}/chunks", "o/n@1").count() == built.chunks.count()
    assert index.build(spark, tree, "o/n@1", max_loc=3).status == "too_large"
    assert "# symbol: pkg.app.main" in built.chunks.where("symbol = 'pkg.app.main'").first()["enriched_text"]


def test_empty_snapshot_is_refused(spark, tmp_path):
    empty = spark.createDataFrame([], "repo_id string")
    with pytest.raises(ValueError):
        tables.write_snapshot({"chunks": empty}, str(tmp_path / "s"), empty)


def test_ask(spark):
    chunks = spark.createDataFrame([(1, "tests/t.py", "t.only_here", "only_here does it", 1, 2, [1.0, 0.0]), (2, "src/a.py", "a.handle_request", "def handle_request", 1, 2, [0.0, 1.0])], "chunk_id int, file_path string, symbol string, content string, start_line int, end_line int, embedding array<double>")
    qs = spark.createDataFrame([("q1", "where is handle_request", None), ("q2", "only_here", None)], "query_id string, query string, q array<double>")
    found = ask.context(chunks, qs)
    assert {(r["query_id"], r["chunk_id"]) for r in found.collect()} == {("q1", 2), ("q2", 1)}
    prompt = {r["query_id"]: r["prompt"] for r in ask.prompts(found).collect()}["q1"]
    assert prompt.startswith("Chunk [0]:\n<source file=src/a.py:1-2 symbol='a.handle_request'>")
    answers = spark.createDataFrame([("q1", "It is here [0].\nNo source")], "query_id string, answer string")
    assert [(r["text"], r["status"]) for r in ask.claims(answers, found).orderBy("line").collect()] == [("It is here.", None), ("No source", "unverified")]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"question": "a"}\n\n{"question": "b"}\n')
    assert labelled.checked(labelled.json_rows(labelled.numbered_lines(spark, str(p)), "question string")).count() == 2
    p.write_text('{"question": "a"}\n[1\n')
    with pytest.raises(Exception):
        labelled.checked(labelled.json_rows(labelled.numbered_lines(spark, str(p)), "question string")).collect()


def test_stream_ledger(spark, tmp_path):
    from loomwright.streaming import usage

    rows = [("s", "a", "reserved", 1), ("s", "b", "reserved", 2), ("s", "a", "failed", 3), ("s", "b", "reserved", 4)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "session_id string, resource_id string, status string, created_at int").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("session_id string, resource_id string, status string, created_at int").parquet(src)
    q = usage.allowance_stream(stream).writeStream.outputMode("update").format("memory").queryName("ledger").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["resource_id"], r["granted"]) for r in spark.table("ledger").collect()] == [("a", True), ("b", False), ("a", False), ("b", True)]


def test_windows_of_events(spark, sf):
    from loomwright.streaming import usage

    events = spark.read.parquet(f"{sf}/events.parquet")
    assert usage.windowed(events).agg(F.sum("n")).first()[0] == events.count()
    assert usage.sessions(events).agg(F.sum("n")).first()[0] == events.count()
