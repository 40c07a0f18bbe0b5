"""Python sources: symbols, chunks, import and call edges, from the standard parser.

Files are parsed where they lie. Edges need to know which names other files define; that table is
joined to the candidate targets, so neither it nor the candidates pass through the driver.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MAX_CHUNK_LINES

CHUNKS = "file_path string, symbol string, kind string, start_line int, end_line int, content string, signature string, decorators array<string>, docstring string, bases array<string>"
EDGES = "module string, src string, type string, candidates array<string>, trusted boolean"


def split_span(lines: list[str], start: int, end: int, limit: int = MAX_CHUNK_LINES) -> list[tuple[int, int]]:
    """Consecutive spans of at most `limit` lines, each ending at its last blank line if it has one."""
    spans = []
    while end - start >= limit:
        last = start + limit - 1
        blank = next((i for i in range(last, start, -1) if not lines[i - 1].strip()), last)
        spans.append((start, blank))
        start = blank + 1
    return [*spans, (start, end)]


def cyclomatic(source: str) -> int:
    """Decision points plus one; 0 for text that does not parse on its own."""
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError):
        return 0
    one = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)
    loops = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
    return 1 + sum(isinstance(n, one) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) + (len(n.generators) if isinstance(n, loops) else 0) for n in nodes)


def _first_line(node) -> int:
    return min([node.lineno, *(d.lineno for d in node.decorator_list)])


def _signature(node, lines: list[str]) -> str:
    head = " ".join(x.strip() for x in lines[node.lineno - 1 : node.body[0].lineno - 1] or [lines[node.lineno - 1]])
    if node.body[0].lineno == node.lineno:
        head = lines[node.lineno - 1][: node.body[0].col_offset].strip()
    return head.rstrip().rstrip(":").rstrip() + ":"


def file_chunks(path: str, module: str, source: str) -> list[tuple]:
    """Chunks of one file: what is left of the module, classes as headers, functions and methods."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    lines, out, taken = source.splitlines(keepends=True), [], set()
    text = lambda a, b: "".join(lines[a - 1 : b])
    names = lambda nodes: [ast.unparse(n) for n in nodes]

    def function(node, symbol, kind):
        for a, b in split_span(lines, _first_line(node), node.end_lineno):
            out.append((path, symbol, kind, a, b, text(a, b), _signature(node, lines), names(node.decorator_list), ast.get_docstring(node), []))

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node, f"{module}.{node.name}", "function")
        elif isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            doc, bases = ast.get_docstring(node), names(node.bases)
            head = [f"class {node.name}" + (f"({', '.join(bases)})" if bases else "") + ":"]
            head += [f"    {x}" for x in (doc.splitlines() or [""] if doc is not None else [])]
            head += ["", "    # methods:", *(f"    #   - {m.name}" for m in methods)] if methods else []
            out.append((path, f"{module}.{node.name}", "class", _first_line(node), node.end_lineno, "\n".join(head) + "\n", head[0], names(node.decorator_list), doc, bases))
            for m in methods:
                function(m, f"{module}.{node.name}.{m.name}", "method")
        else:
            continue
        taken.update(range(_first_line(node), node.end_lineno + 1))
    rest = [i for i in range(1, len(lines) + 1) if i not in taken]
    body = "".join(lines[i - 1] for i in rest)
    if body.strip():
        out.insert(0, (path, module, "module", rest[0], rest[-1], body, None, [], ast.get_docstring(tree), []))
    return out


class _Edges(ast.NodeVisitor):
    """Definitions and unresolved edges of one module."""

    def __init__(self, module: str, package: str) -> None:
        self.module, self.package = module, package
        self.names: list[dict[str, str]] = [{}]
        self.types: list[dict[str, str]] = [{}]
        self.scope, self.classes = [module], []
        self.defined, self.edges, self.attributes = [], [], {}

    def bind_imports(self, body) -> None:
        """Names that a body's imports bind, nested blocks included but not nested functions."""
        queue = list(body)
        while queue:
            n = queue.pop(0)
            if isinstance(n, ast.Import):
                for a in n.names:
                    self.names[-1][a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                    self.edges.append((self.module, "imports", [a.name], True))
            elif isinstance(n, ast.ImportFrom):
                base = self.relative(n)
                if base is None:
                    continue
                for a in n.names:
                    if a.name != "*":
                        self.names[-1][a.asname or a.name] = f"{base}.{a.name}"
                        self.edges.append((self.module, "imports", [f"{base}.{a.name}"], True))
            elif not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                queue.extend(ast.iter_child_nodes(n))

    def relative(self, n: ast.ImportFrom) -> str | None:
        if not n.level:
            return n.module
        parts = self.package.split(".") if self.package else []
        up = n.level - 1
        if up >= len(parts):
            return None
        return ".".join([*parts[: len(parts) - up], *([n.module] if n.module else [])])

    def look_up(self, name: str) -> str | None:
        return next((s[name] for s in reversed(self.names) if name in s), None)

    def type_name(self, node) -> str | None:
        """Dotted name of an annotation, through quotes, Optional and unions with None."""
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            try:
                node = ast.parse(node.value, mode="eval").body
            except SyntaxError:
                return None
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
            sides = [s for s in (node.left, node.right) if not (isinstance(s, ast.Constant) and s.value is None)]
            return self.type_name(sides[0]) if len(sides) == 1 else None
        if isinstance(node, ast.Subscript):
            return self.type_name(node.slice) if ast.unparse(node.value).split(".")[-1] == "Optional" else None
        return self.dotted(node)

    def dotted(self, node) -> str | None:
        if isinstance(node, ast.Name):
            return self.look_up(node.id)
        if isinstance(node, ast.Attribute):
            base = self.dotted(node.value)
            return base and f"{base}.{node.attr}"
        return None

    def define(self, node, kind: str) -> str:
        symbol = f"{self.scope[-1]}.{node.name}"
        self.names[-1][node.name] = symbol
        self.defined.append((symbol, kind))
        self.edges.append((self.scope[-1], "defines", [symbol], True))
        return symbol

    def visit_Module(self, node) -> None:
        self.defined.append((self.module, "module"))
        self.bind_imports(node.body)
        for n in node.body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                self.names[-1][n.name] = f"{self.module}.{n.name}"
        self.generic_visit(node)

    def visit_ClassDef(self, node) -> None:
        symbol = self.define(node, "class")
        for b in node.bases:
            if target := self.dotted(b):
                self.edges.append((symbol, "inherits", [target], False))
        found = {}
        for n in ast.walk(node):
            if isinstance(n, ast.AnnAssign) and (name := self.type_name(n.annotation)):
                if isinstance(n.target, ast.Attribute) and isinstance(n.target.value, ast.Name) and n.target.value.id == "self":
                    found[n.target.attr] = name
                elif isinstance(n.target, ast.Name):
                    found[n.target.id] = name
            elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and (name := self.dotted(n.value.func)):
                found.update({t.attr: name for t in n.targets if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"})
        self.attributes[symbol] = found
        self.scope.append(symbol)
        self.classes.append(symbol)
        self.names.append({})
        self.generic_visit(node)
        self.names.pop()
        self.classes.pop()
        self.scope.pop()

    def visit_FunctionDef(self, node) -> None:
        inside = self.scope[-1] != self.module
        symbol = self.define(node, "method" if inside else "function")
        self.scope.append(symbol)
        self.names.append({})
        self.types.append({})
        self.bind_imports(node.body)
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            if a.annotation is not None and (name := self.type_name(a.annotation)):
                self.types[-1][a.arg] = name
        self.generic_visit(node)
        self.types.pop()
        self.names.pop()
        self.scope.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node) -> None:
        if isinstance(node.value, ast.Call) and (name := self.dotted(node.value.func)):
            self.types[-1].update({t.id: name for t in node.targets if isinstance(t, ast.Name)})
        self.generic_visit(node)

    def visit_AnnAssign(self, node) -> None:
        if isinstance(node.target, ast.Name) and (name := self.type_name(node.annotation)):
            self.types[-1][node.target.id] = name
        self.generic_visit(node)

    def visit_Call(self, node) -> None:
        targets, trusted, f = [], False, node.func
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "self" and self.classes:
            targets, trusted = [f"{self.classes[-1]}.{f.attr}"], True
        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Attribute) and isinstance(f.value.value, ast.Name) and f.value.value.id == "self" and self.classes:
            owner = self.attributes.get(self.classes[-1], {}).get(f.value.attr)
            targets = [f"{owner}.{f.attr}"] if owner else []
        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and (owner := next((t[f.value.id] for t in reversed(self.types) if f.value.id in t), None)):
            targets = [f"{owner}.{f.attr}"]
        elif target := self.dotted(f):
            targets = [target]
        if targets and self.scope[-1] != self.module:
            self.edges.append((self.scope[-1], "calls", targets, trusted))
        self.generic_visit(node)


def module_edges(module: str, is_package: bool, source: str) -> tuple[list, list]:
    """(defined symbols with kind, unresolved edges) of one module."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [], []
    visitor = _Edges(module, module if is_package else module.rpartition(".")[0])
    visitor.visit(tree)
    return visitor.defined, visitor.edges


def name_modules(files: DataFrame) -> DataFrame:
    """Adds `module` to files(file_path): dotted from the highest folder that belongs to its package.

    A folder belongs while it, or the folder above it, holds an __init__.py.
    """
    folder = F.regexp_replace(F.concat(F.lit("/"), "file_path"), "/[^/]*$", "")
    packages = files.where(F.col("file_path").rlike(r"(^|/)__init__\.py$")).select(folder.alias("dir")).distinct()
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    steps = files.withColumn("_dirs", parts).withColumn("_n", F.size("_dirs"))
    # Folders of a file from its own upwards, numbered, the root left out.
    above = steps.where("_n > 0").select("file_path", "_dirs", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("k"), "_n")
    path = lambda k: F.concat(F.lit("/"), F.array_join(F.slice("_dirs", F.lit(1), k), "/"))
    up = F.when(F.col("k") == 1, F.lit("")).otherwise(path(F.greatest(F.col("k") - 1, F.lit(1))))
    marked = above.select("file_path", "_n", "k", path(F.col("k")).alias("own"), up.alias("up"))
    a, b = packages.select(F.col("dir").alias("own"), F.lit(1).alias("x")), packages.select(F.col("dir").alias("up"), F.lit(1).alias("y"))
    held = marked.join(a, "own", "left").join(b, "up", "left").withColumn("ok", F.col("x").isNotNull() | F.col("y").isNotNull())
    depth = held.groupBy("file_path", "_n").agg(F.max(F.when(~F.col("ok"), F.col("k"))).alias("stop")).select("file_path", (F.col("_n") - F.coalesce("stop", F.lit(0))).alias("depth"))
    joined = steps.join(depth, "file_path", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    base = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", "")
    dirs = F.when(F.col("depth") == 0, F.array().cast("array<string>")).otherwise(F.slice("_dirs", F.col("_n") - F.col("depth") + 1, F.greatest(F.col("depth"), F.lit(1))))
    whole = F.when((base == "__init__") & (F.col("_n") > 0), F.when(F.col("depth") == 0, F.slice("_dirs", -1, 1)).otherwise(dirs)).otherwise(F.concat(dirs, F.array(base)))
    return joined.withColumn("module", F.array_join(whole, ".")).withColumn("is_package", base == "__init__").drop("_dirs", "_n", "depth")


def code_chunks(files: DataFrame) -> DataFrame:
    """CHUNKS rows of files(file_path, module, text)."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [r for p, m, t in zip(f["file_path"], f["module"], f["text"], strict=True) for r in file_chunks(p, m, t or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return files.select("file_path", "module", "text").mapInPandas(run, CHUNKS)


def code_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files(module, is_package, text).

    A call or base counts only if some file defines its target; a class that is called counts as
    itself. Calls on self and imports are taken as they are.
    """

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for m, p, t in zip(f["module"], f["is_package"], f["text"], strict=True):
                defined, edges = module_edges(m, bool(p), t or "")
                rows += [(m, s, "node:" + k, [], True) for s, k in defined] + [(m, *e) for e in edges]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EDGES.split(", ")])

    raw = files.select("module", "is_package", "text").mapInPandas(run, EDGES)
    nodes = raw.where(F.col("type").startswith("node:")).select(F.col("src").alias("symbol"), F.substring("type", 6, 20).alias("kind"), "module").distinct()
    found = raw.where(~F.col("type").startswith("node:")).select("src", "type", F.explode("candidates").alias("dst"), "trusted")
    checked = found.where(~F.col("trusted")).join(nodes.select(F.col("symbol").alias("dst")), "dst", "left_semi").select("src", "type", "dst")
    from ..operators.graph import one_edge_per_pair

    return nodes, one_edge_per_pair(found.where("trusted").select("src", "type", "dst").unionByName(checked).distinct())
