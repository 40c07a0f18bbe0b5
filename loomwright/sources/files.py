"""File scans through Spark's binaryFile source, with read gates and overlapping line windows."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.constants import SKIP_FOLDERS, WINDOW_CHARS, WINDOW_LINES, WINDOW_OVERLAP
from .labelled import ordinals

WINDOW_SCHEMA = "file_path string, symbol string, kind string, start_line int, end_line int, content string, enriched_text string, signature string, n_lines int"


def _empty_files(spark, root: str, glob: str) -> list[str]:
    """Paths of files without content: Spark's sources give them no row, yet an empty __init__.py makes a package."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    entries, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while entries.hasNext():
        status = entries.next()
        if not status.getLen() and fnmatch(status.getPath().getName(), glob):
            out.append(status.getPath().toString())
    return out


def scan(spark, root: str, *, glob: str = "*") -> DataFrame:
    """file_path (below root), size, content of all files outside skipped folders."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    base = root.rstrip("/")
    loaded = reader.load(base)
    bare = F.regexp_replace("path", r"^[A-Za-z]+:/*", "/").alias("path")
    raw = loaded.select(bare, F.col("length").alias("size"), "content")
    listed = spark.createDataFrame([(p,) for p in _empty_files(spark, base, glob)], "path string").select(bare)
    empty = listed.select("path", F.lit(0).cast("long").alias("size"), F.lit(b"").alias("content"))
    raw = raw.unionByName(empty)
    prefix = "/" + base.split(":", 1)[-1].strip("/") + "/"
    rel = F.expr(f"substring(path, instr(path, '{prefix}') + {len(prefix)})") if "'" not in prefix else F.col("path")
    folders = F.slice(F.split(rel, "/"), 1, F.size(F.split(rel, "/")) - 1)
    return raw.select(rel.alias("file_path"), "size", "content").where(~F.exists(folders, lambda d: d.isin(*SKIP_FOLDERS)))


def discover(files: DataFrame) -> DataFrame:
    """Adds language and the canonical ordinal by path; files of no known language go."""
    known = files.withColumn("language", F.when(F.col("file_path").endswith(".py"), F.lit("python")).otherwise(text.language_of(F.col("file_path")))).where("language IS NOT NULL")
    return known.join(ordinals(known.select("file_path"), "file_path"), "file_path")


def readable(files: DataFrame, *, max_bytes: int = 1_000_000, max_line: int = WINDOW_CHARS) -> DataFrame:
    """Adds `text` to files that are text of bounded lines: not too large, no NUL byte, no endless line."""
    body = F.decode(F.col("content"), "UTF-8")
    ok = files.where((F.col("size") <= max_bytes) & (F.position(F.lit(b"\x00"), F.col("content")) == 0)).withColumn("text", body)
    return ok.where(~F.exists(F.split("text", "\n"), lambda x: F.length(x) > max_line))


def line_windows(lines: list[str], *, max_lines: int, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open index ranges of bounded windows; each starts `overlap` lines before the last one's end."""
    out, start = [], 0
    while start < len(lines):
        end, chars = start + 1, len(lines[start])
        while end < len(lines) and end - start < max_lines and chars + len(lines[end]) <= max_chars:
            chars += len(lines[end])
            end += 1
        out.append((start, end))
        if end == len(lines):
            break
        start = max(start + 1, end - overlap)
    return out


def text_windows(files: DataFrame, *, max_lines: int = WINDOW_LINES, max_chars: int = WINDOW_CHARS, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Chunks (WINDOW_SCHEMA) of files(file_path, language, text)."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for path, language, body in zip(f["file_path"], f["language"], f["text"], strict=True):
                lines = (body or "").splitlines(keepends=True)
                for a, b in line_windows(lines, max_lines=max_lines, max_chars=max_chars, overlap=overlap):
                    content = "".join(lines[a:b])
                    if content.strip():
                        rows.append((path, f"{language}:{path}:{a + 1}", "module", a + 1, b, content, f"# language: {language}\n# file: {path}\n{content}", f"{language} file {path}", len(lines)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WINDOW_SCHEMA.split(", ")])

    return files.select("file_path", "language", "text").mapInPandas(run, WINDOW_SCHEMA)


def lines_of_code(files: DataFrame) -> DataFrame:
    """One row: files, loc (line breaks plus one for Python, lines otherwise)."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    loc = F.when(F.col("language") == "python", breaks + 1).otherwise(F.size(text.lines_of(F.col("text"))))
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(loc), F.lit(0)).alias("loc"))


def parse_repo_urls(df: DataFrame, column: str = "url") -> DataFrame:
    """Adds owner and name; rows that aren't repository addresses go."""
    out = df.withColumn("owner", text.repo_owner(F.col(column))).withColumn("name", text.repo_name(F.col(column)))
    return out.where("owner IS NOT NULL AND name IS NOT NULL")
