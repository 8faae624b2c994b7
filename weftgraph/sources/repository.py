"""Repository files as a table: scan, language, hashes, configuration, and facts."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.paths import extension
from weftgraph.operators.policy import glob_regex
from weftgraph.session import ship
from weftgraph.sources import extractors
from weftgraph.sources.extractors import brace_facts

# Folders that are never scanned, and extensions by language.
EXCLUDED = (".git", "node_modules", "dist", "build", "coverage", "vendor", ".venv", "venv", "__pycache__", "target", ".dart_tool", "Pods")
LANGUAGES = {
    "javascript": [".js", ".jsx", ".mjs", ".cjs"], "typescript": [".ts", ".mts", ".cts"], "tsx": [".tsx"], "python": [".py"], "java": [".java"], "kotlin": [".kt", ".kts"],
    "go": [".go"], "rust": [".rs"], "swift": [".swift"], "dart": [".dart"], "c": [".c", ".h"], "cpp": [".cc", ".cpp", ".cxx", ".hpp", ".hh"],
}
MOST_CONFIG = 1 << 20


def ignore_patterns(text: str) -> list[str]:
    """The globs of an ignore file; negated lines and comments are left out."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            rooted, folder = line.startswith("/"), line.endswith("/")
            body = line.strip("/")
            head = "" if rooted or "/" in body else "**/"
            out += [head + body + "/**"] if folder else [head + body, head + body + "/**"]
    return out


def language_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, endings in LANGUAGES.items():
        out = F.when(F.lower(extension(path)).isin(*endings), name).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), extensions: tuple[str, ...] | None = None) -> DataFrame:
    """path (below the root), language, content, content_hash, bytes of the source files of a folder, by Spark's own reader."""
    ship(spark)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").replace("file://", "")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", ""), "^" + "".join("\\" + c if c in r"\.+*?()[]{}^$|" else c for c in base) + "/", "")
    rows = rows.withColumn("path", path)
    folders = "|".join(x.replace(".", r"\.") for x in EXCLUDED)
    rows = rows.filter(~F.col("path").rlike(rf"(^|/)({folders})/"))
    for pattern in exclude:
        rows = rows.filter(~F.col("path").rlike(glob_regex(pattern)))
    rows = rows.withColumn("language", language_of(F.col("path")))
    rows = rows.filter(F.col("language").isNotNull()) if extensions is None else rows.filter(F.lower(extension(F.col("path"))).isin(*extensions))
    return rows.select("path", "language", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("bytes"))


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON configuration files as (path, config, valid): too large or malformed ones are invalid, not errors."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.col("length"), F.col("content").cast("string").alias("text"))
    config = F.when(F.col("length") <= MOST_CONFIG, F.from_json("text", schema, {"mode": "PERMISSIVE"}))
    return rows.select("path", config.alias("config"), (F.col("length") <= MOST_CONFIG).alias("valid"))


FACTS = "path string, kind string, name string, qualified_name string, owner string, detail string, start_line int, end_line int"


def python_facts(path: str, text: str) -> Iterator[tuple]:
    """Facts of one Python file: symbols, imports, calls, bases, parameters' types; a file that doesn't parse is one parse_error."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield path, "parse_error", "", None, None, None, 1, 1
        return

    def visit(node: ast.AST, owner: tuple[str, ...], in_class: bool) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            line, end = getattr(child, "lineno", 1), getattr(child, "end_lineno", 1)
            scope = ".".join(owner)
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                yield path, kind, child.name, ".".join((*owner, child.name)), scope, None, line, end
                for base in child.bases if is_class else ():
                    yield path, "base", ast.unparse(base), None, ".".join((*owner, child.name)), None, line, line
                for arg in () if is_class else child.args.args:
                    if arg.annotation is not None:
                        yield path, "parameter", arg.arg, None, ".".join((*owner, child.name)), ast.unparse(arg.annotation), line, line
                yield from visit(child, (*owner, child.name), is_class)
                continue
            if isinstance(child, ast.Import):
                for a in child.names:
                    yield path, "import", a.name, a.asname, scope, a.name, line, end
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    yield path, "import", a.name, a.asname, scope, "." * child.level + (child.module or ""), line, end
            elif isinstance(child, ast.Call):
                yield path, "call", ast.unparse(child.func), None, scope, None, line, end
            yield from visit(child, owner, in_class if not isinstance(child, ast.Lambda) else False)

    yield from visit(tree, (), False)


#: Facts of a file from (path, text), by language.
EXTRACTORS: dict[str, Callable[[str, str], Iterator[tuple]]] = {"python": python_facts} | {name: partial(brace_facts, language=name) for name in extractors.LANGUAGES}
#: Changes when an extractor's facts do; cached facts of another version are extracted again.
EXTRACTOR_VERSION = 2


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [fact for p, language, t in zip(batch.path, batch.language, batch.content, strict=True) for fact in EXTRACTORS[language](p, t or "")]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])


def extract_facts(files: DataFrame) -> DataFrame:
    """Facts of the files whose language has an extractor, in one pass; files of other languages have none."""
    ship(files.sparkSession)
    return files.filter(F.col("language").isin(*EXTRACTORS)).select("path", "language", "content").mapInPandas(_extract, FACTS)


_FACT_COLUMNS = [c.split()[0] for c in FACTS.split(", ")]


def pack_facts(facts: DataFrame) -> DataFrame:
    """path, version, payload, digest: the facts of each file as one JSON text in a total order, and its SHA-256."""
    fields = F.struct("start_line", "end_line", "kind", "name", *[c for c in _FACT_COLUMNS if c not in ("path", "start_line", "end_line", "kind", "name")])
    packed = facts.groupBy("path").agg(F.to_json(F.sort_array(F.collect_list(fields))).alias("payload"))
    return packed.select("path", F.lit(EXTRACTOR_VERSION).alias("version"), "payload", F.sha2("payload", 256).alias("digest"))


def unpack_facts(packed: DataFrame) -> DataFrame:
    """The facts of packed files; files of another version or with a digest that doesn't fit have none, and are to be extracted again."""
    kinds = ", ".join(f"{c.split()[0]}:{c.split()[1]}" for c in FACTS.split(", ")[1:])
    good = packed.filter((F.col("version") == EXTRACTOR_VERSION) & (F.sha2("payload", 256) == F.col("digest")))
    return good.select("path", F.explode(F.from_json("payload", f"array<struct<{kinds}>>")).alias("f")).select("path", "f.*").select(*_FACT_COLUMNS)


_IMPORT = r"""(?m)(?:^|[;\s])(?:import|export)\s+(?:[\w*{}\s,$]+\s+from\s+)?["']([^"']+)["']|require\(\s*["']([^"']+)["']\s*\)|import\(\s*["']([^"']+)["']\s*\)"""


def module_specifiers(files: DataFrame) -> DataFrame:
    """(file, specifier, language) of JavaScript and TypeScript imports, by pattern, in the JVM."""
    some = [F.regexp_extract_all("content", F.lit(_IMPORT), F.lit(i)) for i in (1, 2, 3)]
    rows = files.filter(F.col("language").isin("javascript", "typescript", "tsx")).select(F.col("path").alias("file"), "language", F.explode(F.filter(F.concat(*some), lambda x: x != "")).alias("specifier"))
    return rows.select("file", "specifier", "language").distinct()


def to_parse(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose facts aren't cached under (content_hash, language) by this version of the extractors."""
    known = cache.filter(F.col("version") == EXTRACTOR_VERSION) if "version" in cache.columns else cache
    return files.join(known.select("content_hash", "language").distinct(), ["content_hash", "language"], "left_anti")
