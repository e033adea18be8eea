"""Source trees as tables: recursive scans with ignore rules, explicit lists, imports and their targets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T

#: What an import looks like, by language.
IMPORTS = {
    "typescript": r"(?m)(?:import|export)[^'\"\n]*?from\s*['\"]([^'\"]+)['\"]|(?:^|[^\w.])(?:import|require)\s*\(?\s*['\"]([^'\"]+)['\"]",
    "python": r"(?m)^\s*from\s+([.\w]+)\s+import|^\s*import\s+([.\w]+)",
    "rust": r"(?m)^\s*(?:pub\s+)?(?:use|mod)\s+([\w:]+)()",
}
IMPORTS["javascript"] = IMPORTS["typescript"]
#: Extensions that a relative import may leave out, in the order they are tried.
TRIED = {"typescript": [".ts", ".tsx", ".js", ".jsx"], "javascript": [".js", ".jsx", ".mjs", ".ts", ".tsx"], "python": [".py", ".pyi"], "rust": [".rs"]}
INDEXED = {"typescript", "javascript"}
#: Editors' names of languages that differ from ours.
EDITOR_LANGUAGES = {"typescriptreact": "typescript", "javascriptreact": "javascript", "jsonc": "json"}
LISTERS_A_CORE = 4
CODE_LANGUAGES = ("rust", "typescript", "javascript", "python")


def editor_language(name: Column) -> Column:
    out = None
    for a, b in EDITOR_LANGUAGES.items():
        out = F.when(name == a, b) if out is None else out.when(name == a, b)
    return out.when(name.isin("rust", "typescript", "javascript", "python", "json", "markdown"), name).otherwise("unknown")


def ignore_pattern(rule: str) -> str | None:
    """A gitignore line as a regular expression on paths; None for blanks and comments. Negations are the caller's."""
    rule = rule.strip()
    if not rule or rule.startswith("#"):
        return None
    rule = rule.removeprefix("!")
    anchored = "/" in rule.rstrip("/")
    body = re.escape(rule.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored else "(?:^|/)") + body + ("/" if rule.endswith("/") else "(?:/|$)")


def not_ignored(path: Column, rules: list[str]) -> Column:
    """Whether no rule ignores the path; the last rule that fits decides, `!` rules bring back."""
    verdict = F.lit(True)
    for rule in rules:
        pattern = ignore_pattern(rule)
        if pattern:
            verdict = F.when(path.rlike(pattern), F.lit(rule.strip().startswith("!"))).otherwise(verdict)
    return verdict


def _listed(spark: SparkSession, reader: DataFrameReader, root: str) -> DataFrame:
    """reader's files under root. Spark lists in a task a folder, up to 10,000 tasks; here folders are dealt to a few tasks a core."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(int(was), LISTERS_A_CORE * spark.sparkContext.defaultParallelism)))
    try:
        return reader.load(root)
    finally:
        spark.conf.set(key, was)


def scan(spark: SparkSession, root: str, ignore: list[str] = (), code_only: bool = True, paths: DataFrame | None = None) -> DataFrame:
    """(path, language, content) of the files under root, hidden ones too; paths are relative to it.

    Ignored files, and with code_only those of no code language, are dropped by name before they are read. paths
    (path) restricts the scan. Bytes that are no UTF-8 become U+FFFD."""
    files = _listed(spark, spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", False), root)
    base = re.sub(r"^(?:file:)?/*", "", root.rstrip("/"))
    rel = F.regexp_replace("path", r"^[a-z]+:/*" + re.escape(base) + "/", "")
    rows = files.select(rel.alias("path"), "content").where(not_ignored(F.col("path"), [".git/", *ignore])).withColumn("language", T.language_of_path(F.col("path")))
    if code_only:
        rows = rows.where(F.col("language").isin(*CODE_LANGUAGES))
    if paths is not None:
        rows = rows.join(paths.select("path").distinct(), "path", "left_semi")
    return rows.select("path", "language", T.valid_utf8(F.col("content")).alias("content"))


def path_list(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(path) of given lines; blank ones are dropped."""
    return spark.createDataFrame([(x.strip(),) for x in lines if x.strip()], "path string")


def imports_of(files: DataFrame, relative_only: bool = True) -> DataFrame:
    """(path, language, spec): distinct modules that files (path, language, content) import."""
    found = None
    for lang, pattern in IMPORTS.items():
        both = F.concat(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)))
        found = F.when(F.col("language") == lang, both) if found is None else found.when(F.col("language") == lang, both)
    rows = files.select("path", "language", F.explode(F.array_distinct(found)).alias("spec")).where("spec <> ''")
    return rows.where(F.col("spec").startswith(".") | F.col("spec").startswith("/")) if relative_only else rows


def _normal(path: Column) -> Column:
    """A path without `.` and `..` steps."""
    empty = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        return F.when((x == ".") | (x == ""), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, spec, target): for each relative import the first candidate that is among files (path)."""
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    base = F.when(F.col("spec").startswith("/"), F.col("spec")).otherwise(F.concat(folder, F.col("spec")))
    tried = None
    for lang, ends in TRIED.items():
        options = F.array(F.lit(""), *[F.lit(x) for x in ends], *[F.lit("/index" + x) for x in ends if lang in INDEXED], *[F.lit("/__init__" + x) for x in ends if lang == "python"])
        tried = F.when(F.col("language") == lang, options) if tried is None else tried.when(F.col("language") == lang, options)
    rows = imports.withColumn("_base", _normal(base)).select("path", "spec", "_base", F.posexplode(tried).alias("_o", "_end")).withColumn("target", F.concat("_base", "_end"))
    hit = rows.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return hit.groupBy("path", "spec").agg(F.min_by("target", "_o").alias("target"))


def editor_context(active: DataFrame, selection: DataFrame | None, imported: DataFrame | None, visible: DataFrame | None) -> DataFrame:
    """CHUNK rows of an editor's state, from tables (path, content): the selection, the active file, what it imports,
    and other visible files; a path comes once, with its first role."""
    parts, roles = [], [(selection, "selection", "selection", 10, 0), (active, "active", "code", 5, 1), (imported, "import", "code", 2, 2), (visible, "visible", "code", 1, 3)]
    for df, role, kind, priority, order in roles:
        if df is not None:
            parts.append(df.select("path", "content", F.lit(role).alias("role"), F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), F.lit(order).alias("o")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    first = every.where("role <> 'selection'").groupBy("path").agg(F.min("o").alias("o"))
    kept = every.where("role = 'selection'").unionByName(every.join(first, ["path", "o"], "left_semi").select(*every.columns))
    rows = kept.groupBy("path", "role", "kind", "priority", "o").agg(F.min("content").alias("content"))
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("o", "path"))  # an editor's open files
    return rows.select(F.concat("role", F.lit(":"), "path").alias("id"), (pos - 1).cast("long").alias("pos"), "path", T.language_of_path(F.col("path")).alias("language"), "content", "kind", "priority", (F.col("role") == "import").alias("skeleton_hint"), F.lit(None).cast("int").alias("community"))
