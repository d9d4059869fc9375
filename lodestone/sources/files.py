"""Reading and writing: repository scans, file trees, text files, JSON artefacts, snapshots, pages."""

from __future__ import annotations

import fnmatch
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.classify import EXCLUDES, excluded, infrastructure, slashes

#: Extensions of code.
CODE = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}
#: Limits of a read directory and of a single document, in files and bytes.
MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES, MAX_DOCUMENT_BYTES = 200, 150 * 1024, 2 * 1024 * 1024, 200 * 1024


#: Extensions (or whole names) that a drawn file tree shows.
TREE_EXTENSIONS = (
    ".py .js .jsx .ts .tsx .json .yaml .yml .md .mdx .toml .rs .sh .bash .css .html .xml .sql .go .java .kt .swift .rb .php .c .cpp .h .hpp .vue .svelte .txt .cfg .ini .env .gitignore .dockerignore"
).split()
#: Extensions that count as text when a directory is read; a file without one counts as well.
TEXT_EXTENSIONS = (
    "txt md csv json xml yaml yml log html htm css scss less py js ts tsx jsx mjs cjs rs go java kt swift c cpp h hpp rb php sh bash zsh fish toml ini cfg conf env gitignore dockerignore sql graphql proto"
).split()


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def language(path: Column) -> Column:
    out = None
    for ext, name in CODE.items():
        out = F.when(extension(path) == ext, name) if out is None else out.when(extension(path) == ext, name)
    return out.when(infrastructure(path), "infra")


def _pruned(folder: str, patterns: list[str]) -> bool:
    """Whether a folder (relative, with a slash at its end) is not descended into."""
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    for p in patterns:
        if fnmatch.fnmatch(folder, p) or fnmatch.fnmatch(name, p.rstrip("/")):
            return True
        if p.endswith("/") and ("/" + p) in ("/" + folder):
            return True
    return False


def _entries(root: str, inside: str, patterns: list[str]) -> tuple[list[str], list[tuple]]:
    """The folders below one folder that are descended into, and its files."""
    folders, files = [], []
    with os.scandir(os.path.join(root, inside)) as found:
        for x in found:
            if x.is_dir(follow_symlinks=False):
                if not _pruned(inside + x.name + "/", patterns):
                    folders.append(inside + x.name + "/")
            elif x.is_file():
                files.append((inside + x.name, x.stat().st_size, x.stat().st_mtime))
    return sorted(folders), files


def _walk(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """``path, length, changed`` of all files below a folder of a mounted file system, hidden ones included.
    The folders of the first two levels are listed here, what lies below them by the tasks."""
    tops, files = _entries(root, "", patterns)
    deep: list[str] = []
    for top in tops:
        below, more = _entries(root, top, patterns)
        deep.extend(below)
        files.extend(more)
    shape = "path string, length bigint, changed double"

    def run(batches):
        for b in batches:
            for folder in b.column(0).to_pylist():
                todo = [folder]
                while todo:
                    below, got = _entries(root, todo.pop(), patterns)
                    todo.extend(below)
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.string(), pa.int64(), pa.float64()))], ["path", "length", "changed"])

    first = spark.createDataFrame(files, shape)
    if not deep:
        return first
    return first.unionByName(spark.createDataFrame([(x,) for x in deep], "folder string").repartition(min(len(deep), 4096)).mapInArrow(run, shape))


def _read(files: DataFrame, root: str) -> DataFrame:
    """The text of each file; bytes that are no UTF-8 are replaced, files that have gone are null."""
    names = files.columns

    def run(batches):
        for b in batches:
            out = []
            for p in b.column(names.index("path")).to_pylist():
                try:
                    with open(os.path.join(root, p), "rb") as f:
                        out.append(f.read().decode("utf-8", "replace"))
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*names, "content"])

    return files.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in files.dtypes) + ", content string")


def scan(spark: SparkSession, folder: str, exclude: list[str] | None = None, only_infrastructure: bool = False, contents: bool = True) -> DataFrame:
    """``path`` (relative), ``length, changed, language`` and, if asked for, ``content`` of the code and
    infrastructure files below a folder. Excluded folders are not descended into; code files may be excluded
    by name, infrastructure files may not. Hidden files and those that begin with an underscore count, in a
    file system that is mounted (a path or ``file:``); of any other Spark's own listing leaves them out and
    excluded folders are dropped after they are listed."""
    patterns = list(dict.fromkeys([*EXCLUDES, *(exclude or [])]))
    mounted = "://" not in folder or folder.startswith("file:")
    root = folder.removeprefix("file:").replace("//", "/", 1) if folder.startswith("file:") else folder
    if mounted:
        f = _walk(spark, root, patterns).withColumn("changed", F.timestamp_micros((F.col("changed") * 1_000_000).cast("bigint")))
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        f = raw.select(_below(folder), "length", F.col("modificationTime").alias("changed"), *([F.decode("content", "UTF-8").alias("content")] if contents else []))
        for x in [x for x in patterns if x.endswith("/")]:
            f = f.where(~excluded(F.col("path"), [x]))
    code_name = extension(F.col("path")).isin(list(CODE))
    code = code_name & ~excluded(F.col("path"), patterns)
    infra = infrastructure(F.col("path")) & ~code_name
    f = f.where(infra if only_infrastructure else infra | code).withColumn("language", language(F.col("path")))
    return _read(f, root) if mounted and contents else f


def partial(files: DataFrame, wanted: DataFrame, key: str = "path") -> DataFrame:
    """Of the files, those of a given list that are code and not excluded."""
    p = F.col(key)
    return files.join(wanted.select(key).distinct(), key, "left_semi").where(extension(p).isin(list(CODE)) & ~excluded(p))


def counts(files: DataFrame, key: str = "path") -> DataFrame:
    out = excluded(F.col(key))
    return files.agg(F.count("*").alias("total"), F.count_if(out).alias("excluded"), F.count_if(~out).alias("to_analyze"))


def tree(files: DataFrame, key: str = "path", shown: list[str] | None = None) -> DataFrame:
    """``parent, name, kind, depth, position``: every folder and file once, folders first, then by name
    without case; with ``shown`` only files that end in one of these, and their folders."""
    if shown is not None:
        name = F.lower(F.element_at(F.split(slashes(F.col(key)), "/"), -1))
        ends = F.regexp_extract(name, r"(\.[^.]*)$", 1)
        files = files.where(ends.isin(shown))
    parts = files.select(F.split(slashes(F.col(key)), "/").alias("s")).distinct()
    n = F.explode(F.sequence(F.lit(1), F.size("s")))
    rows = parts.select("s", n.alias("n")).select(
        F.array_join(F.slice("s", 1, F.col("n") - 1), "/").alias("parent"), F.element_at("s", F.col("n")).alias("name"),
        F.when(F.col("n") < F.size("s"), "dir").otherwise("file").alias("kind"), F.col("n").cast("bigint").alias("depth"),
    ).distinct()
    w = Window.partitionBy("parent").orderBy(F.col("kind") == "file", F.lower("name"), "name")
    return rows.withColumn("position", F.row_number().over(w).cast("bigint"))


def read_directory(files: DataFrame, max_files: int = MAX_FILES, max_file: int = MAX_FILE_BYTES, total: int = MAX_TOTAL_BYTES) -> DataFrame:
    """The first files by path that fit the limits (a bounded preview is what this operator is for)."""
    ext = extension(F.col("path"))
    ok = files.where((F.octet_length("content") <= max_file) & ~F.col("path").rlike(r"(?:^|/)\.[^/]+/") & ((ext == "") | ext.isin(TEXT_EXTENSIONS)))
    first = ok.orderBy("path").limit(max_files)
    run = F.sum(F.octet_length("content")).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("_r", run).where(F.col("_r") <= total).drop("_r")


def read_document(files: DataFrame, path: str, limit: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """One row, ``path, content, error``: a document, or why it cannot be read (it is not there, it lies
    outside the tree, it is over the limit)."""
    if path.startswith("/") or ".." in path.replace("\\", "/").split("/"):
        return files.sparkSession.createDataFrame([(path, None, "outside the tree")], "path string, content string, error string")
    one = files.where(F.col("path") == path).select("content", F.octet_length("content").alias("n")).limit(1)
    asked = files.sparkSession.createDataFrame([(path,)], "path string")
    error = F.when(F.col("n").isNull(), "not found").when(F.col("n") > limit, "too large")
    return asked.join(one, F.lit(True), "left").select("path", F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))  # one row each


def load_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A JSON artefact, or ``None`` if it is missing or unreadable."""
    try:
        df = spark.read.schema(schema).json(path, multiLine=True) if schema else spark.read.json(path, multiLine=True)
        return None if "_corrupt_record" in df.columns and len(df.columns) == 1 else df
    except AnalysisException:
        return None


def load_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, empty with its schema if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def save(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def page_path(source: Column) -> Column:
    """The Markdown page of a source file."""
    p = slashes(source)
    return F.when(p.rlike(r"\.(py|tsx?|jsx?)$"), F.regexp_replace(p, r"\.(py|tsx?|jsx?)$", ".md")).otherwise(F.concat(p, F.lit(".md")))


def source_of_page(pages: DataFrame, files: DataFrame) -> DataFrame:
    """``page, path``: the first source that exists in the order of extensions, else ``.py``."""
    base = F.regexp_replace("page", r"\.md$", "")
    cand = F.array(*[F.struct(F.lit(i).alias("i"), F.concat(base, F.lit("." + e)).alias("path")) for i, e in enumerate(["py", "ts", "tsx", "js", "jsx"])])
    c = pages.select("page", base.alias("base"), F.explode(cand).alias("c")).select("page", "base", "c.*")
    hit = c.join(files.select("path").distinct().withColumn("has", F.lit(True)), "path", "left")
    return hit.groupBy("page", "base").agg(F.min(F.when(F.col("has"), F.struct("i", "path"))).alias("b")).select("page", F.coalesce("b.path", F.concat("base", F.lit(".py"))).alias("path"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """One text file per page (columns ``page, markdown``) in a folder of its name, by the writer, so that
    ``folder`` may lie in any file system that the cluster shares."""
    pages.select("page", F.col("markdown").alias("value")).repartition("page").write.mode("overwrite").partitionBy("page").text(folder)


def list_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of every Markdown file below a folder, in order."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    return raw.select(_below(folder)).orderBy("path")


def find_sql(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of every SQL file below a folder, whatever is excluded elsewhere; each once."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sql").load(folder)
    return raw.select(_below(folder), F.decode("content", "UTF-8").alias("content")).dropDuplicates(["path"])


def _below(folder: str) -> Column:
    root = folder.rstrip("/") + "/"
    at = F.instr("path", root)
    return slashes(F.expr("path").substr(at + F.lit(len(root)), F.length("path"))).alias("path")


def save_state(df: DataFrame, path: str) -> None:
    """A run's totals, one row, as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
