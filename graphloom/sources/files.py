"""Source trees, graph caches and API documents as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schemas import API_JSON, GRAPH_JSON

# Names (of folders or files) that a scan leaves out, and folders that the project scan does.
IGNORED = ("bin", "obj", ".git", ".vs", ".sandbox", "properties", "temp")
EXCLUDED = (".sbx", "bin", "obj", ".git")


def _relative(root: str) -> Column:
    """Column ``path`` of a file listing, from ``root`` on."""
    base = root.rstrip("/").rsplit(":", 1)[-1]
    path = F.regexp_replace("path", r"^[^:]*:/*(?=/)", "")
    return F.substr(path, F.locate(base, path) + F.lit(len(base) + 1))


def source_files(spark: SparkSession, root: str, rules: list[str] | None = ()) -> DataFrame:
    """``path`` (relative to ``root``) and ``text`` of the C# and Razor files under ``root`` that no rule leaves out; ``None`` keeps all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{cs,razor}").load(root)
    df = files.select(_relative(root).alias("path"), F.decode("content", "UTF-8").alias("text"))
    return df if rules is None else df.where(~ignored(F.col("path"), rules))


def parse_rules(text: str) -> list[str]:
    lines = (line.strip() for line in text.splitlines())
    return [x for x in lines if x and not x.startswith("#")]


def ignored(path: Column, rules: list[str] = (), names: tuple[str, ...] = IGNORED) -> Column:
    """Whether a relative path has an ignored name or a rule matches, in any case.

    ``x/`` means a segment, a rule with ``*`` the file's name or the whole path, any other the path or a segment.
    """
    low = F.lower(path)
    parts = F.split(low, "/")
    hit = F.exists(parts, lambda s: s.isin(*names))
    for rule in (r.lower().replace("\\", "/") for r in rules):
        if rule.endswith("/"):
            hit = hit | F.array_contains(parts, rule[:-1])
        elif "*" in rule:
            pattern = "^" + "".join(".*" if c == "*" else f"\\{c}" if not c.isalnum() else c for c in rule) + "$"
            hit = hit | F.element_at(parts, -1).rlike(pattern) | low.rlike(pattern)
        else:
            hit = hit | (low == rule) | F.array_contains(parts, rule)
    return hit


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of the C# and Razor files under ``root`` outside build and version folders: the second scanner's rule."""
    files = source_files(spark, root, None)
    return files.where(~F.concat(F.lit("/"), F.lower("path")).rlike("/(" + "|".join(re.escape(x) for x in EXCLUDED) + ")/"))


def scan_order(files: DataFrame) -> DataFrame:
    """``files`` with ``seq``: folder by folder, C# before Razor, files before sub-folders."""
    from graphloom.operators.model import dense_index

    folder = F.regexp_extract("path", r"^(.*?)[^/]*$", 1)
    keyed = files.withColumn("seq", F.concat_ws("\u0001", folder, F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)), "path"))
    return dense_index(keyed, "_n").withColumn("seq", F.col("_n")).drop("_n")


def graph_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph document; a missing file is an error, positions are the order."""
    doc = spark.read.schema(GRAPH_JSON).json(path, multiLine=True)
    nodes = doc.select(F.posexplode("nodes").alias("seq", "n")).select(F.col("seq").cast("bigint").alias("seq"), "n.id", F.col("n.id").alias("name"), F.col("n.file").alias("file_path"), "n.namespace")
    links = doc.select(F.posexplode("links").alias("seq", "l"))
    return nodes, links.select(F.col("seq").cast("bigint").alias("seq"), F.col("l.source").alias("src"), F.col("l.target").alias("dst"), F.col("l.type").alias("kind"), "l.details", F.lit(0).alias("line_number"))


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def api_document(spark: SparkSession, path: str | None = None, default: str = "./api.json") -> DataFrame:
    """The API document at ``path``, else at ``default`` if that exists, else an empty one of the same columns."""
    if path is None and path_exists(spark, default):
        path = default
    return spark.createDataFrame([], API_JSON) if path is None else spark.read.schema(API_JSON).json(path, multiLine=True)


# Where an index may be under a folder, in the order to look, and the files that tell.
INDEX_DIRS = ("engine_api/vec", "engine_api", "user_code/vec", "user_code", "vec", "")
INDEX_HOMES = ("vec", "", "user_code/vec", "engine_api/vec")
INDEX_FILES = ("semantic_index", "semantic_index.tvim", "graph.json")


def index_dir(spark: SparkSession, base: str) -> str:
    """The first candidate folder under ``base`` that holds an index, in any store Spark reads; else ``base``."""
    for sub in INDEX_DIRS:
        folder = f"{base.rstrip('/')}/{sub}".rstrip("/")
        if any(path_exists(spark, f"{folder}/{name}") for name in INDEX_FILES):
            return folder
    return base


def source_of(sources: DataFrame, class_name: str) -> DataFrame:
    """The first source file, by path, whose name without its ending is ``class_name``."""
    stem = F.regexp_extract("path", r"([^/\\]+?)\.[^/\\]*$", 1)
    return sources.where(F.upper(stem) == class_name.upper()).orderBy("path").limit(1)


def file_listing(spark: SparkSession, root: str, rules: list[str] = ()) -> DataFrame:
    """``path, bytes, lines, is_binary`` of all files under ``root`` that no rule leaves out; binaries have no lines."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    binary = F.contains(F.col("content"), F.lit(b"\x00"))
    lines = F.when(~binary, F.size(F.split(F.decode("content", "ISO-8859-1"), "\n", -1)))
    listed = files.select(_relative(root).alias("path"), F.col("length").alias("bytes"), lines.cast("bigint").alias("lines"), binary.alias("is_binary"))
    return listed.where(~ignored(F.col("path"), rules))
