"""Sources and sinks: file trees, one text, JSON lines; and the scan report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import check as ck
from ..operators import policy as P

# Folders that a scan leaves out, and how far it looks for a zero byte.
SKIPPED = ("node_modules", ".git", "dist", ".turbo", ".next", "coverage", ".spanwarden")
BINARY_PROBE = 8000


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, text of the text files below a folder; skipped folders and dot-folders are left out, dot-files are not, and neither is any file with a zero byte near its start.

    Files are listed and read by Spark, so the folder may be in any store that it reads.
    """
    hidden = "(?:" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + r"|\.[^/]+)"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root).select("path", "content")
    found = found.unionByName(spark.createDataFrame(_dot_files(spark, root), "path string, content binary"))
    inside = F.substring(F.col("path"), F.length(F.lit(_qualified(spark, root))) + 1, F.lit(100_000))
    kept = found.where(~inside.rlike(f"(?:^|/){hidden}/"))
    text = kept.where(~F.hex(F.substring("content", 1, BINARY_PROBE)).rlike("^(?:..)*?00"))
    return text.select("path", F.decode("content", "UTF-8").alias("text")).dropDuplicates(["path"])


def _qualified(spark: SparkSession, root: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _dot_files(spark: SparkSession, root: str) -> list[tuple[str, bytes]]:
    """Files that Spark's listing hides, by their names; the driver reads them, as they are few and small in any tree."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files, out = store.listFiles(path, True), []
    while files.hasNext():
        p = files.next().getPath()
        if p.getName()[:1] in "._":
            stream = store.open(p)
            out.append((p.toString(), bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
            stream.close()
    return out


def one_text(spark: SparkSession, text: str, path: str = "<stdin>") -> DataFrame:
    return spark.createDataFrame([(path, text)], "path string, text string")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a given schema; malformed lines fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan(files: DataFrame, policy: dict | None = None, recognizers=None) -> DataFrame:
    """path, entity, rule of every blocked value, at the boundary tool:scan:out as the agent scan."""
    ctx = ck.Context(boundary={"kind": "tool", "name": "scan", "direction": "out"}, agent="scan", policy=policy or P.default_policy(), recognizers=recognizers, apply_block_as="mask", master=b"scan reports hold no token values")
    checked = ck.check(files, "text", ctx)
    return ck.decisions(checked, ["path"]).where("action = 'block'").select("path", "entity", "rule")


def report(hits: DataFrame) -> DataFrame:
    """One line a hit."""
    return hits.select(F.concat("path", F.lit(": blocked "), "entity", F.lit(" (rule: "), "rule", F.lit(")")).alias("value"))


def exit_code(hits: DataFrame) -> int:
    return 0 if hits.isEmpty() else 1
