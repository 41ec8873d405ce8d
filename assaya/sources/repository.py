"""A repository as a source: which files are scanned, what they hold, and what changed between two snapshots.

Spark's own listing passes over names that start with a dot or an underscore, ``__init__.py`` among
them, so folders are listed here, level by level, without entering excluded ones or links, and no
further than the limit of files. Names, links and sizes are judged on the listing; contents are read
in tasks after that. Paths are relative to the root, with slashes.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are left out, extensions and manifests that are scanned, and limits.
EXCLUDED_FOLDERS = (".git", ".hg", ".svn", ".venv", ".next", "venv", "node_modules", "dist", "build", "coverage", "vendor")
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", ".py", ".md")
MANIFESTS = ("package.json", "pyproject.toml")
MAX_BYTES, MAX_FILES = 1024 * 1024, 10_000
_WORKTREES = re.compile(r"(?:^|/)\.[^/]+/worktrees\Z")


def _opened(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A path without a scheme is local; nothing in it is an escape."""
    plain = re.sub(r"^file:(?://)?(?=/)", "", root)
    fs, base = (pyarrow.fs.LocalFileSystem(), os.path.abspath(plain)) if plain.startswith("/") or "://" not in plain else pyarrow.fs.FileSystem.from_uri(plain)
    return fs, base.rstrip("/")


def discovered(root: str, most: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> tuple[list[tuple[str, int]], bool]:
    """(path, size) of the first ``most`` files to scan, in the order of a search level by level and by name, and whether there are more."""
    fs, base = _opened(root)
    local = isinstance(fs, pyarrow.fs.LocalFileSystem)
    found: list[tuple[str, int]] = []
    waiting = [""]
    for folder in waiting:  # grows while it is read
        try:
            entries = sorted(fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/{folder}")), key=lambda e: e.base_name)
        except OSError:
            continue
        for e in entries:
            name, path = e.base_name, f"{folder}/{e.base_name}".lstrip("/")
            if local and os.path.islink(e.path):
                continue
            if e.type == pyarrow.fs.FileType.Directory:
                if name not in EXCLUDED_FOLDERS and not _WORKTREES.search(path):
                    waiting.append(path)
            elif e.type == pyarrow.fs.FileType.File and (os.path.splitext(name)[1].lower() in EXTENSIONS or name in MANIFESTS) and e.size <= max_bytes:
                if len(found) == most:
                    return found, True
                found.append((path, e.size))
    return found, False


def listing(spark: SparkSession, root: str, most: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """pos, path, size of the files to scan."""
    return spark.createDataFrame([(k, *f) for k, f in enumerate(discovered(root, most, max_bytes)[0])], "pos long, path string, size long")


def snapshot(files: DataFrame, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, hash, text of ``files`` (path) below the root, read in tasks; a file that has gone or grown too large since has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(root)
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with fs.open_input_file(f"{base}/{path}") as source:
                        data = source.read() if source.size() <= max_bytes else None
                except OSError:
                    data = None
                if data is not None:
                    yield pa.RecordBatch.from_pydict({"path": [path], "hash": [hashlib.sha256(data).hexdigest()], "text": [data.decode("utf-8", "replace")]})

    return files.select("path").repartition("path").mapInArrow(run, "path string, hash string, text string")


def refused(asked: DataFrame, files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, reason for each of ``asked`` (path) that may not be read, null for the others; ``files``: path, size of all there is.

    A leading @ is dropped and dots are resolved; what leaves the root, or is absolute, is outside it.
    """
    p = F.regexp_replace("path", "^@", "")
    walked = F.aggregate(
        F.split(p, "/", -1),
        F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out")),
        lambda s, x: F.when(x.isin("", "."), s)
        .when(x == "..", F.struct(F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["out"] | (F.size(s["at"]) == 0)).alias("out")))
        .otherwise(F.struct(F.array_append(s["at"], x).alias("at"), s["out"].alias("out"))),
    )
    rows = asked.where("path is not null").select(F.col("path").alias("asked"), F.array_join(walked["at"], "/").alias("path"), (walked["out"] | F.startswith(p, F.lit("/"))).alias("outside"))
    reason = F.when(F.col("outside"), "outside-root").when(F.col("size").isNull(), "not-a-file").when(F.col("size") > max_bytes, "too-large")
    return rows.join(files.select("path", "size"), "path", "left").select(F.col("asked").alias("path"), reason.alias("reason"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, status (added, changed, removed) of files that differ between two snapshots (path, hash)."""
    a, b = before.select("path", F.col("hash").alias("old")), after.select("path", F.col("hash").alias("new"))
    rows = a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return rows.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("status"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between documents as files and the same with some edited, left out or new."""
    d = F.col("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(d, F.concat(F.lit("src/"), F.col("lang"), F.lit("/d"), d.cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    after = docs.select(d, F.when(d % 9 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), F.when(d % 7 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"))
    hashed = lambda df: df.select("path", F.sha2("text", 256).alias("hash"))
    return changed(hashed(docs), hashed(after))


QUERIES = {"changed_files": _snapshots}
ORACLE_SQL = {
    "changed_files": """with a as (select doc_id, concat('src/', lang, '/d', doc_id, '.md') as path, coalesce(text, '') as text from documents), b as (select case when doc_id % 9 = 0 then concat(path, '.new') else path end as path, case when doc_id % 7 = 0 then upper(text) else text end as text from a),
j as (select coalesce(a.path, b.path) as path, a.path is null as fresh, b.path is null as gone, sha256(a.text) as old, sha256(b.text) as new from a full outer join b on a.path = b.path)
select path, case when fresh then 'added' when gone then 'removed' else 'changed' end as status from j where fresh or gone or old <> new""",
}
