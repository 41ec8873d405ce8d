"""Versioned state: a folder of tables whose revisions are written beside each other and switched at once.

A revision is a small JSON file that names the folder of each table. A save writes the changed
tables to new folders (the others keep theirs), then creates the file of the next revision, which
succeeds for one writer only; a reader takes the highest revision and never sees half of one. A
writer that began from an older revision, or loses the race, gets ``Conflict`` and its folders go.
Works on any file system that Spark reaches, through Hadoop's.

Keyed tables are retained as the newest rows; ``upsert`` replaces rows by key and keeps the newest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that each collection retains, and sessions.
RETAINED = {"events": 1000, "scans": 20, "claims": 100, "suppressions": 1000, "feedback": 1000, "baselines": 20, "proposals": 100, "lab_runs": 100, "verdicts": 2000}
SESSIONS = 100
#: Older revisions that stay readable.
KEPT = 2


class Conflict(Exception):
    """Another writer has saved since the state was read."""


class Store:
    """State below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def _revision_path(self, revision: int) -> str:
        return f"{self.path}/_revisions/{revision:012d}.json"

    def _write(self, path: str, text: str) -> None:
        out = self.fs.create(self._path(path), False)
        try:
            out.write(text.encode())
        finally:
            out.close()

    def _manifest(self, revision: int) -> dict[str, str]:
        text = self.spark.read.text(self._revision_path(revision), wholetext=True).first()[0]
        return json.loads(text)["tables"]

    def revisions(self) -> list[int]:
        folder = self._path(f"{self.path}/_revisions")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def load(self, revision: int | None = None) -> tuple[int, dict[str, DataFrame]]:
        """A revision (the last one, or 0 without any) and its tables."""
        known = self.revisions()
        if revision is None:
            revision = known[-1] if known else 0
        if not revision:
            return 0, {}
        return revision, {name: self.spark.read.parquet(f"{self.path}/{folder}") for name, folder in self._manifest(revision).items()}

    def save(self, revision: int, tables: dict[str, DataFrame], drop: tuple[str, ...] = ()) -> int:
        """Save ``tables`` over those of ``revision``, which must still be the last one; the new revision.

        Tables that are not named stay as they are, without being copied; those of ``drop`` go.
        """
        self._expect(revision)
        held = self._manifest(revision) if revision else {}
        written = {}
        try:
            for name, rows in tables.items():
                written[name] = f"{name}/{uuid.uuid4().hex}"
                rows.write.parquet(f"{self.path}/{written[name]}")
            self._expect(revision)
            self._commit(revision + 1, {n: f for n, f in (held | written).items() if n not in drop})
        except BaseException:
            for folder in written.values():
                self.fs.delete(self._path(f"{self.path}/{folder}"), True)
            raise
        return revision + 1

    def _expect(self, revision: int) -> None:
        known = self.revisions()
        if (known[-1] if known else 0) != revision:
            raise Conflict(f"revision {known[-1] if known else 0} is the last one, not {revision}")

    def _commit(self, revision: int, tables: dict[str, str]) -> None:
        """Move a whole file to the revision's name, which fails if the name is taken."""
        waiting = f"{self.path}/_revisions/_{uuid.uuid4().hex}"
        self._write(waiting, json.dumps({"revision": revision, "tables": tables}, sort_keys=True))
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        plain[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(self._path(waiting), self._path(self._revision_path(revision)), plain)
        except Exception as error:
            self.fs.delete(self._path(waiting), False)
            if self.fs.exists(self._path(self._revision_path(revision))):
                raise Conflict(f"revision {revision} was saved by another writer") from error
            raise

    def vacuum(self, kept: int = KEPT) -> list[str]:
        """Delete revisions before the last ``kept`` + 1 and the folders that only they name; what was deleted.

        Not while a save is under way: folders that no revision names yet would go.
        """
        known = self.revisions()
        stay = known[-(kept + 1) :]
        named = {f for r in stay for f in self._manifest(r).values()}
        gone = [f"{t}/{s.getPath().getName()}" for t in {f.split("/")[0] for r in known for f in self._manifest(r).values()} for s in self.fs.listStatus(self._path(f"{self.path}/{t}"))]
        gone = sorted(f for f in gone if f not in named)
        for r in known[: -(kept + 1)]:
            self.fs.delete(self._path(self._revision_path(r)), False)
        for folder in gone:
            self.fs.delete(self._path(f"{self.path}/{folder}"), True)
        return gone


def newest(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows in ``order``, by a top-k."""
    return rows.orderBy(*order).limit(most)


def retained(tables: dict[str, DataFrame], pos: str = "pos") -> dict[str, DataFrame]:
    """Each table with its last rows by ``pos``, as many as its collection retains; tables of other names stay whole."""
    return {name: newest(rows, RETAINED[name], F.desc(pos)) if name in RETAINED else rows for name, rows in tables.items()}


def upsert(held: DataFrame, incoming: DataFrame, key: str = "id", updated: str = "updated_at", most: int = SESSIONS) -> DataFrame:
    """``held`` with the rows of ``incoming`` in place of those of the same key; the ``most`` newest stay, ties by key.

    Of several incoming rows of a key the newest counts. Rows without a key are left out.
    """
    rest = [c for c in held.columns if c != key]
    both = held.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1))).where(F.col(key).isNotNull())
    one = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_in", updated)).alias("_r"))
    return newest(one.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest)), most, F.desc(updated), F.col(key)).select(*held.columns)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the events table: those of users' values below 50, upserted by the last one of the others."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_at"), F.col("event_type").alias("branch_id"), "event_id", (F.col("value") < 50).alias("old"))
    last = e.groupBy("id", "old").agg(F.max(F.struct("updated_at", "event_id", "branch_id")).alias("s")).select("id", "old", "s.updated_at", "s.branch_id")
    return upsert(last.where("old").drop("old"), last.where("not coalesce(old, false)").drop("old"))


QUERIES = {"session_upsert": sessions}
ORACLE_SQL = {
    "session_upsert": f"""with e as (select user_id as id, epoch_us(ts) as updated_at, event_type as branch_id, event_id, coalesce(value < 50, false) as old from events),
l as (select * from e qualify row_number() over (partition by id, old order by updated_at desc, event_id desc) = 1),
o as (select * from l qualify row_number() over (partition by id order by old) = 1) select id, updated_at, branch_id from o order by updated_at desc, id limit {SESSIONS}""",
}
