"""Extract documents in stages and activate them, safe to stop and repeat at any point.

A job's extracted rows are staged in a folder of their own; what is decided from them becomes part of the table only when a
marker of the next version is created, which fails if somebody else has created it. Readers see the folders that markers name,
so half-written ones never show. A job that runs again uses its staged rows if they are whole, decides on the newest version and
leaves rows only for documents that have none yet; a job that loses the race for a version decides again.

Defined cases: of documents with equal content the one that was activated first stays active, within one job the smallest id;
the others are kept as duplicates of it; rows without an id are passed over; of several rows with one id that of the least
(sha256, size) counts; null content counts as empty; an empty job commits nothing.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "document_id long, sha256 string, size long, state string, duplicate_of long, version long"


class ActiveTable:
    """Rows (see ROW) in the folders that the markers of a root folder name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.files.exists(self._path(f"{self.root}/{name}"))

    def remove(self, name: str) -> None:
        self.files.delete(self._path(f"{self.root}/{name}"), True)

    def _names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.files.listStatus(self._path(f"{self.root}/{folder}"))) if self.exists(folder) else []

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return max((int(n.split("-")[0]) for n in self._names("markers")), default=0)

    def read(self, upto: int | None = None) -> DataFrame:
        """The rows of all versions, or of those up to one."""
        known = [n.split("-") for n in self._names("markers")]
        folders = [f"{self.root}/data/{folder}" for version, folder in known if upto is None or int(version) <= upto]
        return self.spark.read.schema(ROW).parquet(*folders) if folders else self.spark.createDataFrame([], ROW)

    def commit(self, folder: str, version: int) -> bool:
        """Make a written folder the next version; False if another folder is that version already.

        The version is claimed by a file that only one can create; its content names the folder, then a marker shows it.
        """
        claim = self._path(f"{self.root}/claims/{version:09d}")
        try:
            out = self.files.create(claim, False)
        except Exception as error:  # the claim is there: ours from a run that was stopped, or another's
            if not self.files.exists(claim):
                raise error
            return False
        out.write(bytearray(folder.encode()))
        out.close()
        self.files.create(self._path(f"{self.root}/markers/{version:09d}-{folder}"), True).close()
        return True

    def repair(self) -> None:
        """Finish what was stopped between claim and marker: a claim that names a folder gets its marker, an empty one is withdrawn.

        For the one writer that finds the table at rest, as after a restart.
        """
        shown = {n.split("-")[0] for n in self._names("markers")}
        for name in self._names("claims"):
            if name not in shown and not name.startswith("."):
                folder = self.spark.read.text(f"{self.root}/claims/{name}").first()
                if folder:
                    self.files.create(self._path(f"{self.root}/markers/{name}-{folder[0]}"), True).close()
                else:
                    self.remove(f"claims/{name}")

    def clean(self) -> None:
        """Remove data that no marker names; for a table at rest."""
        named = {n.split("-")[1] for n in self._names("markers")}
        for name in self._names("data"):
            if name not in named:
                self.remove(f"data/{name}")


def extracted(documents: DataFrame) -> DataFrame:
    """document_id, sha256, size from rows (document_id, content)."""
    content = F.coalesce(F.col("content"), F.lit(""))
    rows = documents.where("document_id IS NOT NULL").select("document_id", F.sha2(content, 256).alias("sha256"), F.length(content).cast("long").alias("size"))
    return rows.groupBy("document_id").agg(F.min(F.struct("sha256", "size")).alias("least")).select("document_id", "least.*")


def decided(staged: DataFrame, held: DataFrame, version: int) -> DataFrame:
    """ROW rows for the staged documents that have none in held."""
    fresh = staged.join(held.select("document_id"), "document_id", "left_anti")
    own = fresh.groupBy("sha256").agg(F.min("document_id").alias("own"))
    before = held.where("state = 'active'").select("sha256", F.col("document_id").alias("before"))
    owners = own.join(before, "sha256", "left").select("sha256", F.coalesce("before", "own").alias("owner"))
    copy = F.col("owner") != F.col("document_id")
    state = F.when(copy, "duplicate").otherwise("active")
    return fresh.join(owners, "sha256").select("document_id", "sha256", "size", state.alias("state"), F.when(copy, F.col("owner")).alias("duplicate_of"), F.lit(version).cast("long").alias("version"))


def activate(table: ActiveTable, job: str, documents: DataFrame, after: Callable[[str], None] = lambda step: None) -> int:
    """Take the documents of a job into the table; the version that holds them, 0 if there was nothing to take.

    after: called when a step is done (staged, decided, committed), as a place for logs or, in tests, to stop.
    """
    spark, staging = table.spark, f"staged/{job}"
    if not table.exists(f"{staging}/_SUCCESS"):
        extracted(documents).write.mode("overwrite").parquet(f"{table.root}/{staging}")
    after("staged")
    staged = spark.read.schema("document_id long, sha256 string, size long").parquet(f"{table.root}/{staging}")
    while True:
        now = table.version()
        folder = uuid.uuid4().hex
        decided(staged, table.read(now), now + 1).write.parquet(f"{table.root}/data/{folder}")
        after("decided")
        if not spark.read.schema(ROW).parquet(f"{table.root}/data/{folder}").take(1):
            table.remove(f"data/{folder}")
            table.remove(staging)
            return 0
        if table.commit(folder, now + 1):
            break
        table.remove(f"data/{folder}")
        if table.version() == now:
            raise RuntimeError(f"version {now + 1} is claimed, but nobody has finished it: repair() the table")
    after("committed")
    table.remove(staging)
    return now + 1
