"""Small tables that change: tags and sessions, as numbered versions of which a reader sees a whole one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probewell import schemas
from probewell.sources import save_session, session_complete, upsert_tags


class VersionedTable:
    """A table in a folder, each version in a folder of its own.

    A version counts once Spark's commit has put its mark (_SUCCESS) there, which it does last of all: until then readers see the version before, so
    never half of one. A writer that finds the next number taken fails, so that no change is lost unseen. The last `keep` versions
    stay for readers that have begun.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 2):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def versions(self) -> list[int]:
        """Numbers of the whole versions, in order."""
        fs, place = self._fs(self.path)
        if not fs.exists(place):
            return []
        found = [(f.getPath().getName(), f.getPath().toString()) for f in fs.listStatus(place)]
        numbers = [(int(name[2:]), at) for name, at in found if name.startswith("v=") and name[2:].isdigit()]
        whole = lambda at: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS"))
        return sorted(n for n, at in numbers if whole(at))

    def read(self, version: int | None = None) -> DataFrame:
        """The newest whole version, or the one given; an empty table if there is none."""
        found = self.versions()
        if version is None and not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={found[-1] if version is None else version}")

    def write(self, table: DataFrame, after: int | None = None) -> int:
        """Writes the next version and gives its number. after: the version that `table` was made from, 0 for none; if another
        writer has come in between, it is an error and nothing changes."""
        found = self.versions()
        last = found[-1] if found else 0
        if after is not None and after != last:
            raise RuntimeError(f"version {last} has come after version {after}")
        try:
            table.write.mode("errorifexists").parquet(f"{self.path}/v={last + 1}")
        except AnalysisException as e:
            raise RuntimeError(f"version {last + 1} is being written, or was left half by a lost writer: clear() it first") from e
        for n in [*found, last + 1][: -self.keep]:
            fs, place = self._fs(f"{self.path}/v={n}")
            fs.delete(place, True)
        return last + 1

    def clear(self) -> None:
        """Removes what lost writers have left: folders newer than the newest whole version."""
        found = self.versions()
        fs, place = self._fs(self.path)
        for f in fs.listStatus(place) if fs.exists(place) else ():
            name = f.getPath().getName()
            if name.startswith("v=") and name[2:].isdigit() and int(name[2:]) > (found[-1] if found else 0):
                fs.delete(f.getPath(), True)

    def discard(self) -> None:
        """Removes the table with all its versions."""
        fs, place = self._fs(self.path)
        fs.delete(place, True)


class TagStore(VersionedTable):
    """Tags by identity (identity, tags)."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        super().__init__(spark, path, schemas.TAGS, keep)

    def upsert(self, changed: DataFrame) -> int:
        """Puts the lists of changed (identity, tags) in place of the old ones, each tag once."""
        found = self.versions()
        last = found[-1] if found else 0
        return self.write(upsert_tags(self.read(), changed), after=last)


class SessionStore(VersionedTable):
    """The state of a curation session: one row."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        super().__init__(spark, path, schemas.SESSION, keep)

    def start(self, validators: list[str], valid_threshold: int = 0, random_threshold: int = 100) -> int:
        """Begins a session; one that is there already is an error."""
        return self.write(self.spark.createDataFrame([(validators, valid_threshold, random_threshold, 0, [])], self.schema), after=0)

    def save(self, seen: DataFrame) -> int:
        """Adds the entries of seen (position) to those visited."""
        return self.write(save_session(self.read(), seen).select(*self.read().columns), after=self.versions()[-1])

    def complete(self, entries: int) -> bool:
        """Whether all of so many entries were visited."""
        row = session_complete(self.read(), entries).first()
        return bool(row and row["complete"])


def tags_in(store: TagStore, identities: DataFrame) -> DataFrame:
    """identities with their tags of the store; one without any has an empty list."""
    return identities.join(store.read(), "identity", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
