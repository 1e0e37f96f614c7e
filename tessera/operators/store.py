"""Versioned folders: a table is a list of parts, and a manifest says which.

A write puts new parts beside the old ones and then, as its last step, renames
a finished manifest into place. Readers take the manifest of the highest
generation, so they see all of a write or nothing of it, and a write that fails
half way leaves the former generation as it was. A writer names the generation
it began from; when another one was committed meanwhile it is refused. Parts
are never changed, so what a lazy plan still reads stays until ``vacuum``.

A part may be bucketed by a key. It is then read with its buckets, so that a
join on the key moves only the other side, and an ``IN`` of literals reads only
the buckets of these keys.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Part:
    """One written folder; ``key`` and ``buckets`` say how it is dealt, 0 for not at all."""

    folder: str
    key: str = ""
    buckets: int = 0


@dataclass(frozen=True)
class Manifest:
    """What a generation consists of: parts and schema of each table, and settings."""

    generation: int = 0
    tables: dict[str, tuple[Part, ...]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)

    def text(self) -> str:
        tables = {n: [vars(p) for p in parts] for n, parts in self.tables.items()}
        return json.dumps({"generation": self.generation, "tables": tables, "schemas": self.schemas, "settings": self.settings}, indent=1)

    @classmethod
    def of(cls, text: str) -> Manifest:
        x = json.loads(text)
        return cls(x["generation"], {n: tuple(Part(**p) for p in parts) for n, parts in x["tables"].items()}, x["schemas"], x["settings"])


@dataclass(frozen=True)
class Store:
    """A folder of generations, in any file system that Spark reaches."""

    spark: SparkSession
    path: str

    def _at(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()), path

    def generations(self) -> list[int]:
        files, folder = self._at("manifests")
        if not files.exists(folder):
            return []
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] not in "._")

    def manifest(self, generation: int | None = None) -> Manifest | None:
        """That of a generation, the last one by default; None where nothing was committed."""
        found = self.generations()
        if not found:
            return None
        _, path = self._at(f"manifests/{found[-1] if generation is None else generation:012d}.json")
        return Manifest.of(self.spark.read.text(path.toString(), wholetext=True).first()[0])

    def write(self, rows: DataFrame, name: str, key: str = "", buckets: int = 0, sort: str = "") -> Part:
        """A new part of a table, not yet of any generation."""
        folder = f"{name}/{uuid.uuid4().hex}"
        if not buckets:
            rows.write.parquet(f"{self.path}/{folder}")
            return Part(folder)
        writer = rows.repartition(buckets, key).write.format("parquet")  # one file a bucket
        table = f"part_{uuid.uuid4().hex}"
        writer.bucketBy(buckets, key).sortBy(sort or key).option("path", f"{self.path}/{folder}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # its files stay
        return Part(folder, key, buckets)

    def commit(self, base: Manifest | None, new: Manifest) -> Manifest:
        """``new`` as the generation after ``base``, which must still be the last."""
        began = base.generation if base else 0
        last = (self.generations() or [0])[-1]
        if last != began:
            raise Conflict(f"generation {last} was committed since {began} was read")
        done = replace(new, generation=began + 1)
        files, folder = self._at("manifests")
        files.mkdirs(folder)
        _, draft = self._at(f"manifests/.{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(bytearray(done.text().encode()))
        stream.close()
        _, final = self._at(f"manifests/{done.generation:012d}.json")
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise Conflict(f"generation {done.generation} was committed by another writer")
        return done

    def parts(self, manifest: Manifest, name: str) -> list[DataFrame]:
        """Each part of a table as a frame, with its buckets; none for an empty table."""
        out = []
        for part in manifest.tables.get(name, ()):
            path = f"{self.path}/{part.folder}"
            if not part.buckets:
                out.append(self.spark.read.schema(self._schema(manifest, name)).parquet(path))
                continue
            view, columns = f"part_{uuid.uuid4().hex}", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._schema(manifest, name))
            where = path.replace("'", "\\'")
            dealt = f"CLUSTERED BY ({part.key}) SORTED BY ({part.key}) INTO {part.buckets} BUCKETS"
            self.spark.sql(f"CREATE TABLE {view} ({columns}) USING parquet OPTIONS (path '{where}') {dealt}")
            out.append(self.spark.table(view))
        return out

    def table(self, manifest: Manifest, name: str) -> DataFrame:
        """All rows of a table; without buckets."""
        paths = [f"{self.path}/{p.folder}" for p in manifest.tables.get(name, ())]
        schema = self._schema(manifest, name)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _schema(manifest: Manifest, name: str) -> StructType:
        return StructType.fromJson(json.loads(manifest.schemas[name]))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes parts and manifests of all but the last ``keep`` generations; how many parts went.

        Only when no writer is at work and no plan still reads an older one.
        """
        found = self.generations()
        kept = {p.folder for g in found[-keep:] for parts in self.manifest(g).tables.values() for p in parts}
        gone, names = 0, {n for g in found for n in self.manifest(g).tables}
        for name in names:
            files, folder = self._at(name)
            for f in files.listStatus(folder) if files.exists(folder) else []:
                if f"{name}/{f.getPath().getName()}" not in kept:
                    files.delete(f.getPath(), True)
                    gone += 1
        for g in found[:-keep]:
            files, path = self._at(f"manifests/{g:012d}.json")
            files.delete(path, False)
        return gone


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    It is in the session's ``spark.checkpoint.dir``. Only where none is set
    and the master is local is it a temporary one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="index-")
    return f"{where}/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written once to a scratch folder and read back, for plans that use them several times."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
