"""Tables of a folder as versions: a version names the Parquet parts that are alive, and one rename makes it current.

Parts are written before the version that names them, under names never used before, so that a writer that dies leaves
the old version whole. A reader takes a lease on its version; parts that no leased version and none of the last `KEPT`
versions names are removed. A folder has one writer at a time; a version that exists already is refused.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import library as L

KEPT = 3
LEASE_HOURS = 24.0


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.paths(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        at = self.paths(f"{self.folder}/{kind}")
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def _put(self, path: str, text: str) -> None:
        out = self.files.create(self.paths(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def versions(self) -> list[int]:
        return [int(n) for n in self._names("versions") if n.isdigit()]

    def current(self) -> int:
        """The number of the current version; 0 before the first."""
        return max(self.versions(), default=0)

    def parts(self, version: int | None = None) -> list[dict]:
        """The parts of a version, each with its table, its path and what else the writer noted."""
        version = self.current() if version is None else version
        if not version:
            return []
        stream = self.files.open(self.paths(f"{self.folder}/versions/{version:09d}"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def new_path(self, table: str) -> str:
        return f"data/{uuid.uuid4().hex}/{table}"

    def commit(self, parts: list[dict], after: int) -> int:
        """Makes the parts the version that follows `after`."""
        target, draft = self.paths(f"{self.folder}/versions/{after + 1:09d}"), f"{self.folder}/drafts/{uuid.uuid4().hex}"
        self._put(draft, json.dumps(parts))
        self.files.mkdirs(target.getParent())
        if self.files.exists(target) or not self.files.rename(self.paths(draft), target):
            raise RuntimeError(f"version {after + 1} of {self.folder} exists: another writer was first")
        return after + 1

    def lease(self, version: int, hours: float = LEASE_HOURS) -> str:
        """Keeps a version's parts for so many hours, or until release()."""
        now = self.spark.sparkContext._jvm.System.currentTimeMillis()
        path = f"{self.folder}/leases/{version:09d}-{now + int(hours * 3_600_000)}-{uuid.uuid4().hex}"
        self._put(path, "")
        return path

    def release(self, lease: str) -> None:
        self.files.delete(self.paths(lease), False)

    def clean(self) -> None:
        """Removes ended leases, the versions and parts that nobody needs, and what writers left that died."""
        now = self.spark.sparkContext._jvm.System.currentTimeMillis()
        leased = set()
        for name in self._names("leases"):
            version, until, _ = name.split("-")
            if int(until) < now:
                self.release(f"{self.folder}/leases/{name}")
            else:
                leased.add(int(version))
        versions = self.versions()
        live = [v for v in versions if v in leased or v in versions[-KEPT:]]
        needed = {p["path"] for v in live for p in self.parts(v)}
        gone = {p["path"] for v in versions if v not in live for p in self.parts(v)} - needed
        written = {path.split("/")[1] for path in needed}
        for path in [*gone, *(f"data/{n}" for n in self._names("data") if n not in written)]:
            self.files.delete(self.paths(f"{self.folder}/{path}"), True)
        for v in versions:
            if v not in live:
                self.files.delete(self.paths(f"{self.folder}/versions/{v:09d}"), False)

    def read(self, parts: list[dict], schema: str | None = None) -> DataFrame | None:
        """The rows of some parts, whose columns may differ; None without parts."""
        if not parts:
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", "true")
        return reader.parquet(*[f"{self.folder}/{p['path']}" for p in parts])


class LibraryStore:
    """Documents, their images and positions in a folder, in buckets by doc_id.

    save() and delete() read and write the buckets of the ids at hand only, and change all tables with one version.
    The buckets in question, a bounded number, are all that comes to the driver.
    """

    TABLES = ("documents", "images", "progress")

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.buckets, self.snapshots = spark, buckets, Snapshots(spark, folder)

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(self.buckets)).cast("int"))

    def _touched(self, *rows: DataFrame) -> set[int]:
        ids = reduce(DataFrame.unionByName, [r.select(F.col("doc_id").cast("long").alias("doc_id")) for r in rows])
        return {r._bucket for r in self._bucket(ids).select("_bucket").distinct().collect()}

    def _rows(self, parts: list[dict], table: str, buckets: set[int] | None = None) -> DataFrame | None:
        return self.snapshots.read([p for p in parts if p["table"] == table and (buckets is None or p["bucket"] in buckets)])

    def _write(self, table: str, rows: DataFrame) -> list[dict]:
        path = self.snapshots.new_path(table)
        self._bucket(rows).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.snapshots.folder}/{path}")
        found = [s.getPath().getName() for s in self.snapshots.files.listStatus(self.snapshots.paths(f"{self.snapshots.folder}/{path}"))]
        return [{"table": table, "bucket": int(n.split("=")[1]), "path": f"{path}/{n}"} for n in found if n.startswith("_bucket=")]

    def _change(self, touched: set[int], changed: dict) -> int:
        """changed: by table, what its touched buckets hold now, from what they held before (None: nothing)."""
        version = self.snapshots.current()
        parts = self.snapshots.parts(version)
        after = [p for p in parts if p["table"] not in changed or p["bucket"] not in touched]
        for table, change in changed.items():
            rows = change(self._rows(parts, table, touched))
            if rows is not None:
                after += self._write(table, rows)
        done = self.snapshots.commit(after, version)
        self.snapshots.clean()
        return done

    def save(self, docs: DataFrame, images: DataFrame | None = None, version: str = "saved_at") -> int:
        """Adds documents, or replaces those of the same id and no greater `version`; a saved document's images are
        replaced by those given. Gives the number of the version that has them."""
        touched = self._touched(*[t for t in (docs, images) if t is not None])

        def own(old):
            both = docs if old is None else old.unionByName(docs, allowMissingColumns=True)
            return L.upsert(both.limit(0), both, "doc_id", version)

        def drawn(old):
            if old is None:
                return images
            kept = old.join(docs.select("doc_id"), "doc_id", "left_anti")
            return kept if images is None else kept.unionByName(images, allowMissingColumns=True)

        return self._change(touched, {"documents": own, "images": drawn})

    def save_progress(self, rows: DataFrame) -> int:
        """Adds positions (doc_id, sentence_index, updated_at, event_id); the greatest of a document stays."""
        latest = F.struct("updated_at", "event_id")
        return self._change(self._touched(rows), {"progress": lambda old: L.upsert(rows if old is None else old, rows, "doc_id", latest)})

    def delete(self, ids: DataFrame) -> int:
        """Removes documents with their images and positions."""
        return self._change(self._touched(ids), {t: lambda old: None if old is None else L.delete_docs(old, ids.select("doc_id")) for t in self.TABLES})

    def load(self, table: str = "documents", ids: DataFrame | None = None, hours: float = LEASE_HOURS) -> DataFrame | None:
        """A table of the current version, kept for the reader by a lease; of some ids: from their buckets alone."""
        version = self.snapshots.current()
        self.snapshots.lease(version, hours)
        rows = self._rows(self.snapshots.parts(version), table, None if ids is None else self._touched(ids))
        if rows is None:
            return None
        rows = rows if ids is None else L.load_docs(rows, ids.select("doc_id"))
        return L.doc_blocks(rows) if table == "documents" and {"blocks", "paragraphs"} & set(rows.columns) else rows

    def image(self, image_id: str, doc_id: int | None = None) -> DataFrame | None:
        """The image of an id; where its document is known, from that document's bucket."""
        ids = None if doc_id is None else self.spark.createDataFrame([(doc_id,)], "doc_id long")
        rows = self.load("images", ids)
        return None if rows is None else rows.where(F.col("image_id") == image_id)
