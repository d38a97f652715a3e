"""Tables as immutable Parquet parts under numbered manifests.

Each change writes new parts, if any, and then publishes the next manifest, which a reader sees whole or not at all.  A
reader keeps the version that it resolved.  Deletions are kept in the manifest as conditions on the rows that were
there, so that deleting rewrites nothing; ``compact`` applies them.  Declared indexes decide how parts are laid out and
never change a result.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.errors import BindError, EngineError
from quadrille.functions.convert import literal
from quadrille.functions.points import cell
from quadrille.sources import delimited
from quadrille.sources.delimited import LoadReport
from quadrille.types import RID, TableSpec

log = logging.getLogger(__name__)


#: Parts of single rows that are merged into one, and deletions after which a table is rewritten without them.
MOST_SMALL, MOST_DELETIONS = 64, 256
#: Seconds after which the claim of a writer that has ended between claiming and publishing is void.
CLAIM_SECONDS = 600


class Catalog:
    """Tables below a folder, which can be in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._writing = threading.RLock()

    # Files, through Hadoop's file systems.

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, table: str) -> list[int]:
        folder = self._path(table)
        fs = self._fs(folder)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())

    def _manifest(self, table: str) -> dict:
        table = table.lower()
        versions = self._versions(table)
        if not versions:
            raise BindError(f"table '{table}' does not exist")
        path = self._path(table, f"manifest-{versions[-1]}.json")
        stream = self._fs(path).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, table: str, manifest: dict) -> None:
        version = manifest["version"]
        final, draft, claim = (self._path(table, n) for n in (f"manifest-{version}.json", f".draft-{uuid.uuid4().hex}", f".claim-{version}"))
        fs = self._fs(draft)
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        # Of several writers of a version, in whatever process, one makes the claim; only that one publishes.
        if fs.exists(final) or not self._claimed(fs, claim) or fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise EngineError(f"table '{table}' was changed by another writer; try again")
        log.info("table %s is at version %d: %d parts, %d deletions", table, version, len(manifest["parts"]), len(manifest["deleted"]))

    def _claimed(self, fs, claim) -> bool:
        """Create a file that isn't there yet, atomically as far as the store can."""
        if fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS:
            fs.delete(claim, False)
        if fs.getUri().getScheme() == "file":
            return self.spark._jvm.java.io.File(claim.toUri().getPath()).createNewFile()
        return fs.createNewFile(claim)

    def _write(self, spec: TableSpec, rows: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        keys: list[Column] = []
        writer_options = {}
        for c in spec.columns:
            name = f"`{c.name}`"
            if c.hint in ("SEQUENTIAL", "BTREE"):
                keys.append(F.col(name))
            elif c.hint == "RTREE":
                keys.append(cell(F.col(name)))
            elif c.hint == "HASH":
                writer_options[f"parquet.bloom.filter.enabled#{c.name}"] = "true"
        laid = rows.sortWithinPartitions(*keys, RID) if keys else rows
        laid.write.options(**writer_options).parquet("/".join([self.root, spec.name, part]))
        return part

    # Tables.

    def tables(self) -> list[str]:
        folder = self._path()
        fs = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder) if self._versions(s.getPath().getName())) if fs.exists(folder) else []

    def spec(self, table: str) -> TableSpec:
        return TableSpec.from_json(self._manifest(table)["spec"])

    def read(self, table: str, deleted: bool = False) -> DataFrame:
        """The rows of the current version, with RID; with ``deleted`` also those whose deletion hasn't been compacted."""
        manifest = self._manifest(table)
        return self._read(manifest | {"deleted": []} if deleted else manifest)

    def describe(self, table: str) -> dict:
        """The current manifest: version, columns, parts, deletions, and next_rid, the number of rows ever given an id."""
        return self._manifest(table)

    def _read(self, manifest: dict) -> DataFrame:
        spec = TableSpec.from_json(manifest["spec"])
        if not manifest["parts"]:
            return self.spark.createDataFrame([], spec.schema)
        rows = self.spark.read.schema(spec.schema).parquet(*["/".join([self.root, spec.name, p]) for p in manifest["parts"]])
        for gone in manifest["deleted"]:
            value = literal(spec.column(gone["column"]), gone["kind"], tuple(gone["value"]) if isinstance(gone["value"], list) else gone["value"])
            rows = rows.where(~F.col(f"`{gone['column']}`").eqNullSafe(value) | (F.col(RID) >= gone["before"]))
        return rows

    def create(self, spec: TableSpec, source: str | None = None, delimiter: str = ";", max_rows: int | None = None) -> LoadReport:
        """Create or replace a table, empty or loaded from a delimited file.  A failed load leaves the old table."""
        with self._writing:
            version = max(self._versions(spec.name), default=0) + 1
            parts, next_rid, told = [], 0, LoadReport(0, 0)
            if source is not None:
                good, bad = delimited.load(self.spark, spec, source, delimiter, max_rows)
                parts = [self._write(spec, good)]
                made = self.spark.read.schema(spec.schema).parquet("/".join([self.root, spec.name, parts[0]])).agg(F.count(F.lit(1)), F.max(RID)).first()
                next_rid, told = (made[1] + 1 if made[0] else 0), delimited.report(made[0], bad)
            self._publish(spec.name, {"spec": spec.as_json(), "version": version, "parts": parts, "deleted": [], "next_rid": next_rid})
            return told

    def load(self, table: str, source: str, delimiter: str = ";", max_rows: int | None = None) -> LoadReport:
        """Append the rows of a delimited file; rows whose primary key is there already are skipped."""
        with self._writing:
            manifest = self._manifest(table)
            spec = TableSpec.from_json(manifest["spec"])
            good, bad = delimited.load(self.spark, spec, source, delimiter, max_rows)
            if key := spec.primary:
                there = self._read(manifest).select(F.col(f"`{key.name}`").alias("__there")).distinct()
                match = F.col(f"`{key.name}`") == F.col("__there")
                bad = bad.unionByName(good.join(there, match, "left_semi").select(RID, F.concat(F.lit(f"primary key '{key.name}' repeats "), F.col(f"`{key.name}`").cast("string")).alias("__why")))
                good = good.join(there, match, "left_anti")
            part = self._write(spec, good.withColumn(RID, F.col(RID) + F.lit(manifest["next_rid"])))
            made = self.spark.read.schema(spec.schema).parquet("/".join([self.root, spec.name, part])).agg(F.count(F.lit(1)), F.max(RID)).first()
            told = delimited.report(made[0], bad)
            self._publish(spec.name, manifest | {"version": manifest["version"] + 1, "parts": [*manifest["parts"], part], "next_rid": made[1] + 1 if made[0] else manifest["next_rid"]})
            return told

    def insert(self, table: str, values: list[tuple[str, object]]) -> int:
        """Append one row of (literal kind, value); its RID is returned."""
        with self._writing:
            manifest = self._manifest(table)
            spec = TableSpec.from_json(manifest["spec"])
            if len(values) != len(spec.columns):
                raise BindError(f"table '{spec.name}' has {len(spec.columns)} columns, not {len(values)}")
            cells = [literal(c, kind, value) for c, (kind, value) in zip(spec.columns, values, strict=True)]
            if key := spec.primary:
                same = cells[spec.columns.index(key)]
                if not self._read(manifest).where(F.col(f"`{key.name}`") == same).isEmpty():
                    raise BindError(f"primary key '{key.name}' is taken")
            rid = manifest["next_rid"]
            row = self.spark.range(1).select(*[v.cast(spec.schema[c.name].dataType).alias(c.name) for c, v in zip(spec.columns, cells, strict=True)], F.lit(rid).cast("long").alias(RID))
            part = self._write(spec, row)
            parts, single = [*manifest["parts"], part], [*manifest.get("small", []), part]
            if len(single) >= MOST_SMALL:
                merged = self._write(spec, self._read(manifest | {"parts": single, "deleted": []}).coalesce(1))
                parts, single = [*[p for p in parts if p not in single], merged], []
            self._publish(spec.name, manifest | {"version": manifest["version"] + 1, "parts": parts, "small": single, "next_rid": rid + 1})
            return rid

    def delete_equal(self, table: str, column: str, kind: str, value: object) -> int:
        """Delete the rows whose column equals a literal; their number is returned."""
        with self._writing:
            manifest = self._manifest(table)
            spec = TableSpec.from_json(manifest["spec"])
            same = literal(spec.column(column), kind, value)
            gone = self._read(manifest).where(F.col(f"`{column}`") == same).count()
            if gone:
                condition = {"column": column, "kind": kind, "value": list(value) if isinstance(value, tuple) else value, "before": manifest["next_rid"]}
                self._publish(spec.name, manifest | {"version": manifest["version"] + 1, "deleted": [*manifest["deleted"], condition]})
                if len(manifest["deleted"]) + 1 >= MOST_DELETIONS:
                    self.compact(table)
            return gone

    def compact(self, table: str) -> None:
        """Write the current rows as one part, without the deleted ones."""
        self._rewrite(table, lambda rows: rows)

    def _rewrite(self, table: str, change: Callable[[DataFrame], DataFrame]) -> None:
        with self._writing:
            manifest = self._manifest(table)
            spec = TableSpec.from_json(manifest["spec"])
            part = self._write(spec, change(self._read(manifest)))
            self._publish(spec.name, manifest | {"version": manifest["version"] + 1, "parts": [part], "small": [], "deleted": []})

    def read_row(self, table: str, rid: int) -> DataFrame:
        rows = self.read(table).where(F.col(RID) == rid)
        if rows.isEmpty():
            raise BindError(f"table '{table}' has no row {rid}")
        return rows
