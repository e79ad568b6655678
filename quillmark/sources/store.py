"""Segment store (S5-S10, S19-S22, I1-I6): tables as immutable parquet segments, and one pointer that names them.

A commit adds one segment of new rows to each table and one list of the sources whose earlier rows are dead, then
replaces the pointer file in one step. So readers see all of a commit or nothing of it, nothing that is being read
is overwritten, and what a commit writes depends on what changed, not on what is there. Segments of like size are
merged eight at a time, so a row is written again a logarithmic number of times; dead rows leave with the merge.
Files no pointer names stay until ``vacuum``. A warehouse has one writing process at a time. The pointer is read and written through Hadoop's file system, so any
storage Spark can write to will do.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import schemas

TABLES = {
    "chunks": schemas.CHUNKS.replace(" not null", "") + ", len int",
    "manifest": schemas.MANIFEST,
    "postings": "source_id string, id string, len int, term string, tf bigint",
    "entities": "source_id string, id string, entity string",
    "cells": "source_id string, id string, vector array<float>, cell int",
    "centroids": "cell int, centroid array<double>",
    "spans": "cell int, least double, most double",
}
DEAD = "source_id string"
POINTER = "_CURRENT"
#: Segments of one size class (a factor of this in rows) that are merged into one.
FAN = 8
#: Lists of dead sources up to this many rows are broadcast, longer ones joined by sorting.
FEW_DEAD = 100_000
#: A source's rows stand together, a term's postings and an entity's chunks too: a scan skips the rest.
_ORDER = {"chunks": "source_id", "manifest": "source_id", "postings": "term", "entities": "entity"}
_PARTITION = {"chunks": "source_type", "cells": "cell"}


class SegmentStore:
    """Tables of one warehouse directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = lambda p: hadoop.Path(f"{self.directory}/{p}" if p else self.directory)
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(""))

    def state(self) -> dict:
        """What the pointer says: the last commit's number, segments by table, lists of the dead, and facts."""
        at = self._path(POINTER)
        if not self._fs.exists(at):
            return {"seq": 0, "tables": {}, "dead": [], "facts": {}}
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def exists(self, name: str, at: dict | None = None) -> bool:
        return name in (at or self.state())["tables"]

    def facts(self, at: dict | None = None) -> dict:
        """Numbers kept up by commits: docs, words, fitted_rows."""
        return (at or self.state())["facts"]

    def rows(self, name: str) -> int:
        """Rows written to a table's segments, dead ones included."""
        return sum(p["rows"] for p in self.state()["tables"].get(name, []))

    def read(self, name: str, at: dict | None = None) -> DataFrame:
        """The live rows; an empty table of the right schema if there are none. at: a state taken before, so that
        several tables are read as of one commit."""
        state = at or self.state()
        return self._live(name, state["tables"].get(name, []), state["dead"])

    def _live(self, name: str, parts: list[dict], dead: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(TABLES[name]).option("basePath", f"{self.directory}/{name}").parquet(*(f"{self.directory}/{p['dir']}" for p in parts))
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        first = min(p["seq"] for p in parts)
        dead = [d for d in dead if d["seq"] > first]
        if not dead or "source_id" not in columns:
            return rows.select(*columns)
        gone = self.spark.read.schema(DEAD).option("basePath", f"{self.directory}/dead").parquet(*(f"{self.directory}/{d['dir']}" for d in dead))
        gone = gone.groupBy(F.col("source_id").alias("_source")).agg(F.max("seq").alias("_until"))
        gone = F.broadcast(gone) if sum(d["rows"] for d in dead) <= FEW_DEAD else gone.hint("merge")
        return rows.join(gone, (F.col("source_id") == F.col("_source")) & (F.col("seq") < F.col("_until")), "left_anti").select(*columns)

    def _write(self, name: str, df: DataFrame, seq: int) -> dict:
        where = f"{name}/seq={seq}/try={uuid.uuid4().hex[:12]}"
        if order := _ORDER.get(name):
            df = df.repartitionByRange(order).sortWithinPartitions(order)
        writer = df.write.mode("errorifexists")
        if by := _PARTITION.get(name):
            writer = writer.partitionBy(by)  # a root's rows are counted alone; a search reads the cells it needs
        writer.parquet(f"{self.directory}/{where}")
        return {"dir": where, "seq": seq, "rows": self.spark.read.schema(TABLES.get(name, DEAD)).parquet(f"{self.directory}/{where}").count()}

    def commit(self, dead: DataFrame | None = None, facts: dict | None = None, drop: tuple[str, ...] = (), replace: dict[str, DataFrame] | None = None, **added: DataFrame) -> None:
        """Adds rows to tables, after taking the rows of the ``dead`` sources (source_id) out of all of them. Tables
        in ``replace`` get new rows only, those in ``drop`` are there no more. All of it becomes visible at once."""
        state = self.state()
        seq = state["seq"] + 1
        tables = {k: v for k, v in state["tables"].items() if k not in drop}
        listed = list(state["dead"])
        rows = {**(replace or {}), **added} | ({} if dead is None else {"dead": dead.select("source_id")})
        with ThreadPoolExecutor(len(rows) or 1) as pool:  # the tables are written side by side
            written = dict(zip(rows, pool.map(lambda name: self._write(name, rows[name], seq), rows), strict=True))
        for name in replace or {}:
            tables[name] = [written[name]]
        for name in added:
            tables[name] = [*tables.get(name, []), written[name]]
        if dead is not None:
            listed.append(written["dead"])
        self._point({"seq": seq, "tables": tables, "dead": [d for d in listed if d["rows"]], "facts": state["facts"] | (facts or {})})
        self._tidy()

    def _tidy(self) -> None:
        """Merges where FAN segments of a table have one size class, or all where a quarter of the sources is dead."""
        state = self.state()
        sources = sum(p["rows"] for p in state["tables"].get("manifest", []))
        everything = sum(d["rows"] for d in state["dead"]) * 4 > max(sources, 4 * 1000)
        tables, seq = {}, state["seq"] + 1
        for name, parts in state["tables"].items():
            classes: dict[int, list[dict]] = {}
            for p in parts:
                classes.setdefault(0 if everything else max(p["rows"], 1).bit_length() // 3, []).append(p)
            for some in classes.values():
                if len(some) >= (1 if everything and "source_id" in TABLES[name] else FAN):
                    rest = [p for p in tables.get(name, parts) if p not in some]
                    tables[name] = [*rest, self._write(name, self._live(name, some, state["dead"]), seq)]
        if tables:
            state["tables"] |= tables
            oldest = min((p["seq"] for n, parts in state["tables"].items() if "source_id" in TABLES[n] for p in parts), default=seq)
            self._point(state | {"seq": seq, "dead": [d for d in state["dead"] if d["seq"] > oldest]})

    def _point(self, state: dict) -> None:
        draft = self._path(f"{POINTER}.{uuid.uuid4().hex[:12]}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self.spark.sparkContext._gateway.new_array(rename, 1)
        overwrite[0] = rename.OVERWRITE
        context.rename(draft, self._path(POINTER), overwrite)

    def vacuum(self) -> int:
        """Deletes segments the pointer no longer names; returns how many."""
        state, gone = self.state(), 0
        current = {p["dir"] for parts in [*state["tables"].values(), state["dead"]] for p in parts}
        for name in (*TABLES, "dead"):
            for at_seq in self._fs.listStatus(self._path(name)) if self._fs.exists(self._path(name)) else []:
                for status in self._fs.listStatus(at_seq.getPath()):
                    if f"{name}/{at_seq.getPath().getName()}/{status.getPath().getName()}" not in current:
                        self._fs.delete(status.getPath(), True)
                        gone += 1
                if not len(self._fs.listStatus(at_seq.getPath())):
                    self._fs.delete(at_seq.getPath(), True)
        return gone

    def rows_by_root(self, labels: list[str]) -> list[tuple[str, int | None, str | None]]:
        """(label, rows, error) for each configured root, from one grouped count; only if that fails root by root,
        as a failure is an error of its root and never a 0 (D5)."""
        counted = F.sum(F.when(F.col("id").isNotNull(), 1).otherwise(0)).alias("n")  # reads a column, not only footers
        try:
            found = {r.source_type: r.n for r in self.read("chunks").where(F.col("source_type").isin(labels)).groupBy("source_type").agg(counted).collect()}
            return [(label, found.get(label, 0), None) for label in sorted(labels)]
        except Exception:  # noqa: BLE001  whose files are at fault is found out below
            out: list[tuple[str, int | None, str | None]] = []
            for label in sorted(labels):
                try:
                    out.append((label, self.read("chunks").where(F.col("source_type") == label).agg(counted).first()[0] or 0, None))
                except Exception as e:  # noqa: BLE001  whatever is wrong with one root's files is reported as such
                    out.append((label, None, str(e).splitlines()[0][:300]))
            return out
