"""Tables that are published together: one small manifest names what a version consists of, and a version is there once its manifest is.

A table is stored in buckets of a key, each a folder that never changes; a change writes folders for the buckets that it touches, for as many tables as it
concerns, and commits by putting one manifest in its place, which only one of several can do: who comes second is told (Conflict) and can
start again from the new version. What was written for a change that fails or loses is removed; what a lost driver leaves behind is in no
manifest and read by nothing (``sweep`` removes it). Manifests hold a line for each bucket of each table, BUCKETS by default, whatever the tables' sizes.

Defined cases: a root without versions is version 0 without tables; a bucket without rows has no folder; rows with a null key are in bucket 0."""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, BUCKET = 64, "bucket_"


class Conflict(RuntimeError):
    """Another change was committed first."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.fs = self.at(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.Path(path)

    def name(self, number: int) -> str:
        return f"{self.root}/versions/{number:012d}.json"

    def number(self) -> int:
        """The latest version, 0 if there is none."""
        folder = self.at(f"{self.root}/versions")
        if not self.fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()[:12]) for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json") and s.getPath().getName()[:12].isdigit()), default=0)

    def manifest(self, number: int | None = None) -> dict:
        number = self.number() if number is None else number
        if number == 0:
            return {"version": 0, "tables": {}, "notes": {}}
        stream = self.fs.open(self.at(self.name(number)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def table(self, name: str, number: int | None = None, only: set[int] | None = None) -> DataFrame | None:
        """A table as of a version (null: the latest), or the rows of some of its buckets; None if it has none such."""
        return self.rows_of(self.manifest(number)["tables"].get(name), only)

    def rows_of(self, table: dict | None, only: set[int] | None = None) -> DataFrame | None:
        if table is None:
            return None
        schema = StructType.fromJson(table["schema"])
        parts = [f"{self.root}/data/{p['at']}" for b, p in sorted(table["parts"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def change(self) -> "Change":
        return Change(self)

    def sweep(self) -> int:
        """Removes folders that no version names; to be run while no change is under way. How many there were."""
        known = {p["at"].split("/")[0] for n in range(1, self.number() + 1) if self.fs.exists(self.at(self.name(n))) for t in self.manifest(n)["tables"].values() for p in t["parts"].values()}
        folder = self.at(f"{self.root}/data")
        lost = [s.getPath() for s in self.fs.listStatus(folder) if s.getPath().getName() not in known] if self.fs.exists(folder) else []
        for path in lost:
            self.fs.delete(path, True)
        return len(lost)


class Change:
    """Prepared tables, to be committed together or not at all: ``with store.change() as c: c.put(...); c.commit()`` rolls back what is not committed."""

    def __init__(self, store: Versions):
        self.store, self.base = store, store.manifest()
        self.tables, self.notes, self.made, self.open = dict(self.base["tables"]), dict(self.base.get("notes", {})), [], True

    def __enter__(self) -> "Change":
        return self

    def __exit__(self, *_) -> None:
        if self.open:
            self.roll_back()

    def bucket(self, name: str, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.tables.get(name, {}).get("buckets", BUCKETS))).cast("int")

    def touched(self, name: str, rows: DataFrame, key: Column) -> set[int]:
        """The buckets that rows fall into, BUCKETS at most."""
        return {r[0] for r in rows.select(F.coalesce(self.bucket(name, key), F.lit(0))).distinct().collect()}

    def stored(self, name: str, only: set[int] | None = None) -> DataFrame | None:
        return self.store.rows_of(self.tables.get(name), only)

    def size(self, name: str) -> int:
        return sum(p["rows"] for p in self.tables.get(name, {"parts": {}})["parts"].values())

    def put(self, name: str, rows: DataFrame, key: Column, replaced: set[int] | None = None, buckets: int = BUCKETS) -> None:
        """rows instead of what the buckets ``replaced`` hold (null: all buckets); rows fall into those buckets only."""
        old = self.tables.get(name, {"buckets": buckets, "parts": {}})
        folder = uuid.uuid4().hex
        self.made.append(folder)
        dealt = rows.withColumn(BUCKET, F.coalesce(F.pmod(F.xxhash64(key), F.lit(old["buckets"])).cast("int"), F.lit(0)))
        at = f"{self.store.root}/data/{folder}"
        dealt.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(at)  # a hot bucket is split over tasks
        written = self.store.spark.read.schema(dealt.schema).option("basePath", at).parquet(at)
        counts = {r[0]: r[1] for r in written.groupBy(BUCKET).count().collect()}  # a row for each bucket
        wrong = set(counts) - replaced if replaced is not None else set()
        if wrong:
            raise ValueError(f"{name}: rows outside the buckets that are replaced: {sorted(wrong)}")
        kept = {} if replaced is None else {b: p for b, p in old["parts"].items() if int(b) not in replaced}
        parts = kept | {str(b): {"at": f"{folder}/{BUCKET}={b}", "rows": n} for b, n in counts.items()}
        self.tables[name] = {"schema": rows.schema.jsonValue(), "buckets": old["buckets"], "parts": parts}

    def clear(self, name: str) -> None:
        if name in self.tables:
            self.tables[name] = self.tables[name] | {"parts": {}}

    def commit(self) -> int:
        """The number of the new version; Conflict, and nothing changed, if another was committed since this change began."""
        store, number = self.store, self.base["version"] + 1
        text = json.dumps({"version": number, "tables": self.tables, "notes": self.notes})
        draft = store.at(f"{store.root}/versions/draft-{uuid.uuid4().hex}")
        stream = store.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = store.jvm.FileContext.getFileContext(store.at(store.root).toUri() if ":" in store.root else store.fs.getUri(), store.spark._jsc.hadoopConfiguration())
        options = store.spark.sparkContext._gateway.new_array(getattr(store.jvm, "Options$Rename"), 0)  # none: what is there stays
        try:
            context.rename(draft, store.at(store.name(number)), options)
        except Exception as e:
            store.fs.delete(draft, False)
            self.roll_back()
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {number} of {store.root} is another change's") from e
            raise
        self.open = False
        return number

    def roll_back(self) -> None:
        for folder in self.made:
            self.store.fs.delete(self.store.at(f"{self.store.root}/data/{folder}"), True)
        self.made, self.open = [], False
