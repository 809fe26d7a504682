"""The stored catalog: Parquet files under a manifest, with an inverted index beside the rows.

A snapshot names one manifest, which lists every data file with its leaf and its range of skus. A
leaf is a tenant and a prefix of the hash of its products' keys; together a tenant's leaves cover
all hashes. A write makes new files for the leaves it touches, a new manifest, and last of all the
next snapshot file, renamed into place: until then readers see the former snapshot, whatever fails.
Leaves that outgrow ``leaf_rows`` are split by further bits of the hash, so a tenant with a third of
all products is many files and many write tasks.

Readers open the files that the manifest lists, with the schema that the snapshot keeps: no folder
is listed and no footers are merged.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators import text_index
from shelfspark.session import materialise

KEYS = ["tenant", "sku"]
LEAF = ["tenant", "depth", "prefix"]
LEAF_ROWS = 50_000
ROWS, POSTINGS = "rows", "postings"
#: Bits of a key's hash that leaves are told apart by.
HASH_BITS = 32
MANIFEST = ("kind string, tenant string, depth int, prefix long, file string, rows long, tokens long, "
            "least_sku string, most_sku string")


class ConcurrentWrite(RuntimeError):
    """Another writer has put the next snapshot in place; read again and repeat the write."""


def merge_upsert(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """Existing rows not replaced, plus the changes; applying it twice changes nothing."""
    return existing.join(changes.select(*KEYS), KEYS, "left_anti").unionByName(
        changes, allowMissingColumns=True)


def delete_keys(existing: DataFrame, keys: DataFrame) -> DataFrame:
    return existing.join(keys.select(*KEYS), KEYS, "left_anti")


def count_deleted(existing: DataFrame, keys: DataFrame) -> DataFrame:
    """How many stored rows the keys remove, per tenant."""
    return existing.join(keys.select(*KEYS), KEYS, "left_semi").groupBy("tenant").agg(
        F.count("*").alias("deleted"))


def drop_tenant(existing: DataFrame, tenant: str) -> DataFrame:
    return existing.where(F.col("tenant") != tenant)


def add_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema that are absent, as nulls; nothing is dropped or retyped."""
    missing = [field for field in schema.fields if field.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def key_hash() -> Column:
    """Unsigned 32-bit hash of a product's key."""
    return F.shiftrightunsigned(F.xxhash64(*KEYS), 64 - HASH_BITS)


def _prefix(depth: str) -> Column:
    return F.expr(f"shiftrightunsigned(_hash, {HASH_BITS} - {depth})")


def place(rows: DataFrame, leaves: DataFrame, first_depth: int | None = None) -> DataFrame:
    """Rows with depth and prefix of their leaf.

    A tenant has few different depths, so a row tries each of them and meets one leaf. Rows of
    tenants without leaves go where ``first_depth`` says, or are left out without it.
    """
    depths = leaves.groupBy("tenant").agg(F.collect_set("depth").alias("_depths"))
    hashed = rows.withColumn("_hash", key_hash())
    known = (hashed.join(depths, "tenant").withColumn("depth", F.explode("_depths"))
             .withColumn("prefix", _prefix("depth")).drop("_depths")
             .join(leaves.select(*LEAF).distinct(), LEAF, "left_semi"))
    if first_depth is None:
        return known.drop("_hash")
    fresh = (hashed.join(depths.select("tenant"), "tenant", "left_anti")
             .withColumn("depth", F.lit(first_depth)).withColumn("prefix", _prefix("depth")))
    return known.unionByName(fresh).drop("_hash")


@dataclass(frozen=True)
class Snapshot:
    """What one snapshot file says."""

    number: int
    manifest: str
    schema: T.StructType
    buckets: int
    indexed: bool

    @classmethod
    def read(cls, number: int, text: str) -> Snapshot:
        told = json.loads(text)
        return cls(number, told["manifest"], T.StructType.fromJson(told["schema"]), told["buckets"],
                   told["indexed"])

    def text(self) -> str:
        return json.dumps({"manifest": self.manifest, "schema": self.schema.jsonValue(),
                           "buckets": self.buckets, "indexed": self.indexed})


class CatalogTable:
    """One catalog folder.

    ``buckets`` (a power of two) is how many leaves a new tenant starts with, and ``indexed`` whether
    the rows' searchable text is kept as an inverted index; the table keeps what it was first
    written with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1, leaf_rows: int = LEAF_ROWS,
                 indexed: bool = False):
        self.spark, self.path, self.leaf_rows = spark, path.rstrip("/"), leaf_rows
        latest = self.snapshot()
        self.buckets = latest.buckets if latest else 1 << max(0, math.ceil(math.log2(buckets)))
        self.indexed = latest.indexed if latest else indexed

    # --- snapshots ------------------------------------------------------------------------

    def _file(self, name: str):
        file = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return file.getFileSystem(self.spark._jsc.hadoopConfiguration()), file

    def versions(self) -> list[int]:
        """Numbers of the snapshots that are kept."""
        fs, folder = self._file("snapshots")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n[:1].isdigit())

    def snapshot(self, number: int | None = None) -> Snapshot | None:
        """A snapshot, the newest by default; None where nothing has been written."""
        if number is None:
            number = (self.versions() or [None])[-1]
        if number is None:
            return None
        fs, file = self._file(f"snapshots/{number:010d}.json")
        stream = fs.open(file)
        try:
            return Snapshot.read(number, self.spark._jvm.org.apache.commons.io.IOUtils.toString(
                stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, before: Snapshot | None, manifest: DataFrame, schema: T.StructType) -> None:
        """Write the manifest, then put the next snapshot in place by one rename."""
        path = f"{self.path}/manifests/{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(path)
        number = before.number + 1 if before else 0
        new = Snapshot(number, path, schema, self.buckets, self.indexed)
        fs, made = self._file(f"snapshots/.{uuid.uuid4().hex}")
        stream = fs.create(made)
        stream.write(bytearray(new.text().encode()))
        stream.close()
        _, final = self._file(f"snapshots/{number:010d}.json")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            fs.getUri(), self.spark._jsc.hadoopConfiguration())
        # Without options a rename never replaces a file.
        options = self.spark.sparkContext._gateway.new_array(
            getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(made), fs.makeQualified(final), options)
        except Py4JJavaError as error:
            fs.delete(made, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise ConcurrentWrite(f"snapshot {number} of {self.path} exists") from error
            raise

    def manifest(self, snapshot: Snapshot) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(snapshot.manifest)

    def expire(self, keep: int = 5) -> int:
        """Forget all but the newest snapshots and remove data that none of the kept ones lists;
        returns the removed data folders. No writer may be at work."""
        numbers = self.versions()
        for number in numbers[:-keep]:
            fs, file = self._file(f"snapshots/{number:010d}.json")
            fs.delete(file, False)
        held, manifests = set(), set()
        for snapshot in map(self.snapshot, numbers[-keep:]):
            manifests.add(snapshot.manifest.rsplit("/", 1)[-1])
            folder = F.regexp_extract("file", r"/data/([^/]+)/", 1).alias("folder")
            held |= {r["folder"] for r in self.manifest(snapshot).select(folder).distinct().collect()}
        removed = 0
        for name, kept in (("data", held), ("manifests", manifests)):
            fs, folder = self._file(name)
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                if status.getPath().getName() not in kept:
                    fs.delete(status.getPath(), True)
                    removed += name == "data"
        return removed

    # --- reading --------------------------------------------------------------------------

    def exists(self) -> bool:
        return bool(self.versions())

    def _read(self, manifest: DataFrame, kind: str, schema: T.StructType) -> DataFrame:
        files = [r["file"] for r in manifest.where((F.col("kind") == kind) & F.col("file").isNotNull())
                 .select("file").collect()]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)

    def scan(self, tenant: str | None = None, columns: Sequence[str] | None = None,
             snapshot: int | None = None) -> DataFrame:
        """Live rows of a snapshot; the tenant prunes files, the columns prune the scan."""
        held = self.snapshot(snapshot)
        manifest = self.manifest(held)
        if tenant is not None:
            manifest = manifest.where(F.col("tenant") == tenant)
        rows = self._read(manifest, ROWS, held.schema)
        return rows.select(*columns) if columns else rows.drop(text_index.TOKENS)

    def content_hashes(self, tenant: str | None = None) -> DataFrame:
        return self.scan(tenant, ["tenant", "sku", "content_hash"])

    def index(self, snapshot: int | None = None) -> text_index.StoredIndex:
        """The inverted index of a snapshot; document statistics come from the manifest alone."""
        held = self.snapshot(snapshot)
        if not held.indexed:
            raise ValueError(f"{self.path} keeps no index")
        manifest = self.manifest(held)
        stats = manifest.where(F.col("kind") == ROWS).groupBy("tenant").agg(
            F.sum("rows").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return text_index.StoredIndex(
            self._read(manifest, POSTINGS, text_index.SCHEMA), stats,
            self._read(manifest, ROWS, held.schema).select(*KEYS, text_index.TOKENS))

    # --- writing --------------------------------------------------------------------------

    def _written(self, rows: DataFrame, kind: str, order: Sequence[str], tokens: Column) -> DataFrame:
        """Manifest entries of rows written in files of one leaf each."""
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        leaf = F.concat_ws("~", F.col("depth").cast("string"), F.col("prefix").cast("string"), "tenant")
        (rows.withColumn("leaf", leaf).repartition("leaf").sortWithinPartitions("leaf", *order)
         .drop("depth", "prefix").write.partitionBy("leaf").parquet(path))
        # What was written, read back narrow: the listing of this new folder is the only one.
        back = self.spark.read.schema(rows.drop("depth", "prefix").schema.add("leaf", "string")).parquet(path)
        part = F.split("leaf", "~", 3)
        key = "sku" if kind == ROWS else "term"
        # The path comes with its odd characters encoded, but for the plus sign.
        file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        return (back.groupBy(file.alias("file"), "tenant",
                             F.get(part, F.lit(0)).cast("int").alias("depth"),
                             F.get(part, F.lit(1)).cast("long").alias("prefix"))
                .agg(F.count("*").alias("rows"), F.sum(tokens).alias("tokens"),
                     F.min(key).alias("least_sku"), F.max(key).alias("most_sku"))
                .select(F.lit(kind).alias("kind"), *LEAF, "file", "rows", "tokens", "least_sku", "most_sku"))

    def _rewrite(self, keys: DataFrame, changes: DataFrame | None) -> None:
        """New files for the leaves of ``keys``, without these keys and with the changes."""
        before = self.snapshot()
        empty = self.spark.createDataFrame([], MANIFEST)
        manifest = self.manifest(before) if before else empty
        leaves = manifest.where(F.col("kind") == ROWS)
        first_depth = self.buckets.bit_length() - 1
        incoming = place(keys.select(*KEYS), leaves, first_depth).groupBy(*LEAF).agg(
            F.count("*").alias("incoming"))
        held = leaves.groupBy(*LEAF).agg(F.sum("rows").alias("held"))
        size = F.col("incoming") + F.coalesce("held", F.lit(0))
        more = F.greatest(F.lit(0), F.ceil(F.log2(size / F.lit(self.leaf_rows)))).cast("int")
        touched = materialise(incoming.join(held, LEAF, "left").select(
            *LEAF, F.least(more, F.lit(HASH_BITS) - F.col("depth")).alias("more")))
        old = self._read(leaves.join(touched, LEAF, "left_semi"), ROWS,
                         before.schema if before else changes.schema)
        merged = delete_keys(old, keys)
        if changes is not None:
            merged = merged.unionByName(changes, allowMissingColumns=True)
        placed = place(merged, touched).join(touched, LEAF).withColumn("_hash", key_hash())
        placed = (placed.withColumn("depth", (F.col("depth") + F.col("more")).cast("int"))
                  .withColumn("prefix", _prefix("depth")).drop("_hash", "more"))
        schema = T.StructType([f for f in placed.schema.fields if f.name not in ("depth", "prefix")])
        tokens = F.size(text_index.TOKENS).cast("long") if self.indexed else F.lit(0).cast("long")
        new = self._written(placed, ROWS, ["sku"], tokens)
        if self.indexed:
            new = new.unionByName(self._written(text_index.blocks(placed, LEAF), POSTINGS,
                                                ["term", "block"], F.lit(0).cast("long")))
        # Leaves without rows stay, so that a tenant's leaves go on covering all hashes.
        split = touched.select("tenant", (F.col("depth") + F.col("more")).cast("int").alias("depth"), F.explode(
            F.expr("sequence(shiftleft(prefix, more), shiftleft(prefix + 1, more) - 1)")).alias("prefix"))
        covered = first_leaves(touched.join(leaves.select("tenant"), "tenant", "left_anti"), first_depth)
        bare = split.unionByName(covered.join(touched, LEAF, "left_anti")).select(
            F.lit(ROWS).alias("kind"), *LEAF, F.lit(None).cast("string").alias("file"),
            F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("tokens"),
            F.lit(None).cast("string").alias("least_sku"), F.lit(None).cast("string").alias("most_sku"))
        new = materialise(new)
        bare = bare.join(new.where(F.col("kind") == ROWS), LEAF, "left_anti")
        kept = manifest.join(touched, LEAF, "left_anti")
        self._commit(before, kept.select(*new.columns).unionByName(new).unionByName(
            bare.select(*new.columns)), schema)

    def upsert(self, changes: DataFrame) -> None:
        if self.indexed:
            changes = text_index.with_tokens(changes)
        changes = materialise(changes)
        self._rewrite(changes, changes)

    def delete(self, keys: DataFrame) -> int:
        """Remove the listed products, returning how many were there."""
        if not self.exists():
            return 0
        gone = materialise(self.scan(columns=KEYS).join(keys.select(*KEYS), KEYS, "left_semi"))
        removed = gone.count()
        if removed:
            self._rewrite(gone, None)
        return removed

    def drop_tenant(self, tenant: str) -> bool:
        """A snapshot without one tenant's files; whether it had any."""
        before = self.snapshot()
        if before is None:
            return False
        manifest = self.manifest(before)
        own = F.col("tenant") == tenant
        if manifest.where(own).isEmpty():
            return False
        self._commit(before, manifest.where(~own), before.schema)
        return True


def first_leaves(tenants: DataFrame, depth: int) -> DataFrame:
    """The leaves that new tenants start with."""
    return tenants.select("tenant").distinct().select(
        "tenant", F.lit(depth).alias("depth"), F.explode(F.sequence(
            F.lit(0).cast("long"), F.lit((1 << depth) - 1).cast("long"))).alias("prefix"))
