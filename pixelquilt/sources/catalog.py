"""A catalog of images by name: loads of a name replace its image and count its version up.

Pixels of a load are written once.  The catalog itself is one small table of descriptors for each
snapshot; a snapshot exists from the moment its marker file does, which is created only if it isn't
there yet.  So a failed load changes nothing, a lost task is Spark's to repeat, of two loads at a
time the later one starts again from the other's result, and every older snapshot stays readable.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt.plans.batch import DESCRIPTOR, Batch

_SCHEMA = "image_id long, name string, w int, h int, fmt string, cfa string, black double, white double, cam_mul array<double>, pre_mul array<double>, has_daylight_wb boolean, rgb_cam array<double>, linear boolean, version long, load string"
_PIXELS = "image_id long, x int, y int, w int, h int, c0 double, c1 double, c2 double, c3 double"


def image_name(path):
    """A file's name without folders and without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def snapshot(self) -> int:
        """Number of the newest snapshot, 0 for an empty catalog."""
        at = self._path(f"{self.root}/log")
        if not self._fs.exists(at):
            return 0
        return max([int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit()], default=0)

    def _folder(self, snapshot: int) -> str:
        stream = self._fs.open(self._path(f"{self.root}/log/{snapshot}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def descriptors(self, snapshot: int | None = None) -> DataFrame:
        n = self.snapshot() if snapshot is None else snapshot
        if not n:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.root}/snapshots/{self._folder(n)}")

    def batch(self, snapshot: int | None = None) -> Batch:
        """All images of a snapshot."""
        d = self.descriptors(snapshot)
        loads = [r["load"] for r in d.select("load").distinct().collect()]  # a row a load
        if not loads:
            return Batch(self.spark.createDataFrame([], _PIXELS), d.select(*DESCRIPTOR))
        px = self.spark.read.schema(_PIXELS).parquet(*[f"{self.root}/pixels/{x}" for x in loads])
        return Batch(px.join(d.select("image_id"), "image_id", "left_semi"), d.select(*DESCRIPTOR))

    def install(self, batch: Batch, order: str | None = None, slot: str | None = None) -> int:
        """Load a batch; the number of the snapshot it made.

        order: the descriptors' column that says which of several loads of one name comes last
        (without it, the largest image_id; ties too).  Each load counts the version up, a name's
        first one makes version 0.  slot: column of the name that an image is to replace, taken
        where the catalog has it.  Images without a name, and pixels without a descriptor, are left out.
        """
        load = uuid.uuid4().hex
        while True:
            base = self.snapshot()
            had = self.descriptors(base)
            d = batch.descriptors
            if slot:
                names = had.select(F.col("name").alias(slot), F.col("name").alias("_kept"))
                d = d.join(names, slot, "left").withColumn("name", F.coalesce("_kept", "name"))
            place = F.struct(*([F.col(order)] if order else []), F.col("image_id"))
            own = [c for c in DESCRIPTOR if c not in ("name", "version")]
            new = d.where("name is not null").groupBy("name").agg(F.max_by(F.struct(*own), place).alias("d"), F.count("*").alias("loads"))
            # a number of its own for each version of a name, so that older snapshots keep their pixels
            both = had.join(new, "name", "full_outer")
            version = F.when(F.col("loads").isNull(), F.col("version")).otherwise(F.coalesce("version", F.lit(-1).cast("long")) + F.col("loads"))
            fresh = F.col("loads").isNotNull()
            told = both.select("name", version.alias("version"), F.when(fresh, F.lit(load)).otherwise(F.col("load")).alias("load"), *[F.when(fresh, F.col(f"d.{c}")).otherwise(F.col(c)).alias(c) for c in own if c != "image_id"], F.when(fresh, F.xxhash64("name", version, F.lit(load))).otherwise(F.col("image_id")).alias("image_id"), F.when(fresh, F.col("d.image_id")).alias("_source"))
            folder = f"{base + 1}-{uuid.uuid4().hex}"
            at = f"{self.root}/snapshots/{folder}"
            told.write.parquet(at)
            sources = self.spark.read.parquet(at).where("_source is not null").select(F.col("_source").alias("image_id"), F.col("image_id").alias("_id"))
            px = batch.pixels.join(sources, "image_id").select(F.col("_id").alias("image_id"), *batch.pixels.columns[1:])
            px.select(*[c.split()[0] for c in _PIXELS.split(", ")]).write.mode("overwrite").parquet(f"{self.root}/pixels/{load}")
            if self._commit(base + 1, folder):
                return base + 1

    def _commit(self, n: int, folder: str) -> bool:
        """Make a snapshot the n-th one, if there is none yet."""
        marker = self._path(f"{self.root}/log/{n}")
        try:
            stream = self._fs.create(marker, False)
        except Py4JJavaError:
            if self._fs.exists(marker):
                return False
            raise
        try:
            stream.writeUTF(folder)
        finally:
            stream.close()
        return True
