"""Images and mosaics by name: what a chain of operators begins with."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelquilt.operators.demosaic import demosaic
from pixelquilt.plans.batch import Batch


def _named(batch: Batch, names: tuple[str, ...]) -> Batch:
    """The images of these names, all without any; a name that no image has is an error."""
    if not names:
        return batch
    found = batch.descriptors.where(F.col("name").isin(list(names))).groupBy("name").agg(F.count("*").alias("n")).collect()  # a row a name that was asked for
    if missing := sorted(set(names) - {r["name"] for r in found}):
        raise ValueError(f"no image named '{missing[0]}'")
    return batch.where(F.col("name").isin(list(names)))


def image(batch: Batch, *names: str, method: str = "demosaic_malvar") -> Batch:
    """Images ready for any operator: mosaics go through the default demosaicing, all others as they are."""
    chosen = _named(batch, names)
    plain = chosen.where(F.col("cfa") == "None")
    return plain.union(demosaic(chosen, method))


def mosaic(batch: Batch, *names: str) -> Batch:
    """Sensor mosaics as they are; a name of another image is an error."""
    chosen = _named(batch, names)
    if names:
        plain = chosen.descriptors.where("cfa = 'None'").select("name").limit(1).collect()
        if plain:
            raise ValueError(f"'{plain[0]['name']}' is no sensor image, so it has no mosaic; use image()")
    return chosen.where(F.col("cfa") != "None")
