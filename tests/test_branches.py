"""Fingerprints of chains, and shared beginnings."""

import pytest
from pyspark.sql import functions as F

from pixelquilt.plans import branches, registry
from pixelquilt.plans.raster import Raster


def test_hash_stands_for_snapped_values():
    h = branches.params_hash
    assert h("box_blur") == h("box_blur", {"radius": 3}) == h("box_blur", {"radius": 3.9}) != h("box_blur", {"radius": 4})
    assert h("threshold", {"level": 100, "invert": 0}) == h("threshold", {"invert": False, "level": 100.4})
    assert h("threshold", {"level": -0.0}) == h("threshold", {"level": 0})
    assert h("box_blur", {"radius": 1000}) == h("box_blur", {"radius": 64})
    #: Equal values of other parameters are other hashes by their place.
    assert h("brightness", {"brightness": 1, "gain": 0}) != h("brightness", {"brightness": 0, "gain": 1})
    with pytest.raises(TypeError):
        h("box_blur", {"size": 3})


def test_defaults_follow_where_untouched():
    op = registry.get("basic_adjust").with_defaults(kelvin=5217.0)
    assert op.values()["kelvin"] == 5217.0  # not snapped
    assert op.values(kelvin=5217)["kelvin"] == 5200.0
    assert registry.get("basic_adjust").with_defaults(kelvin=1e9).values()["kelvin"] == 25000.0
    assert registry.get("basic_adjust").values()["kelvin"] == 0.0
    with pytest.raises(TypeError):
        op.with_defaults(warmth=1)


def test_fingerprints_follow_the_whole_chain():
    one = branches.fingerprints(["grayscale", ("box_blur", {"radius": 3})])
    assert one == branches.fingerprints([("grayscale", {}), "box_blur"])
    other = branches.fingerprints([("grayscale", {"r_weight": 0.3}), "box_blur"])
    assert one[0] != other[0] and one[1] != other[1]
    assert branches.fingerprints(["box_blur"], "a") != branches.fingerprints(["box_blur"], "b")
    assert branches.fingerprints([]) == []


def test_shared_steps_are_computed_once(spark, monkeypatch):
    written = []
    real = branches.materialize
    monkeypatch.setattr(branches, "materialize", lambda df, name: written.append(name) or real(df, name))
    px = spark.range(12).selectExpr("1L as image_id", "cast(id % 4 as int) as x", "cast(id div 4 as int) as y", "4 as w", "3 as h").withColumn("c0", F.col("x") * 60.0)
    blur, chains = ("box_blur", {"radius": 1}), {}
    chains["plain"] = []
    chains["one"] = [blur, ("threshold", {"level": 90})]
    chains["two"] = [blur, ("threshold", {"level": 90.2})]
    chains["three"] = [("box_blur", {"radius": 1.5}), ("brightness", {"brightness": 0.5})]
    chains["alone"] = ["grayscale", ("threshold", {"level": 10})]
    got = branches.run_all(Raster(px, "R32F"), chains)
    assert len(written) == 2  # the blur, and the threshold that two chains end with
    assert got["plain"].pixels is px and got["one"] is got["two"]
    for name, chain in chains.items():
        want = registry.run(Raster(px, "R32F"), *chain).pixels
        assert sorted(map(tuple, got[name].pixels.collect())) == sorted(map(tuple, want.collect()))


def test_info(spark):
    from pixelquilt.operators.display import info

    px = spark.range(800).selectExpr("1L as image_id", "cast(id % 40 as int) as x", "cast(id div 40 as int) as y", "40 as w", "20 as h", "if(id < 80, 0d, 255d) as c0")
    px = px.withColumns({"c1": F.col("c0"), "c2": F.col("c0"), "c3": F.lit(255.0)})
    got = info(Raster(px, "RGBA8")).first()
    assert tuple(got) == (1, "40 x 20  (0.0 MP)", "RGBA8   0.0 MB", "mean 229.5   median 255.0   stddev 76.5", "clipped: 10.0% black, 90.0% white", None)
    assert info(Raster(px.where("x < 0"), "RGBA8")).count() == 0
