"""Cases of the fourth round's findings."""

from chronodiff.operators import raster
from chronodiff.plans import all as _all  # noqa: F401
from chronodiff.plans import registry
from tests.oracle import same, views


def test_large_pictures_are_grouped_too(spark):
    """a picture with more than 60,000 dilated cells came out as one region."""
    lone = {(4 * k, 4 * n) for k in range(85) for n in range(85)}
    joined = {(x + 1, 0) for x, y in lone if y == 0}
    cells = spark.createDataFrame([(7, x, y, True) for x, y in lone | joined], "shot int, x int, y int, differs boolean")
    grown = {(x + i, y + j) for x, y in lone | joined for i in (-1, 0, 1) for j in (-1, 0, 1)}
    around = spark.createDataFrame([(7, x, y, False) for x, y in grown - lone - joined], cells.schema)
    assert len(grown) > 60_000
    got = sorted(tuple(r)[1:] for r in raster.raster_regions(cells.unionByName(around), 10_000).collect())
    assert got == sorted([(0, 0, 337, 0, 170)] + [(x, y, x, y, 1) for x, y in lone if y])


def test_the_query_groups_large_pictures(spark, tmp_path):
    """one picture of 32 x 3,600 cells whose lone cells have 64,800 with their neighbours, a small one whose embeddings overlap, so that cells have two rows."""
    far = lambda n, period: [0.0 if i % period == 0 else 0.0005 for i in range(n)]
    tall = [0.0 if i % 8 in (2, 6) and i // 8 % 4 == 1 else 0.0005 for i in range(8 * 3600)]
    rows = [(k, tall, 0) for k in range(4)] + [(8 + k, far(128, 32), 0) for k in range(8)] + [(16, far(64, 9), 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = registry.QUERIES["c21_raster_regions"](spark, str(tmp_path))
    same(found, registry.ORACLES["c21_raster_regions"], views(str(tmp_path)))
    assert found.where("shot = 0").count() == 50 and found.where("shot = 1 AND cells > 1").count() > 0
