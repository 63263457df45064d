from pyspark.sql import functions as F

from voltrace.plans import catalog, more  # noqa: F401  more registers its queries in the catalog

SMOKE = "/root/testdata/sf0.001"


def test_fits_by_asset_see_the_whole_panel(spark):
    panel = catalog.usable_panel(spark, SMOKE)
    got = catalog.QUERIES["conditional_volatility"](spark, SMOKE)
    first, n = panel.agg(F.min("timestamp"), F.count(F.lit(1))).first()
    assert got.agg(F.min("timestamp"), F.count(F.lit(1))).first() == (first, n)
