"""Published tables: same answers in both layouts; the bucketed layout
removes the shuffles, the clustered one spreads a hot key over files."""

from innkeep.oracle.compare import _rows
from innkeep.operators import aggregates as agg
from innkeep.plans.directory import HotelAnswers
from innkeep.sources.layout import CatalogTables, publish_tables


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


ARGS = dict(city="nation_1", country="", ratings=2.0, sort_availability="high to low",
            bookings_count="low to high")


def test_clustered_layout_answers_the_same(spark, fx):
    publish_tables(fx, "lodging_clustered", buckets=4, layout="clustered")
    stored = CatalogTables(spark, "lodging_clustered", base=fx)
    a, b = HotelAnswers(fx).hotel_admin_search(**ARGS), HotelAnswers(stored).hotel_admin_search(**ARGS)
    assert _rows(a.columns, a.collect()) == _rows(b.columns, b.collect())
    files = spark.table("lodging_clustered.rooms").inputFiles()
    assert len(files) > 1


def test_bucketed_layout_removes_shuffles(spark, fx):
    publish_tables(fx, "lodging_bucketed", buckets=4, layout="bucketed")
    stored = CatalogTables(spark, "lodging_bucketed", base=fx)
    a, b = HotelAnswers(fx).hotel_admin_search(**ARGS), HotelAnswers(stored).hotel_admin_search(**ARGS)
    assert _rows(a.columns, a.collect()) == _rows(b.columns, b.collect())
    derived = agg.room_stats(fx.rooms()).join(agg.review_summary(fx.reviews()), "hotel_id")
    bucketed = agg.room_stats(stored.rooms()).join(agg.review_summary(stored.reviews()), "hotel_id")
    derived.collect(), bucketed.collect()
    assert _exchanges(bucketed) == 0 < _exchanges(derived)
