"""What the models keep and move."""

from panelspark import registry
from panelspark.operators import models, ranks
from tests.conftest import SMALL


def test_rows_are_kept_once(spark):
    spark.catalog.clearCache()
    kept = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = kept()
    registry.QUERIES["ml4_out_of_fold"](spark, SMALL).count()
    assert kept() - before == 1


def test_only_edges_and_returns_go_through_the_ranks(spark, monkeypatch):
    seen, own = [], ranks.average_ranks
    monkeypatch.setattr(ranks, "average_ranks", lambda df, *more: seen.append(set(df.columns)) or own(df, *more))
    rows = [(s, d, x, 0.01 * x, 0.2, 0.3, 0.5 - d / 100, x, 0) for s in "ab" for d, x in enumerate((1, -1, 0, 1))]
    oof = spark.createDataFrame(rows, "symbol string, trade_date int, label int, realised double, p_sell double, p_hold double, p_buy double, pred int, fold int")
    r = models.card(oof).first()
    assert all(s <= {"edge", "realised", "k_edge"} for s in seen) and len(seen) == 2
    assert r.n == 8 and r.buy_as_buy == 4 and r.hit_rate == 1.0 and r.ic == -0.1054 and list(r.asDict())[-1] == "ic_t"
