"""The six predicates of articles, one at a time, and both passes of their identity."""

import datetime as dt

from panelspark.operators import news

NOW = dt.datetime(2024, 1, 31)
ITEM = "position bigint, id string, url string, title string, language string, published_at timestamp, entities array<struct<symbol:string,country:string,exchange:string>>"
GOOD = {"position": 1, "id": "a", "url": "https://x.org/1", "title": " T ", "language": "en", "published_at": NOW - dt.timedelta(days=1), "entities": [("S1", "us", "X")]}


def found(spark, *items, listing=("S1", None, None), **kept):
    rows = [tuple({**GOOD, **i}.values()) for i in items]
    out = news.of_listings(spark.createDataFrame(rows, ITEM), spark.createDataFrame([listing], "symbol string, country string, exchange string"), "2024-01-31", **kept)
    return [(r.id, r.url, r.title) for r in out.orderBy("place").collect()]


def test_each_predicate(spark):
    assert found(spark, {}) == [("a", "https://x.org/1", "T")]
    bad = [
        {"language": "de"}, {"language": None}, {"title": "  "}, {"title": None}, {"id": None}, {"url": "ftp://x.org"}, {"url": None}, {"url": "x.org/1"},
        {"published_at": NOW - dt.timedelta(days=7, seconds=1)}, {"published_at": NOW + dt.timedelta(seconds=1)}, {"published_at": None}, {"entities": []}, {"entities": None}, {"entities": [("S2", "us", "X")]}, {"entities": [(None, "us", "X")]},
    ]
    assert found(spark, *[{"position": i, "id": f"b{i}", **b} if "id" not in b else b for i, b in enumerate(bad)]) == []
    edge = [{"position": 2, "id": "c", "url": "https://x.org/2", "published_at": NOW}, {"position": 3, "id": "d", "url": "https://x.org/3", "published_at": NOW - dt.timedelta(days=7)}]
    assert [i for i, *_ in found(spark, *edge)] == ["c", "d"]


def test_entities(spark):
    both = {"entities": [("s1", "DE", "Y"), ("S2", "us", "X"), ("S1", "US", "Y")]}
    assert found(spark, both, listing=("S1", None, None)) and found(spark, both, listing=("S1", "us", None)) and found(spark, both, listing=("S1", "de", "Y"))
    # country and exchange must be of one entity with the symbol
    assert not found(spark, both, listing=("S1", "us", "X")) and not found(spark, both, listing=("S1", "fr", None))
    assert not found(spark, {"entities": [("S1", None, None)]}, listing=("S1", "us", None))


def test_identity(spark):
    items = [{"position": 1, "id": "a", "url": "https://x.org/1?utm_source=m"}, {"position": 2, "id": "b", "url": "HTTPS://X.org/1#top"}, {"position": 3, "id": "a", "url": "https://x.org/2"}, {"position": 4, "id": "b", "url": "https://x.org/4"}]
    assert found(spark, *items) == [("a", "https://x.org/1", "T"), ("b", "https://x.org/4", "T")]
    assert len(found(spark, *items, most=1)) == 1 and found(spark, {"id": None}) == []
