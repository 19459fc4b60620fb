"""The catalog's links cover all events."""

from lexloom.catalog import frame

SF = "/root/testdata/sf0.001"


def test_links_have_all_events(spark):
    events = frame(spark, SF, "events")
    assert frame(spark, SF, "links").count() == events.select("user_id", "event_type").distinct().count()
