"""Wide transforms don't run in generated methods that the JVM only interprets."""

import __spark_entry__ as entry

from blotter import session


def test_wide_frames_bound_methods(spark):
    name, limit = session.METHOD_LIMIT
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "65535")
        entry.queries()["s04_row_count"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(name) == limit
        spark.conf.set(name, "4000")
        assert session.compiled_methods(spark).conf.get(name) == "4000"
    finally:
        spark.conf.set(name, before)
