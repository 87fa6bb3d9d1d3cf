from pyspark.sql import functions as F

from kerbline.functions import rules as R
from kerbline.sources import ridefiles


def test_ride_rows_are_split_once_and_read_as_csv(spark):
    text = "a#1\r\nkey,lat,lon,incident,desc,scary\r\n1,52,13,2,\"a, b\",1\r\n2,,,3\n3,52,13,4,plain,0\r\n\n=======\r\na#1\nlat,lon,X,Y,Z,timeStamp,acc\n52.1,13.1,,,,7,2.5\r\n,,,,,8\n\"52.2\",13,0,0,0,9"
    files = spark.createDataFrame([("f", text), ("g", "no header\n1,2"), ("e", "")], "file string, content string")
    parts = ridefiles.sections(files)
    points = ridefiles.points(parts)
    assert sorted(map(tuple, points.select("seq", "lat", "lon", "ts", "gps_accuracy").collect())) == [(0, 52.1, 13.1, 7, 2.5), (1, None, None, 8, None), (2, 52.2, 13.0, 9, None)]
    got = ridefiles.incident_rows(parts).orderBy("seq").select("seq", "lat", "incident", "desc", "scary").collect()
    assert [tuple(r) for r in got] == [(0, "52", "2", "a, b", "1"), (1, None, "3", None, None), (2, "52", "4", "plain", "0")]
    plan = points._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "split(" in x]


def test_times_of_each_pattern(spark):
    texts = ["2024-07-01T10:30:00", "2024-07-01T10:30", "01.07.2024 10:30", "2024-07-01 10:30", "2024-07-01T10:30:00Z", "x", "", None]
    got = [r.ms for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("ms", R.local_text_ms(F.col("t"))).orderBy("i").collect()]
    assert got == [1719822600000] * 3 + [None] * 5


def test_quotes_are_read_as_csv_with_and_without_the_parser(spark):
    rows = ['"a, b",1,"c"', '"",x,""', 'a,"b ,, c",', '"a\\"b",1,2', '"a ""b"" c",1,2', 'a"b,1,c"d', '"open,1,2', '"x","y","z"', 'p,"q\1,r",s', '" lead",2,3']
    text = "key,lat,lon\n" + "\n".join(rows)
    parts = ridefiles.sections(spark.createDataFrame([("f", text)], "file string, content string"))
    got = [tuple(r) for r in ridefiles.table_rows(parts, "above", "key,", ["key", "lat", "lon"]).orderBy("seq").select("key", "lat", "lon").collect()]
    read = spark.createDataFrame(list(enumerate(rows)), "i int, row string").select("i", F.from_csv("row", "a string, b string, c string", {"mode": "PERMISSIVE"}).alias("v")).orderBy("i").select("v.*").collect()
    assert got == [tuple((x.strip(" ") or None) if x else None for x in r) for r in read]


def test_lines_of_ride_files_are_made_after_their_rows_are_gathered(spark, sf_dir):
    from kerbline.plans.catalog import QUERIES

    for name in ("src5_ride_points", "src6_ride_incidents"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "concat_ws" in plan and "concat_ws" not in plan[plan.index("Aggregate [") :]
