from pyspark.sql import functions as F

from factloom.functions import geo as G
from factloom.operators.library import latest
from factloom.sources import files, geodata, tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('Ward,Outlay,Share\n"O\'Neil, ""x""", "$1,200" ,5%\n\nB,$30,7%\nC\n')
    got = tables.read_table(spark, str(p))
    assert dict(got.dtypes) == {"Ward": "string", "Outlay": "double", "Share": "string"}
    assert rows(got, "Ward") == [("B", 30.0, "7%"), ("C", None, None), ("O'Neil, \"x\"", 1200.0, "5%")]
    tables.write_csv(spark.createDataFrame([("=1+1", -5), ("ok", 3)], "a string, b int"), str(tmp_path / "out"))
    back = tables.read_table(spark, str(tmp_path / "out"), typed=False)
    assert rows(back, "a") == [("'=1+1", "'-5"), ("ok", "3")]
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert rows(tables.read_table(spark, str(tmp_path / "t.tsv"))) == [(1.0, "x")]


def test_versions_and_hash(spark, tmp_path):
    path = str(tmp_path / "jobs")
    tables.append_versions(spark.createDataFrame([(1, 1, "queued"), (2, 1, "queued")], "id int, v int, s string"), path)
    tables.append_versions(spark.createDataFrame([(1, 2, "done")], "id int, v int, s string"), path)
    assert rows(latest(spark.read.parquet(path), "id", "v").select("id", "s"), "id") == [(1, "done"), (2, "queued")]
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string")
    assert rows(tables.result_hash(df, "k")) == rows(tables.result_hash(df.orderBy(F.desc("x")), "k"))


def test_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.bin").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D49484452000000A000000078"))
    (tmp_path / "f/b.csv").write_text("a,b\n")
    (tmp_path / "f/c.txt").write_text("hello")
    df = files.read_files(spark, str(tmp_path / "f"))
    kind = files.file_kind(F.col("content"), F.col("path"))
    got = {r.path[-5:]: (r.kind, tuple(r.size), r.modality) for r in df.select("path", kind.alias("kind"), files.image_size(F.col("content"), kind).alias("size"), files.modality(kind).alias("modality")).collect()}
    assert got == {"a.bin": ("png", (160, 120), "image"), "b.csv": ("csv", (1920, 1080), "table"), "c.txt": ("UNSUPPORTED_FORMAT", (1920, 1080), None)}


GEOJSON = '{"type":"FeatureCollection","features":[{"type":"Feature","id":7,"properties":{"budget":12.5,"name":"Goa"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0,9],[4,2],[0,0]]]}},{"type":"Feature","properties":null,"geometry":{"type":"Point","coordinates":[111319.490793,0]}}]}'
KML = '<kml><Placemark><name>A</name><description>Cost 1,200 lakh</description><ExtendedData><Data name="ward"><value>9</value></Data></ExtendedData><Point><coordinates>72.5,19.1,0</coordinates></Point></Placemark><Placemark><name>B</name><Polygon><coordinates> 0,0 1,0 1,1 0,0 </coordinates></Polygon></Placemark><Placemark><name>C</name></Placemark></kml>'
GPX = '<gpx><wpt lat="19.1" lon="72.5"><name>P</name><ele>14</ele></wpt><trkpt lon="1" lat="2"/></gpx>'
TOPO = '{"type":"Topology","transform":{"scale":[0.5,0.5],"translate":[10,20]},"arcs":[[[0,0],[2,0],[0,2]],[[0,0],[2,2]]],"objects":{"o":{"type":"GeometryCollection","geometries":[{"type":"Polygon","arcs":[[0,-2]],"properties":{"name":"Z"}},{"type":"Point","coordinates":[0,0]}]}}}'


def test_geodata(spark):
    df = spark.createDataFrame([("g", GEOJSON), ("k", KML), ("p", GPX), ("t", TOPO)], "file_id string, text string")
    got = {(r.file_id, r.seq): r for r in geodata.read_geo(df).collect()}
    assert len(got) == 7
    assert got["g", 0].feature_id == "7" and got["g", 0].props == {"budget": "12.5", "name": "Goa"} and len(got["g", 0].points) == 4
    assert tuple(got["g", 1].points[0]) == (1.0, 0.0) and got["g", 1].feature_id == "feat_2"
    assert got["k", 0].geom_type == "Point" and got["k", 0].props == {"name": "A", "description": "Cost 1,200 lakh", "value": "1200", "ward": "9"}
    assert got["k", 1].geom_type == "Polygon"
    assert got["p", 0].props == {"name": "P", "elevation": "14"} and tuple(got["p", 1].points[0]) == (1.0, 2.0)
    assert [tuple(p) for p in got["t", 0].points] == [(10.0, 20.0), (11.0, 20.0), (11.0, 21.0), (10.0, 20.0)]
    features = geodata.read_geo(df)
    assert rows(geodata.measures(features).filter("file_id = 'g'").select("name", "value")) == [("budget", 12.5)]
    assert {r.name for r in geodata.place_mentions(features).collect()} >= {"Goa", "Z", "9"}
    assert features.select(G.bbox(F.col("points"))).count() == 7


def test_geojson_faults(spark):
    many = '{"type":"FeatureCollection","features":[' + ",".join(['{"type":"Feature"}'] * 60) + "]}"
    df = spark.createDataFrame([("a", '{"type":"InvalidType"}'), ("b", many), ("c", "not json"), ("d", GEOJSON)], "file_id string, text string")
    assert dict(rows(geodata.geojson_faults(df, 50))) == {"a": "INVALID_GEOMETRY", "b": "GEO_FEATURE_LIMIT_EXCEEDED", "c": "INVALID_GEOMETRY", "d": None}
