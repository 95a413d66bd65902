"""Codec, indexes, relations, writes, revisions, properties, tiles, streaming."""

import json
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keytable.functions import codec, geojson, props, spatial
from keytable.functions.codec import Padding
from keytable.model import Collection, Entity, schema_of
from keytable.operators import index as ix
from keytable.operators import relation, revision, spatial_index, write
from keytable.plans.predicate import m
from keytable.plans.query import Query
from keytable.sources.context import Context
from keytable.streaming import upsert

ROWS = [("a", 1, "x"), ("a__b", 22, None), ("", 333, "z"), (None, None, "w"), ("längér", -4, "")]


def keyed(padding=None):
    return Entity("t", schema_of("s string, n int, v string")).with_keys(["n", "s"], ["v"], padding)


def test_keys_round_trip(spark):
    rows = spark.createDataFrame(ROWS, "s string, n int, v string")
    e = keyed()
    stored = e.encode(rows, drop_members=True)
    assert stored.columns == ["PartitionKey", "RowKey"]
    assert sorted(r[0] for r in stored.collect()) == sorted(["1__a", "22__a__b", "333__", "__", "-4__längér"])
    back = sorted(map(tuple, e.decode(stored).select("s", "n", "v").collect()), key=str)
    assert back == sorted([(s or None, n, v or None) for s, n, v in ROWS], key=str)  # empty text decodes to null


def test_padding_keeps_long_values_and_decodes(spark):
    rows = spark.createDataFrame(ROWS[:1] + [("abcdefghij", 123456789, "q")], "s string, n int, v string")
    e = Entity("t", rows.schema).with_keys(["n", "v"], ["s"], {"n": Padding(5), "s": Padding(4, "right"), "v": Padding(3)})
    found = sorted(map(tuple, e.encode(rows).select("PartitionKey", "RowKey").collect()))
    assert found == [("123456789____q", "abcdefghij"), ("____1____x", "a___")]
    assert e.part_text("PartitionKey", e.partition[0], 1) == "____1"


def test_base64_has_no_line_breaks(spark):
    long = "å" * 100
    row = spark.createDataFrame([(long,)], "s string").select(codec.base64_text(F.col("s")).alias("b"))
    back = row.select("b", codec.unbase64_text(F.col("b")).alias("s")).first()
    assert "\n" not in back["b"] and "\r" not in back["b"] and back["s"] == long


def test_undecodable_parts():
    with pytest.raises(TypeError):
        codec.parse_part(F.lit("1.5"), T.DoubleType())


def test_null_partition_key_fails(spark):
    e = Entity("t", schema_of("s string, n int")).with_keys(["s"])
    bad = e.assert_partition(spark.createDataFrame([(None, 1)], "s string, n int"))
    with pytest.raises(Exception, match="PartitionKey is null"):
        bad.collect()


def base(spark):
    return spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0), (3, None, 30.0)], "k long, s string, v double")


def test_write_modes(spark):
    new = spark.createDataFrame([(2, None, 21.0), (4, "d", None)], "k long, s string, v double")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(write.merge(base(spark), new, ["k"])) == [(1, "a", 10.0), (2, "b", 21.0), (3, None, 30.0), (4, "d", None)]
    assert got(write.merge(base(spark), new, ["k"], set_null=["s"]))[1] == (2, None, 21.0)
    assert got(write.replace(base(spark), new, ["k"]))[1] == (2, None, 21.0)
    assert got(write.update(base(spark), new, ["k"])) == [(1, "a", 10.0), (2, "b", 21.0), (3, None, 30.0)]
    assert len(got(write.insert(base(spark), new, ["k"], on_conflict="ignore"))) == 4
    with pytest.raises(Exception, match="key exists"):
        write.insert(base(spark), new, ["k"]).collect()
    with pytest.raises(Exception, match="key exists"):
        write.apply(base(spark), write.changes(new, write.ADD), ["k"]).collect()
    assert got(write.delete(base(spark), new, ["k"])) == [(1, "a", 10.0), (3, None, 30.0)]


def test_the_last_change_of_a_key_counts(spark):
    one = write.changes(spark.createDataFrame([(1, "x", 1.0)], "k long, s string, v double"), write.REPLACE, F.lit(2))
    two = write.changes(spark.createDataFrame([(1, "y", 2.0)], "k long, s string, v double"), write.REPLACE, F.lit(1))
    gone = write.changes(spark.createDataFrame([(2, "", 0.0)], "k long, s string, v double"), write.DELETE, F.lit(3))
    out = sorted(map(tuple, write.apply(base(spark), one.unionByName(two).unionByName(gone), ["k"]).collect()))
    assert out == [(1, "x", 1.0), (3, None, 30.0)]


def test_merging_twice_changes_nothing_more(spark):
    new = spark.createDataFrame([(2, None, 21.0), (4, "d", None)], "k long, s string, v double")
    once = write.merge(base(spark), new, ["k"])
    assert sorted(map(tuple, write.merge(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))


def test_etags(spark):
    rows = base(spark)
    tags = {r["k"]: r["t"] for r in rows.withColumn("t", write.etag(rows)).collect()}
    good = spark.createDataFrame([(1, "n", 0.0, tags[1]), (2, "n", 0.0, "*")], "k long, s string, v double, ETag string")
    assert write.check_etags(rows, good, ["k"]).count() == 2 and len(write.check_etags(rows, good, ["k"]).collect()) == 2
    with pytest.raises(Exception, match="precondition"):
        write.check_etags(rows, spark.createDataFrame([(1, "n", 0.0, "old")], good.schema), ["k"]).collect()


def test_index_without_row_keys_keeps_the_last_write(spark):
    rows = spark.createDataFrame([(1, "poul", 1), (2, "poul", 2), (3, "naja", 3)], "k long, name string, seq int")
    e = Entity("people", rows.schema).with_keys(["k"]).with_index("name", ["name"]).with_index("full", ["name"], covering=True)
    narrow, full = ix.find_index(e, "name"), ix.find_index(e, "full")
    for index in (narrow, full):
        derived = ix.derive(e, index, rows, order=[F.col("seq")])
        assert [r["k"] for r in ix.lookup(e, index, derived, rows, ["poul"]).collect()] == [2]
        assert ix.lookup(e, index, derived, rows, ["none"]).count() == 0
    with pytest.raises(ValueError):
        ix.probe(e, narrow, ["a", "b"])
    with pytest.raises(ValueError):
        e.with_index("name", ["name"])


def test_distinct_by(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, ix.distinct_by(rows, ["k"], [F.col("v")]).collect())) == [(1, "a"), (2, "c")]
    assert ix.distinct_by(rows, ["k"]).count() == 2


def test_custom_encoding_and_separator(spark):
    e = Entity("t", schema_of("a string, b string")).with_keys(["a", "b"]).with_separator("|").with_encoding("b", lambda s: s[::-1], F.reverse, F.reverse)
    rows = spark.createDataFrame([("x", "abc"), ("y|z", None)], "a string, b string")
    stored = e.encode(rows)
    assert sorted(r["PartitionKey"] for r in stored.collect()) == ["x|cba", "y|z|"]
    assert e.decode(e.encode(rows.where("a = 'x'"), drop_members=True)).first().asDict() == {"a": "x", "b": "abc"}
    assert e.part_text("PartitionKey", e.partition[1], "abc") == "cba"


def test_revisions_are_not_indexed(spark):
    rows = spark.createDataFrame([(1, "a", False), (2, "a", True)], "k long, name string, is_revision boolean")
    e = Entity("t", rows.schema).with_keys(["k"]).with_index("name", ["name"])
    assert [r["RefPartitionKey"] for r in ix.derive(e, e.indexes[0], rows).collect()] == ["1"]


def test_collections(spark):
    families = spark.createDataFrame([("Sorensen",), ("Suikkanen",), ("Empty",)], "FamilyName string")
    people = spark.createDataFrame([("Sorensen", "Poul"), ("Sorensen", "Torben"), ("Suikkanen", "Naja"), ("Suikkanen", "Kim")], "FamilyName string, FirstName string")
    c = Collection("People", "person", (("FamilyName", "FamilyName"),))
    assert sorted(r["FirstName"] for r in relation.children_of(people, c, {"FamilyName": "Sorensen"}).collect()) == ["Poul", "Torben"]
    assert relation.join_children(families, people, c).count() == 4
    nested = {r["FamilyName"]: [p["FirstName"] for p in r["People"]] for r in relation.nest_children(families, people, c).collect()}
    assert nested == {"Sorensen": ["Poul", "Torben"], "Suikkanen": ["Kim", "Naja"], "Empty": []}
    assert {r["FamilyName"]: r["n"] for r in relation.count_children(families, people, c, "n").collect()} == {"Sorensen": 2, "Suikkanen": 2, "Empty": 0}


def test_revision_history(spark):
    heads = spark.createDataFrame([(1, "a", 1, b"x"), (2, "b", 2, b"y"), (9, "g", 9, b"z")], "k int, s string, n int, raw binary")
    changed = spark.createDataFrame([(1, "a", 5, b"x"), (2, "b", 2, b"y"), (3, "c", None, b"q")], heads.schema)
    after, log = revision.save_with_history(heads, changed, ["k"], deleted=heads.where("k = 9"))
    rows = {r["k"]: r for r in log.collect()}
    assert set(rows) == {1, 3, 9}  # no change, no revision
    assert rows[1]["changed"] == "n" and rows[1]["s"] is None and rows[1]["n"] == 5
    assert rows[3]["changed"] == "s,raw" and rows[9]["deleted"]
    assert sorted(r["k"] for r in after.collect()) == [1, 2, 3]
    vetoed = revision.diff_changes(heads, changed, ["k"], veto=F.col("k") != 1)
    assert [r["k"] for r in vetoed.collect()] == [3]
    key = spark.createDataFrame([("HEAD__7",)], "p string").select(revision.revision_key(F.col("p"))).first()[0]
    assert key == "REV__7"


def test_properties(spark):
    rows = spark.createDataFrame([(1, {"a": "1", "b": None}, '{"x":1}'), (2, None, "bad")], "k int, tags map<string,string>, j string")
    wide = props.map_to_columns(rows, "tags", ["a", "b"])
    assert wide.columns == ["k", "j", "tags__a", "tags__b"]
    assert [r["tags"] for r in props.columns_to_map(wide, "tags").orderBy("k").collect()] == [{"a": "1"}, {}]
    assert [r[0] for r in rows.orderBy("k").select(props.parse_json(F.col("j"), "x int")["x"]).collect()] == [1, None]
    more = props.add_properties(rows.select("k", F.col("tags").alias("extra")), F.create_map(F.lit("a"), F.lit("9"), F.lit("k"), F.lit("no")))
    assert more.orderBy("k").first()["extra"] == {"b": None, "a": "9"}
    assert rows.select(props.reduce_size(F.col("j"), lambda c: F.lit("short"), 4)).first()[0] == "short"
    uris = spark.createDataFrame([("HTTP://Host.example/A?b=C",), ("nothing",)], "u string").select(props.absolute_uri(F.col("u")))
    assert [r[0] for r in uris.collect()] == ["http://host.example/A?b=C", None]


def test_enums_and_defaults(spark):
    rows = spark.createDataFrame([(0, "x"), (1, "d")], "color int, s string")
    e = Entity("t", rows.schema).with_enum("color", {"red": 0, "blue": 1}).with_defaults({"s": "d"})
    assert [r[0] for r in rows.select(e.enum_names("color")).collect()] == ["red", "blue"]
    assert [r["s"] for r in e.drop_defaults(rows).collect()] == ["x", None]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-180, 180), st.floats(-85, 85), st.integers(1, 23)), min_size=1, max_size=20))
def test_quadkeys_invert(spark, places):
    df = spark.createDataFrame(places, "lon double, lat double, z int")
    tiles = df.select("lon", "lat", "z", spatial.tile_of_pixel(spatial.pixel_x(F.col("lon"), F.col("z"))).alias("x"), spatial.tile_of_pixel(spatial.pixel_y(F.col("lat"), F.col("z"))).alias("y"))
    keys = tiles.withColumn("q", spatial.quadkey(F.col("x"), F.col("y"), F.col("z")))
    for r in keys.select("*", spatial.tile_x(F.col("q")).alias("x2"), spatial.tile_y(F.col("q")).alias("y2")).collect():
        assert (r["x"], r["y"]) == (r["x2"], r["y2"]) == spatial_index.tile_of(r["lon"], r["lat"], r["z"])
        assert r["q"] == spatial_index.key_of_tile(r["x"], r["y"], r["z"]) and len(r["q"]) == r["z"]


def test_bad_quadkey_fails(spark):
    with pytest.raises(Exception, match="not a quadkey"):
        spark.createDataFrame([("0124",)], "q string").select(spatial.tile_x(F.col("q"))).collect()


def test_all_tiles_down_to_level_four(spark):
    tiles = [(x, y, z) for z in range(5) for x in range(1 << z) for y in range(1 << z)]
    keys = spark.createDataFrame(tiles, "x int, y int, z int").select(spatial.padded_quadkey(spatial.quadkey(F.col("x"), F.col("y"), F.col("z")), 10).alias("q"))
    assert keys.distinct().count() == 341 and all(len(r["q"]) == 10 for r in keys.collect())


def ring(minx, miny, maxx, maxy):
    return [[minx, miny], [maxx, miny], [maxx, maxy], [minx, maxy], [minx, miny]]


def polygon(*box):
    return json.dumps({"type": "Polygon", "coordinates": [ring(*box)]})


def test_geometry_intersections():
    read = geojson.read
    a, b, c = read(polygon(0, 0, 4, 4)), read(polygon(3, 3, 6, 6)), read(polygon(5, 5, 6, 6))
    assert geojson.intersects(a, b) and not geojson.intersects(a, c)
    assert geojson.intersects(a, read(polygon(1, 1, 2, 2))) and geojson.intersects(read(polygon(1, 1, 2, 2)), a)
    hole = read(json.dumps({"type": "Polygon", "coordinates": [ring(0, 0, 9, 9), ring(2, 2, 7, 7)]}))
    assert not geojson.intersects(hole, read('{"type":"Point","coordinates":[5,5]}')) and geojson.intersects(hole, read('{"type":"Point","coordinates":[1,1]}'))
    line = read('{"type":"LineString","coordinates":[[-1,2],[10,2]]}')
    assert geojson.intersects(line, a) and not geojson.intersects(line, c)
    both = read('{"type":"geometrycollection","geometries":[{"type":"Point","coordinates":[50,50,1,2]},{"type":"MultiPoint","coordinates":[[1,1]]}]}')
    assert geojson.intersects(both, a)
    assert geojson.read("{}") is None and geojson.read("x") is None and geojson.read(None) is None
    assert geojson.read('{"type":"Point","coordinates":[1]}') is None and geojson.read('{"type":"Polygon","coordinates":[]}') is None
    feature = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": json.loads(polygon(0, 0, 1, 1))}]})
    assert geojson.read(feature) == read(polygon(0, 0, 1, 1))
    assert geojson.read(geojson.write(a)) == a and geojson.read(geojson.write(both)) == both and geojson.read(geojson.write(a + b)) == a + b


def test_spatial_search_equals_brute_force(spark):
    boxes = [(i, (i * 37 % 340) - 170.0, (i * 53 % 150) - 75.0) for i in range(200)] + [(900, -179.0, -80.0)]
    size = lambda i: 330.0 if i == 900 else (i % 7) * 1.5 + 0.25
    rows = [(i, polygon(x, y, min(x + size(i), 180), min(y + size(i), 85))) for i, x, y in boxes]
    df = spark.createDataFrame(rows, "id int, shape string")
    index = spatial_index.derive(df, geojson.extent_column(F.col("shape")))
    query = '{"type":"Polygon","coordinates":[[[-20,-10],[60,0],[30,55],[-20,-10]]]}'
    wanted = geojson.read(query)
    expected = sorted(i for i, s in rows if geojson.intersects(geojson.read(s), wanted))
    assert sorted(r["id"] for r in spatial_index.search(index, ["id"], query, "shape").collect()) == expected and 900 in expected
    split = spatial_index.split_keys(F.col("__extent"), lambda key, extent: len(key) < 3)
    cut = spatial_index.derive(df, geojson.extent_column(F.col("shape")), keys=split)
    assert cut.count() > len(rows)
    assert sorted(r["id"] for r in spatial_index.search(cut, ["id"], query, "shape").collect()) == expected


def test_stored_spatial_index(spark, tmp_path):
    e = Entity("areas", schema_of("id long, shape string")).with_keys(["id"])
    c = Context(spark, f"file://{tmp_path}", [e])
    rows = [(i, polygon(i - 90.0, i / 3.0, i - 88.0, i / 3.0 + 1)) for i in range(120)]
    c.register("areas", spark.createDataFrame(rows, e.schema))
    assert c.write_spatial_index("areas", "shape") == "areasSpatialIndex"
    query = polygon(-40.0, 10.0, -20.0, 30.0)
    expected = sorted(i for i, s in rows if geojson.intersects(geojson.read(s), geojson.read(query)))
    found = c.spatial_search("areas", query, "shape")
    assert sorted(r["id"] for r in found.collect()) == expected and expected
    assert "StringStartsWith(tile" in found._jdf.queryExecution().toString()


def test_points_and_world(spark):
    box = lambda *e: spark.createDataFrame([e], "a double, b double, c double, d double").select(spatial.extent_quadkey(*map(F.col, "abcd"))).first()[0]
    assert len(box(10.0, 50.0, 10.0, 50.0)) == 23 and box(-170.0, -80.0, 170.0, 80.0) == ""


def test_context_saves_and_derives_indexes(spark, tmp_path):
    e = Entity("people", schema_of("k long, name string, age int")).with_keys(["k"]).with_index("name", ["name"]).with_index("full", ["name"], covering=True, table="peopleFull")
    c = Context(spark, f"file://{tmp_path}", [e])
    assert c.create_tables() == ["people", "peopleIndex", "peopleFull"] and c.create_tables() == []
    c.add("people", spark.createDataFrame([(1, "a", 5), (2, "b", 6)], e.schema))
    assert c.save() == {"people": ["people", "peopleIndex", "peopleFull"]} and not c.pending
    c.update("people", spark.createDataFrame([(2, "z", None), (7, "no", 1)], e.schema)).delete("people", spark.createDataFrame([(1, None, None)], e.schema))
    c.save()
    assert [tuple(r) for r in c.table("people").collect()] == [(2, "z", 6)]
    assert [tuple(r) for r in c.find_by_index("people", name="z").collect()] == [(2, "z", 6)] and c.find_by_index("people", name="b").count() == 0
    with pytest.raises(KeyError):
        c.find_by_index("people", age=6)
    assert c.query("people").find([2]).count() == 1
    c.add_with_keys("people", spark.createDataFrame([("new", 3)], "name string, age int"), "11").delete_by_key("people", "2")
    c.save()
    assert [tuple(r) for r in c.table("people").select("k", "name", "age").collect()] == [(11, "new", 3)]
    assert [tuple(x) for x in c.query("people").to_objects(lambda k, name, age: (name, age))] == [("new", 3)]
    c.recreate_tables()
    assert c.table("people").count() == 0


def test_updates_cascade_to_collections(spark, tmp_path):
    parent = Entity("parent", schema_of("k long, v string")).with_keys(["k"]).with_collection("items", "child", {"k": "k"})
    child = Entity("child", schema_of("k long, i long, w string")).with_keys(["k"], ["i"])
    c = Context(spark, f"file://{tmp_path}", [parent, child])
    c.create_tables()
    c.add("parent", spark.createDataFrame([(1, "a")], parent.schema))
    c.save()
    c.update("parent", spark.createDataFrame([(1, "b")], parent.schema), {"items": spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], child.schema)})
    assert set(c.save()) == {"parent", "child"}
    assert [tuple(r) for r in c.table("parent").collect()] == [(1, "b")]
    assert sorted(r["w"] for r in c.collection("parent", "items", {"k": 1}).collect()) == ["x", "y"] and c.collection("parent", "items").count() == 2


def test_streamed_upserts(spark, tmp_path):
    from keytable.streaming import upsert as stream

    schema = "k long, seq long, v string"
    source, out, log = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/log"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], schema).write.parquet(f"{source}/0")
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    stream.run_available(stream.upsert(read(), out, ["k"], order="seq", history=log), f"{tmp_path}/cp")
    assert sorted(tuple(r) for r in stream.latest(spark, out).select("k", "v").collect()) == [(1, "b"), (2, "c")]
    spark.createDataFrame([(2, 5, "d"), (3, 1, "e")], schema).write.parquet(f"{source}/1")
    stream.run_available(stream.upsert(read(), out, ["k"], order="seq", history=log), f"{tmp_path}/cp")
    assert sorted(tuple(r) for r in stream.latest(spark, out).select("k", "v").collect()) == [(1, "b"), (2, "d"), (3, "e")]
    assert sorted(r["k"] for r in stream.latest(spark, log).collect()) == [2, 3]


def test_polygon_intersects_keeps_flat_boxes(spark):
    """All boxes against the triangle by brute force, those without width or height too."""
    from keytable import queries as catalogue

    sf = "/root/testdata/sf0.1"
    triangle = geojson.read('{"type":"Polygon","coordinates":[[[5,45],[20,45],[12,58],[5,45]]]}')
    rows = catalogue._boxes(spark, sf).collect()
    box = lambda r: [("polygon", [[(r.minx, r.miny), (r.maxx, r.miny), (r.maxx, r.maxy), (r.minx, r.maxy), (r.minx, r.miny)]])]
    expected = {r.c_custkey: r.maxx == r.minx or r.maxy == r.miny for r in rows if geojson.intersects(box(r), triangle)}
    got = sorted(r["c_custkey"] for r in catalogue.polygon_intersects(spark, sf).collect())
    assert got == sorted(expected) and any(expected.values())


def test_separators_inside_values(spark):
    rows = spark.createDataFrame([("a", "b__c", 1), ("a__b", "c", 2), ("a", "b", 3), ("x__Fy", "O", 4), ("x", "Fz", 5), ("a_", "_b", 6), ("a", None, 7)], "p string, q string, n int")
    e = Entity("t", rows.schema).with_keys(["p", "q"])
    ask = lambda q: sorted(r["n"] for r in q.df().collect())
    query = lambda: Query(e, lambda _: rows)
    assert ask(query().where(m("PartitionKey") == "a__b__c")) == [1, 2] and ask(query().where(m("PartitionKey") == "a__b")) == [3]
    assert ask(query().with_prefix("x__F")) == [4, 5] and ask(query().with_prefix("a__")) == [1, 2, 3, 6, 7] and ask(query().with_prefix("a_")) == [1, 2, 3, 6, 7]
    assert ask(query().with_prefix("a__b__")) == [1, 2] and ask(query().where(m("PartitionKey") == "a____b")) == [6]
    for key in {r[0] for r in e.encode(rows).select("PartitionKey").collect()}:
        for n in range(1, len(key) + 1):
            plain_ = sorted(r["n"] for r in rows.where(e.key_column("PartitionKey").startswith(key[:n])).collect())
            if n % 2 == 0:
                assert ask(query().with_prefix(key[:n])) == plain_, key[:n]


def test_duplicates_and_null_keys(spark):
    old = spark.createDataFrame([(1, None, 1.0), (None, "k", 2.0)], "a int, b string, v double")
    new = spark.createDataFrame([(None, "k", 3.0), (7, "n", 4.0), (7, "n", 4.0)], "a int, b string, v double")
    got = lambda df: sorted(map(tuple, df.collect()), key=str)
    expected = [(1, None, 1.0), (7, "n", 4.0), (None, "k", 3.0)]
    assert got(write.merge(old, new, ["a", "b"])) == got(write.replace(old, new, ["a", "b"])) == expected
    assert got(write.apply(old, write.changes(new, write.MERGE), ["a", "b"])) == expected
    assert got(write.delete(old, new, ["a", "b"])) == [(1, None, 1.0)]
    assert got(write.insert(old, new, ["a", "b"], on_conflict="ignore")) == [(1, None, 1.0), (7, "n", 4.0), (None, "k", 2.0)]
    with pytest.raises(Exception, match="key exists"):
        write.insert(old, new.where("a = 7"), ["a", "b"]).collect()
    e = Entity("t", old.schema).with_keys(["a", "b"])
    assert e.assert_partition(old).count() == 2
    with pytest.raises(Exception, match="PartitionKey is null"):
        e.assert_partition(spark.createDataFrame([(None, None, 1.0)], old.schema)).collect()


def test_saves_survive_being_cut_off(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    good, bad = Entity("good", rows.schema).with_keys(["k"]).with_table("stored", "Ix").with_index("s", ["s"]), Entity("bad", rows.schema).with_keys(["k"])
    ctx = Context(spark, f"file://{tmp_path}", [bad, good])
    ctx.create_tables()
    ctx.add("bad", spark.createDataFrame([(None, "x")], rows.schema)).add("good", rows)
    with pytest.raises(Exception, match="PartitionKey is null"):
        ctx.save()
    assert list(ctx.pending) == ["good"] and ctx.save() == {"good": ["good", "storedIx"]} and (tmp_path / "stored.parquet").exists()
    (tmp_path / "stored.parquet").rename(tmp_path / "stored.parquet.old")  # between the two renames
    again = Context(spark, f"file://{tmp_path}", [good])
    assert again.exists("good") and again.table("good").count() == 2
    assert [r["k"] for r in again.find_by_index("good", s="b").collect()] == [2]


def test_a_declared_spatial_index_is_kept(spark, tmp_path):
    point = lambda x, y: f'{{"type":"Point","coordinates":[{x},{y}]}}'
    e = Entity("places", schema_of("k long, g string")).with_keys(["k"]).with_spatial_index("g")
    ctx = Context(spark, f"file://{tmp_path}", [e])
    ctx.create_tables()
    ctx.add("places", spark.createDataFrame([(1, point(10, 50)), (2, point(-70, 5))], e.schema)).save()
    area = '{"type":"Polygon","coordinates":[[[5,45],[20,45],[20,58],[5,58],[5,45]]]}'
    assert [r["k"] for r in ctx.spatial_search("places", area, "g").collect()] == [1]
    ctx.update("places", spark.createDataFrame([(2, point(11, 51))], e.schema)).save()
    assert sorted(r["k"] for r in ctx.spatial_search("places", area, "g").collect()) == [1, 2]


def test_late_rows_of_a_stream(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k long, seq long, v string")
    for part, batch in enumerate((rows((1, 9, "new"), (2, 1, "a")), rows((1, 2, "late"), (2, 3, "b"), (3, 0, "c")))):
        batch.coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
        stream = spark.readStream.schema(batch.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        upsert.run_available(upsert.upsert(stream, f"{tmp_path}/out", ["k"], order="seq"), f"{tmp_path}/state")
    assert sorted(map(tuple, upsert.latest(spark, f"{tmp_path}/out").collect())) == [(1, 9, "new"), (2, 3, "b"), (3, 0, "c")]


# --- joins of extents --------------------------------------------------------------


def pairs_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_spatial_join_across_tile_borders(spark, tmp_path):
    """Extents whose tiles do not hold one another, since pixels are rounded at each level;
    equal rows, null keys and negative ones."""
    import duckdb

    from keytable import queries as catalogue

    keys = [8560, 44460, 8720, 80520, 8880, 34165, 70065, 13704, 25951, 44460, None, None, 5, -5, *range(-60000, 60000, 331)]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").selectExpr("c_custkey", "'' as c_name", "0 as c_nationkey", "0D as c_acctbal", "'' as c_mktsegment").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    expected = sorted(con.execute(catalogue.SQL["spatial_join"]).fetchall())
    assert {(8560, 44460), (8720, 80520), (13704, 25951)} <= set(expected) and len(expected) > len(set(expected))
    assert pairs_of(catalogue.spatial_join(spark, str(tmp_path))) == expected


def test_overlapping_extents_equal_brute_force(spark):
    """Of all sizes, from points to the world and beyond, on cells' borders, and null."""
    rng = random.Random(5)
    boxes = [(-180.0, -90.0, 180.0, 90.0), (-400.0, -200.0, 400.0, 200.0), (170.0, 80.0, 190.0, 95.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0), (-180.0, -90.0, -180.0, -90.0), (180.0, 90.0, 180.0, 90.0), (-180.0, 0.0, 180.0, 0.0)]
    for _ in range(250):
        x, y, size = rng.randrange(-1440, 1440) / 8, rng.randrange(-720, 720) / 8, 2.0 ** rng.randrange(-16, 8)
        boxes.append((x, y, x + size * rng.choice((0, 0.5, 1)), y + size * rng.choice((0, 0.3, 1))))
    rows = [(i, *b) for i, b in enumerate(boxes)] + [(900, None, 0.0, 1.0, 1.0), (901, 0.0, 0.0, None, 1.0)]
    df = spark.createDataFrame(rows, "i int, minx double, miny double, maxx double, maxy double")
    side = lambda n: df.select(F.col("i").alias(n), F.struct("minx", "miny", "maxx", "maxy").alias(f"{n}_box"))
    got = pairs_of(spatial_index.join_overlapping(side("a"), side("b"), F.col("a_box"), F.col("b_box")).select("a", "b"))
    assert got == sorted((i, j) for i, a in enumerate(boxes) for j, b in enumerate(boxes) if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3])


def test_intersecting_geometries_equal_brute_force(spark):
    """Boxes, boxes written otherwise, near-boxes, other shapes and what is no geometry."""
    rng = random.Random(6)
    shape = lambda kind, c: json.dumps({"type": kind, "coordinates": c}, separators=(",", ":"))
    texts = [None, "", '{"type":"Polygon","coordinates":[]}', '{"type":"Other","coordinates":[[1,1],[2,2]]}', '{"type":"Polygon","coordinates":[[[01,1],[4,1],[4,4],[01,4],[01,1]]]}']
    for _ in range(120):
        x, y, w, h = rng.randrange(-40, 40) / 4, rng.randrange(-40, 40) / 4, rng.choice((0, 0.25, 2, 5)), rng.choice((0, 0.5, 3))
        corners = [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
        turned = corners[(k := rng.randrange(4)) :] + corners[:k]
        way = rng.choice(("box", "back", "spaced", "bow", "corner", "hole", "line", "point", "both"))
        closed = turned + turned[:1]
        texts.append({
            "box": shape("Polygon", [closed]), "back": shape("Polygon", [closed[::-1]]), "spaced": json.dumps({"coordinates": [closed], "type": "polygon"}),
            "bow": shape("Polygon", [[corners[i] for i in (0, 1, 3, 2, 0)]]), "corner": shape("Polygon", [[*corners[:2], corners[3], corners[3], corners[0]]]), "hole": shape("Polygon", [closed, ring(x + w / 4, y + h / 4, x + w / 2, y + h / 2)]),
            "line": shape("LineString", corners[::2]), "point": shape("Point", corners[0]), "both": json.dumps({"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": corners[0]}, {"type": "Point", "coordinates": corners[2]}]}),
        }[way])
    texts += texts[-3:]
    read = [geojson.read(t) for t in texts]
    expected = sorted((i, j) for i, a in enumerate(read) for j, b in enumerate(read) if a and b and geojson.intersects(a, b))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, shape string")
    assert 20 < df.where(geojson.is_box(F.col("shape"))).count() < 60
    side = lambda n: df.select(F.col("i").alias(n), F.col("shape").alias(f"{n}_shape"))
    assert pairs_of(spatial_index.join_intersecting(side("a"), side("b"), ("a_shape", "b_shape")).select("a", "b")) == expected


@pytest.mark.parametrize("name", ["geometry_join", "spatial_join"])
def test_pairs_of_extents_are_not_shuffled(spark, small, name):
    """Rows are dealt by cell once; pairs, which are many more, are made where they stay."""
    from keytable import queries as catalogue

    plan = getattr(catalogue, name)(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(a#", plan)
    assert "a_shape" not in "".join(x for x in plan.split("\n") if "Join" in x or "Sort" in x or "ArrowEvalPython" in x)
