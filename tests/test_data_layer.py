import json

import pytest
from pyspark.sql import functions as F

from terrace.errors import DataError, ValidationError
from terrace.operators import jsonops, predicate
from terrace.operators.dataset import Dataset
from terrace.sources import readers, sinks

PEOPLE = [(1, "Ann", 25), (2, "Bob", 40), (3, "Cid", 30), (4, "Alice", 35), (5, "Dan", None)]


@pytest.fixture(scope="module")
def people(spark):
    return Dataset("people", spark.createDataFrame(PEOPLE, "id long, name string, age long"))


def test_filter_select_export_round_trip(spark, people, tmp_path):
    out = people.filter("age > 30").select("name", "age")
    assert sorted(map(tuple, out.df.collect())) == [("Alice", 35), ("Bob", 40)]
    for kind, suffix in (("csv", "csv"), ("parquet", "parquet"), ("json", "ndjson"), ("json", "json")):
        path = str(tmp_path / f"x.{suffix}")
        sinks.export(out, path, kind)
        assert sorted((r["name"], r["age"]) for r in readers.load(spark, path).df.collect()) == [("Alice", 35), ("Bob", 40)]
    with pytest.raises(DataError):
        sinks.export(out, str(tmp_path / "x.xml"), "xml")
    with pytest.raises(DataError):
        readers.load(spark, str(tmp_path / "x.xml"))


def test_csv_options_and_blank_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id;title\nT1;a\nT2;b\n\n\n")
    assert [tuple(r) for r in readers.load(spark, str(tmp_path / "t.csv"), delimiter=";").df.orderBy("id").collect()] == [("T1", "a"), ("T2", "b")]


@pytest.mark.parametrize("bad", ["", "age >", "age > 3 AND", "age ~ 3", "age > 3 XOR id = 1", "nope = 1", 'age ">" 3'])
def test_bad_conditions(people, bad):
    with pytest.raises(DataError):
        people.filter(bad)


def test_conditions(people):
    ids = lambda c: sorted(r["id"] for r in people.filter(c).df.collect())
    assert ids("age = 40") == [2]
    assert ids("age != 40") == [1, 3, 4]  # null matches nothing
    assert ids("age = forty") == []
    assert ids("name = 'Bob' or name == \"Ann\"") == [1, 2]
    assert ids("id = 1 OR id = 2 AND age > 30") == [2]  # from left to right
    assert ids("name >= B") == [2, 3, 5]


def test_pushdown(spark):
    plan = Dataset("o", spark.read.parquet("/root/testdata/sf0.001/orders.parquet")).filter("o_totalprice > 1000 AND o_orderstatus = F").select("o_orderkey").df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull" in plan and "GreaterThan(o_totalprice,1000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_nested(spark):
    rows = [(1, (("Madrid",), "es")), (2, (("Rome",), "it")), (3, None)]
    d = Dataset("u", spark.createDataFrame(rows, "id long, contact struct<address struct<city string>, lang string>"))
    assert [r["id"] for r in d.filter("contact.address.city = Madrid").df.collect()] == [1]
    assert d.select("contact.address.city").df.columns == ["contact.address.city"]
    assert d.flatten_json().df.columns == ["id", "contact.address.city", "contact.lang"]
    assert d.flatten_json("_", "compat").df.columns == ["id", "contact_flattened"]
    with pytest.raises(DataError):
        d.select("contact.nope")


def test_json_paths(spark):
    rows = [(1, [{"price": 5}, {"price": None}]), (2, [{"price": 7}]), (3, [])]
    df = spark.createDataFrame(rows, "id long, items array<struct<price long>>")
    assert sorted(r[0] for r in jsonops.select_jsonpath(df, "$[*].items[*].price").collect()) == ["5", "7", "null"]
    assert sorted(r["id"] for r in jsonops.filter_jsonpath(df, "$.items[0].price").collect()) == [1, 2]
    assert sorted(r["id"] for r in jsonops.filter_jsonpath(df, "$.items[*]").collect()) == [1, 2]
    assert jsonops.filter_jsonpath(df, "$.nothing").count() == 0
    assert [json.loads(r[0]) for r in jsonops.select_jsonpath(df.filter("id = 2"), "$[*]['items'][0]").collect()] == [{"price": 7}]
    for bad in ("items", "$.items[", "$..price"):
        with pytest.raises(DataError):
            jsonops.filter_jsonpath(df, bad)


def test_schema_and_validation(spark):
    df = spark.createDataFrame([(1, "a", 1.5, True, None), (2, None, 2.0, False, None)], "id long, name string, price double, in_stock boolean, gone string")
    schema = jsonops.infer_schema(df)
    assert schema["properties"] == {"id": {"type": "integer"}, "name": {"type": "string"}, "price": {"type": "number"}, "in_stock": {"type": "boolean"}}
    assert schema["required"] == ["id", "price", "in_stock"]
    rules = {"type": "object", "required": ["name", "email"], "properties": {"price": {"maximum": 1.8}, "id": {"type": "string"}}}
    found = {tuple(r) for r in jsonops.validate_incremental(df, rules, "id").collect()}
    assert found == {(1, "email", "is required"), (2, "email", "is required"), (2, "name", "is required"), (2, "price", "is greater than 1.8"), (1, "id", "is not of type string"), (2, "id", "is not of type string")}
    with pytest.raises(ValidationError, match="row 1"):
        Dataset("d", df).validate(rules, "id")
    assert Dataset("d", df).validate({"type": "object", "required": ["id"]}, "id") is None
    lists = spark.createDataFrame([(1, [1, -2])], "id long, a array<long>")
    assert jsonops.validate_incremental(lists, {"properties": {"a": {"items": {"minimum": 0}, "maxItems": 1}}}, "id").count() == 2
    with pytest.raises(DataError):
        jsonops.validate_incremental(df, {"allOf": []}, "id")


def test_files(spark, tmp_path):
    sinks.write_text(str(tmp_path / "a.txt"), "x\\ny")
    assert (tmp_path / "a.txt").read_text() == "x\ny"
    assert [r["content"] for r in readers.read_files(spark, str(tmp_path / "a.txt")).collect()] == ["x\ny"]
    (tmp_path / "v.json").write_text('{"a": [1, 2]}')
    assert readers.load_json_value(spark, str(tmp_path / "v.json")).select(F.variant_get("value", "$.a[1]", "int")).first()[0] == 2
    (tmp_path / "bad.json").write_text("{oops")
    assert readers.load_json_value(spark, str(tmp_path / "bad.json")).select(F.variant_get("value", "$.raw", "string")).first()[0] == "{oops"
    with pytest.raises(Exception, match="(?i)json|malformed"):
        readers.load(spark, str(tmp_path / "bad.json")).df.collect()
    assert sinks.save_binary(b"abc", str(tmp_path / "b.bin")) == 3
    with pytest.raises(DataError):
        sinks.save_binary(b"abc", str(tmp_path / "b.bin"), limit=2)
    assert [e["length"] for e in sinks.save_binary_stream(b"x" * 10, str(tmp_path / "s.bin"), step=4)] == [4, 4, 2]
    out = readers.load_binary_files(spark, str(tmp_path / "b.bin")).first()["output"]
    assert out["files"][0]["name"] == "b.bin" and bytes(out["files"][0]["content"]) == b"abc"
    with pytest.raises(DataError):
        readers.fetch("http://127.0.0.1:9/x", str(tmp_path))


def test_views_of_a_dataset(people):
    text = people.to_string(["id"])
    assert "Rows: 5, Columns: 3" in text and "and" not in text.split("\n")[-1]
    assert [len(b) for b in people.batches(2)] == [2, 2, 1]
    assert json.loads(people.rows_json().filter(F.col("value").contains("Dan")).first()[0]) == {"id": 5, "name": "Dan", "age": None}
    assert [tuple(r) for r in people.transform({"select": ["name"], "take": 2, "order_by": ["name"]}).df.collect()] == [("Alice",), ("Ann",)]
    assert predicate.field_type(people.df.schema, "age").simpleString() == "bigint"
