import json

import pytest
from pyspark.sql import functions as F

from docquarry.functions.json import Text, embedding, project, violations
from docquarry.operators.aggregates import aggregate, merge_partials
from docquarry.plans.filters import compile_filter, where

ADA = {"name": "Ada", "age": 30, "status": "active", "big": 9007199254740993, "half": 0.5, "nil": None, "ok": True, "user": {"address": {"zip": 97201}}, "tags": [1]}
CASES = [
    ({"name": "Ada"}, True), ({"name": {"$ne": "Bob"}}, True), ({"age": {"$gt": 25}}, True), ({"age": {"$lt": 25}}, False), ({"name": {"$contains": "d"}}, True), ({"name": {"$contains": "D"}}, False),
    ({"$and": [{"age": 30}, {"name": "Ada"}]}, True), ({"$or": [{"age": 1}, {"name": "Ada"}]}, True), ({"$not": {"status": "banned"}}, True), ({"status": {"$in": ["active", "pending"]}}, True),
    ({"name": {"$exists": True}}, True), ({"mail": {"$exists": True}}, False), ({"mail": {"$exists": False}}, True), ({"mail": {"$exists": 5}}, False),
    ({"mail": {"$gt": 5}}, False), ({"mail": {"$ne": 5}}, False), ({"$not": {"mail": {"$gt": 5}}}, True), ({"nil": None}, True), ({"nil": {"$exists": True}}, True), ({"mail": None}, False),
    ({"name": {"$gt": 10}}, False), ({"ok": True}, True), ({"ok": 1}, False), ({"age": "30"}, False), ({"age": 30.0}, True), ({"age": {"$ne": "30"}}, True), ({"big": 9007199254740993}, True), ({"big": 9007199254740992}, False),
    ({"half": {"$gte": 0.5, "$lte": 0.5}}, True), ({"user.address.zip": 97201}, True), ({"user.phone": {"$exists": True}}, False), ({"zip": 97201}, False), ({"tags": [1]}, False), ({"$and": []}, True), ({"$or": []}, False), ({"age": {"$in": []}}, False), ({"age": {"$in": 30}}, False),
    ({"age": 30, "name": "Bob"}, False), ({}, True),
]


def test_operators(spark):
    df = spark.createDataFrame([(json.dumps(ADA),)], "doc string")
    source = Text(df["doc"])
    got = df.select(*(compile_filter(q, source).alias(f"c{i}") for i, (q, _) in enumerate(CASES))).first()
    assert [(q, g) for (q, _), g in zip(CASES, got)] == CASES
    assert [(q, where(df, q, "doc").count() == 1) for q, _ in CASES] == CASES


def test_text_that_is_no_json(spark):
    df = spark.createDataFrame([("not json",), (None,), ('{"a": "x\\"y"}',)], "doc string")
    assert where(df, {"a": 'x"y'}, "doc").count() == 1
    assert where(df, {"a": {"$exists": False}}, "doc").count() == 2


@pytest.mark.parametrize("bad", [{"$nope": 1}, {"a": {"$nope": 1}}, {"$and": 1}, [1]])
def test_bad_filters(spark, bad):
    df = spark.range(1)
    with pytest.raises(ValueError):
        where(df, bad)


def test_typed_columns(spark):
    df = spark.createDataFrame([(1, "x", {"b": 2}), (2, None, {"b": 3})], "id long, s string, a struct<b: int>")
    assert [r.id for r in where(df, {"a.b": {"$gte": 3}, "s": {"$exists": False}}).collect()] == [2]
    assert where(df, {"s": 1}).count() == 0 and where(df, {"zzz": 1}).count() == 0


def test_aggregates(spark):
    docs = spark.createDataFrame([('{"val":10}',), ('{"other":99}',), ('{"val":30}',), ('{"val":"7"}',)], "doc string")
    assert tuple(aggregate(docs, "val", "doc").first()) == (2, 40.0, 20.0, 10.0, 30.0)
    assert tuple(aggregate(docs, "gone", "doc").first()) == (0, 0.0, 0.0, 0.0, 0.0)
    parts = spark.createDataFrame([("ok", 5, 10.5, 1.0, 5.0), ("error", 9, 9.0, 0.0, 99.0), ("ok", 7, 5.0, 2.0, 4.0)], "status string, doc_count long, total double, least double, most double")
    assert tuple(merge_partials(parts).first())[:2] == (12, 15.5)


def test_projection_and_rules(spark):
    df = spark.createDataFrame([('{"s":"hello","i":42,"f":3.25,"b":true,"n":null,"embedding":[1.0, 2.5]}',), ('{"s":1,"i":"x"}',)], "doc string")
    rows = df.select(*project(df["doc"], {"s": "string", "i": "integer", "f": "float", "b": "boolean"})).collect()
    assert tuple(rows[0]) == ("hello", 42, 3.25, True) and tuple(rows[1]) == (None, None, None, None)
    assert [r[0] for r in df.select(embedding(F.col("doc"), 2)).collect()] == [[1.0, 2.5], None]
    rules = [("s", "string", True), ("f", "number", True)]
    assert [r[0] for r in df.select(violations(df["doc"], rules)).collect()] == [None, "f: missing"]
    assert df.select(violations(df["doc"], rules, strict=True)).first()[0].endswith("not declared")
