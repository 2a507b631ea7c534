import time

import pytest

from docquarry.api import TextIndex, VectorIndex, read
from docquarry.sources.store import Database
from docquarry.streaming import feed as W

keys = lambda df, c="doc_id": sorted(r[c] for r in df.select(c).collect())


def test_text_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Hello world"), (2, "hello there"), (3, "other")], "doc_id long, text string")
    index = TextIndex.build(docs, str(tmp_path / "tri"))
    assert keys(index.search("HELLO")) == [1, 2] and keys(index.regex("th[eo]re?")) == [2, 3]
    index = index.add(spark.createDataFrame([(4, "hello again")], docs.schema), str(tmp_path / "tri"))
    assert keys(index.search("hello")) == [1, 2, 4]
    assert keys(index.remove(spark.createDataFrame([(1,)], "doc_id long")).search("hello")) == [2, 4]
    assert keys(read(spark, str(tmp_path / "tri")).where("tri = 'wor'")) == [1]


def test_vector_index(spark):
    df = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(8)], "vec_id long, embedding array<float>")
    index, query = VectorIndex(df, 8), [0.0, 1.0, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0]
    for found in (index.exact(query, 2), index.int8(query, 2), index.quantized(query, 2), index.clustered(query, 2, clusters=2, probes=2)):
        assert [r.vec_id for r in found.collect()] == [1, 2]
    assert index.quantized(query, 1, codes_only=True).first().vec_id == 1
    assert index.append(df).memory().first().vectors == 16
    with pytest.raises(ValueError):
        index.append(spark.createDataFrame([(9, [1.0])], df.schema))


def test_expiry_vectors_and_forks(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    c = db.collection("c")
    c.write(spark.createDataFrame([("a", '{"v":[1.0,0.0]}'), ("b", '{"v":[1.0]}')], "key string, value string"), vector=("v", 2))
    assert [r.score for r in c.nearest([1.0, 0.0], 5).collect()] == [1.0]
    assert c.expire(["a", "zzz"], int(time.time() * 1000) - 1) == 1 and keys(c.view(), "key") == ["b"]
    fork = db.fork(str(tmp_path / "fork"))
    fork.insert("c", {"b": "mine", "n": "new"})
    assert sorted(map(tuple, fork.view("c").collect())) == [("b", "mine"), ("n", "new")]
    assert fork.delete("c", ["b", "nothing"]) == 1 and keys(fork.view("c"), "key") == ["n"]
    assert keys(c.view(), "key") == ["b"]


def test_index_follows_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (1, 2):
        spark.createDataFrame([(n, "abcd")], "doc_id long, text string").write.mode("append").parquet(source)
        q = W.refresh_postings(W.read_stream(spark, source, "doc_id long, text string"), out, str(tmp_path / "state"))
        q.awaitTermination()
        assert W.lag(q) >= 0
    assert keys(spark.read.parquet(out).where("tri = 'abc'")) == [1, 2]
