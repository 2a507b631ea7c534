import pytest

from docquarry.operators import distribution as D
from docquarry.operators import log as L
from docquarry.operators import registry as R
from docquarry.operators import tenancy as N
from docquarry.sources.store import Database, read_tree
from docquarry.streaming import feed as W

LOG = "key string, value string, op string, epoch long, ts_ms long, expires_at long"


def test_log(spark):
    log = spark.createDataFrame([("u1", "v1", "insert", 1, 10, None), ("u1", "v2", "update", 2, 20, None), ("u2", "x", "insert", 3, 30, 35), ("u1", None, "delete", 4, 40, None), ("u1", "again", "insert", 5, 40, None)], LOG)
    value = lambda df: sorted((r.key, r.value) for r in df.collect())
    assert value(L.as_of_epoch(log, 1)) == [("u1", "v1")] and value(L.as_of_epoch(log, 2)) == [("u1", "v2")]
    assert value(L.as_of_epoch(log, 4)) == [("u2", "x")] and value(L.latest(log)) == [("u1", "again"), ("u2", "x")]
    assert value(L.as_of_time(log, 5)) == [] and value(L.as_of_time(log, 40)) == value(L.latest(log))
    assert value(L.latest(log, now_ms=35)) == [("u1", "again")] and value(L.expired(log, 35)) == [("u2", "x")]
    kept = L.collect_garbage(log, 4)
    for epoch in (4, 5):
        assert value(L.as_of_epoch(kept, epoch)) == value(L.as_of_epoch(log, epoch))
    assert kept.count() == 3
    with pytest.raises(ValueError):
        L.page(log, 1, "XYZ")


def test_collection(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    people = db.collection("people")
    people.insert({"ada": {"age": 30, "city": "Rome"}, "bob": {"age": 20}, "cy": {"age": 25}})
    first = people._last("epoch")
    people.insert({"ada": {"age": 31}})
    assert people.delete(["bob", "nobody"]) == 1
    assert people.count() == 2 and people.get("bob").count() == 0
    assert people.get("ada").first().version == 1 and people.as_of(first).count() == 3
    assert [r.key for r in people.find({"age": {"$gt": 30}}).collect()] == ["ada"]
    assert people.aggregate("age").first()["sum"] == 56.0
    assert [r.key for r in people.search("AGE").orderBy("key").collect()] == ["ada", "cy"]
    people.insert({"bob": {"age": 9}})
    assert people.get("bob").count() == 1
    people.compact(people._last("epoch"))
    assert people.count() == 3
    assert people.release() == 1 and people.release() == 2 and people.releases() == [1, 2]
    other = db.collection("copy")
    people.install(2, other)
    assert other.count() == 3 and db.collections() == ["copy", "people"]
    db.drop("copy")
    assert db.collections() == ["people"]
    with pytest.raises(ValueError):
        db.collection("a/b")


def test_branches(spark, tmp_path):
    c = Database(spark, str(tmp_path / "db")).collection("c")
    c.insert({"a": "1", "b": "2", "d": "4"})
    c.branch("x", "agent")
    with pytest.raises(ValueError):
        c.branch("x")
    c.branch_write("x", {"a": "changed", "n": "new", "d": None})
    assert sorted((r.key, r.value) for r in c.on_branch("x").collect()) == [("a", "changed"), ("b", "2"), ("n", "new")]
    assert [r.key for r in c.search_branch("x", "new").collect()] == ["n"]
    assert c.count() == 3 and c.merge("x").count() == 0
    assert sorted((r.key, r.value) for r in c.view().collect()) == [("a", "changed"), ("b", "2"), ("n", "new")]
    assert c.branches().first().status == "merged"
    c.branch("y")
    c.branch_write("y", {"a": "mine"})
    c.insert({"a": "theirs"})
    assert [r.key for r in c.merge("y").collect()] == ["a"]
    assert c.get("a").first().value == "theirs"
    c.drop_branch("y")
    assert c.branches().count() == 1


def test_loading(spark, tmp_path):
    (tmp_path / "in.ndjson").write_text('{"key":"a","value":"1"}\n{"key":"b","x":2}\n{"x":1}\n\n')
    c = Database(spark, str(tmp_path / "db")).collection("c")
    c.load_ndjson(str(tmp_path / "in.ndjson"))
    assert sorted((r.key, r.value) for r in c.view().collect()) == [("a", "1"), ("b", '{"key":"b","x":2}')]
    (tmp_path / "src/deep").mkdir(parents=True)
    (tmp_path / "src/deep/f.txt").write_text("héllo")
    assert [tuple(r) for r in read_tree(spark, str(tmp_path / "src")).collect()] == [("deep/f.txt", "héllo")]


def test_tenants(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    a, b = db.tenant("a"), db.tenant("b")
    a.collection("users").insert({"u1": "alice"})
    b.collection("users").insert({"u1": "bob"})
    assert a.collection("users").get("u1").first().value == "alice"
    db.set_quota("a", N.Quota(collections=1, bytes=10))
    with pytest.raises(N.QuotaExceeded):
        a.collection("more")
    with pytest.raises(N.QuotaExceeded):
        a.collection("users").insert({"u2": "x" * 20})
    keys = N.Keys()
    keys.require(None, "admin")
    k = keys.add("read")
    keys.require(k, "read")
    with pytest.raises(N.PermissionDenied):
        keys.require(k, "write")


def test_stream_delivers_once(spark, tmp_path):
    path = str(tmp_path / "log")
    row = lambda n: spark.createDataFrame([("t1", "c", f"k{n}", "v", "insert", n)], "tenant string, collection string, key string, value string, op string, epoch long")
    subs = spark.createDataFrame([("s", "t1", ""), ("other", "t2", "")], "subscription string, tenant string, collection string")
    for n in (1, 2):
        row(n).write.mode("append").parquet(path)
        feed = W.changes(W.read_stream(spark, path, row(0).schema))
        W.deliver(feed, subs, "key", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.subscription, r.seq) for r in out] == [("s", 1), ("s", 2)]
    seen = []
    W.in_order(W.changes(W.read_stream(spark, path, row(0).schema)), lambda batch, n: seen.extend(r.seq for r in batch.collect()), str(tmp_path / "state2")).awaitTermination()
    assert seen == [1, 2]


def test_transactions(spark):
    t = spark.createDataFrame([(1, 0, [1, 2]), (1, 1, [2, 3]), (1, 2, [9])], "batch long, seq long, write_set array<long>")
    assert [tuple(r) for r in D.overlapping_writes(t).collect()] == [(1, 0, 1)]
    assert sorted(r.seq for r in D.surviving(t).collect()) == [0, 2]


def test_packages(spark):
    releases = spark.createDataFrame([("a", "1.0.0", "d1", False, {"b": "^1.0.0"}), ("a", "2.0.0", "d2", True, {}), ("b", "1.0.0", "d3", False, {}), ("b", "1.4.0", "d4", False, {"c": "~0.1"}), ("c", "0.1.9", "d5", False, {})], "name string, version string, digest string, yanked boolean, deps map<string,string>")
    assert R.resolve(releases, {"a": ">=1.0.0"}) == {"a": "1.0.0", "b": "1.4.0", "c": "0.1.9"}
    with pytest.raises(ValueError):
        R.resolve(releases, {"a": "^9.0.0"})
    assert '"c"' in R.lockfile(releases, {"c": "0.1.9"}).first().lock
    packages = spark.createDataFrame([("a", "me", "x", False), ("b", "you", "y", True)], "name string, owner string, description string, public boolean")
    grants = spark.createDataFrame([("a", "you", "read"), ("a", "it", "yank")], "name string, holder string, permission string")
    assert {w: R.visible(packages, grants, w).count() for w in ("me", "you", "it")} == {"me": 2, "you": 2, "it": 1}
    assert R.yank(releases, packages, grants, "a", "1.0.0", "it").where("yanked").count() == 2
    assert R.yank(releases, packages, grants, "a", "1.0.0", "you").where("yanked").count() == 1
    assert R.publish(releases, releases.limit(1).withColumn("version", releases["version"])).count() == 0
