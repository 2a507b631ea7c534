import hashlib
import hmac
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions.diff import diff_lines
from docquarry.operators import search as S
from docquarry.plans.regex import requirements

DOCS = [(1, "Alpha beta\ngamma_1 Beta"), (2, "éclair  BETA"), (3, ""), (4, None), (5, "color colour handleRequest(x)"), (6, "fn handleRequest() {}\nfoo bar")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


ids = lambda df: sorted(r.doc_id for r in df.collect())


def test_search(docs):
    assert ids(S.search(docs, "beta")) == [1, 2]
    assert ids(S.search(docs, "alpha BETA")) == [1]
    assert ids(S.search(docs, "ÉCLAIR")) == []  # only A to Z are folded
    assert ids(S.search(docs, "beta", limit=1)) == [1]
    index = S.postings(docs)
    for q in ("beta", "alpha BETA", "be", "nowhere"):
        assert ids(S.indexed_search(docs, index, q)) == ids(S.search(docs, q))


def test_words(docs):
    index = S.word_index(docs)
    assert [tuple(r) for r in S.word_hits(index, "Beta").collect()] == [(1, 2)]
    assert {r.word for r in index.where("doc_id = 2").collect()} == {"clair", "BETA"}


@pytest.mark.parametrize("pattern", ["colou?r", "foo|beta", "(alpha|fn) [a-z]+", "handle[A-Z]eq", "a.c", "(?:bar)+"])
def test_regex(docs, pattern):
    want = [i for i, t in DOCS if t and re.search(pattern, t, re.I)]
    assert ids(S.regex_search(docs, pattern)) == want
    narrowed = S.regex_candidates(S.postings(docs), pattern)
    assert narrowed is None or set(ids(narrowed)) >= set(want)


def test_requirements():
    assert requirements("foo|barbaz") == [frozenset({"foo", "barbaz"})]
    assert requirements("colou?r") == [frozenset({"colo"})]
    assert requirements("ab") == []


@given(st.text(alphabet="abcde .", max_size=60), st.text(alphabet="abcde .", max_size=30), st.text(alphabet="abcde .", max_size=60))
def test_ngrams_are_found_in_any_text(before, query, after):
    grams = set(T.sparse_ngrams_of(before + query + after))
    assert {g for g in T.sparse_ngrams_of(query) if len(g) < T.LONGEST} <= grams


def test_hashes(spark):
    df = spark.createDataFrame([("alice",), ("é",), ("",)], "s string")
    assert [int(r[0]) for r in df.select(T.fnv1a64(F.col("s"))).collect()] == [T.fnv1a64_int(s) for s in ("alice", "é", "")]
    want = [hmac.new(b"k" * 80, s.encode(), hashlib.sha256).hexdigest() for s in ("alice", "é", "")]
    assert [r[0] for r in df.select(T.hmac_sha256_native(F.col("s"), "k" * 80)).collect()] == want
    assert [r[0] for r in df.select(T.hmac_sha256_hex("k" * 80)("s")).collect()] == want


def test_reduced(spark):
    assert spark.createDataFrame([("Ab_1é!",)], "s string").select(T.reduced(F.col("s"))).first()[0] == "ab_1.."


def test_diff():
    tags = [t for t, _, _ in diff_lines("line1\nline2\nline3\n", "line1\nline2_modified\nline3\nline4\n")]
    assert {"same", "added", "removed"} == set(tags)
    assert {t for t, _, _ in diff_lines("a\nb", "a\nb")} == {"same"}


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_diff_gives_both_texts_back(a, b):
    rows = diff_lines("\n".join(a), "\n".join(b))
    assert "\n".join(x for t, _, x in rows if t != "removed") == "\n".join(b)
    assert "\n".join(x for t, _, x in rows if t != "added") == "\n".join(a)


def test_context(spark):
    files = spark.createDataFrame([("a.rs", "fn handle_it() {} widget"), ("b.rs", "handle_it()"), ("test_a.rs", "widget")], "path string, text string")
    assert {(r.path, r.role) for r in S.context(files, "widget").collect()} == {("a.rs", "match"), ("test_a.rs", "test"), ("b.rs", "caller")}


def test_postings_of_a_large_batch(spark):
    """Four million trigrams in one batch of texts: Arrow gives a single array of so many strings in chunks."""
    codes = np.random.default_rng(1).integers(0x4E00, 0x9E00, (400, 10_000), np.uint32)
    texts = [c.astype("<u4").tobytes().decode("utf-32-le") for c in codes]
    docs = spark.createDataFrame([*enumerate(texts), (400, None), (401, "ab"), (402, "aBcABCd")], "doc_id long, text string").coalesce(1)
    per_doc = {r.doc_id: (r.n, r.last) for r in S.postings(docs).groupBy("doc_id").agg(F.count("tri").alias("n"), F.max("tri").alias("last")).collect()}
    want = {i: T.trigrams_of(t) for i, t in enumerate([*texts, "", "", "aBcABCd"])}
    assert per_doc == {i: (len(w), w[-1]) for i, w in want.items() if w}


def test_ngrams_go_on_before_all_are_made(docs):
    """No array holds the n-grams of a whole batch of texts; null and short texts have none."""
    assert "MapInArrow" in S.ngram_index(docs)._jdf.queryExecution().executedPlan().toString()
    seen = []
    texts = [None, "ab", *(f"handle_request_{i} " * 3000 for i in range(60))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["t", "doc_id"])
    parts = T.rows_of(lambda t: seen.append(t) or [t[i : i + 5] for i in range(len(t) - 4)], "gram")(iter([batch]))
    first = next(parts)
    assert len(seen) < 10 and first.num_rows <= 2 * T.ROWS
    out = pa.Table.from_batches([first, *parts])
    assert out.num_rows == sum(max(0, len(t or "") - 4) for t in texts)
    assert out["doc_id"].to_pylist() == [i for i, t in enumerate(texts) for _ in range(max(0, len(t or "") - 4))]


@given(st.text(max_size=80))
def test_weights(text):
    assert T._weights(text).tolist() == [T.pair_weight(a, b) for a, b in zip(text, text[1:])]
