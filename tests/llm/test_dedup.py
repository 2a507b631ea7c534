import brute
import numpy as np
import pyarrow as pa
import pytest

from docquarry.llm import common, imatch, linededup, minhash

BASE = "the quick brown fox jumps over the lazy dog while seven other animals look on in some surprise at it all"
OTHER = "completely different words fill this second line so that nothing at all is shared between the two of them here"
LINES = [
    (1, f"{BASE}\n{OTHER}\nshort one"), (2, BASE.replace("fox", "cat")), (3, f"keep this line of words here\n{BASE.upper()}!!"), (4, None), (5, ""), (6, f"{OTHER}\n{OTHER}"), (None, BASE), (7, "a b c d"), (8, "a b c e"), (8, "a b c e"),
    (9, BASE.replace("quick ", "").replace("lazy", "tired")), (10, "x " + OTHER), (11, OTHER + " y z"), (12, "only\n\nshort"), (13, "keep this line of words here"), (14, " ".join(f"w{i}" for i in range(400_000))),
]


def test_tokens():
    texts = ["Hello, WORLD_1 é--x", "", None, "  ", "a" * 3000, "q, " * 1_500_000]
    for punct in (False, True):
        got = {}
        for lo, hi, h, o in common.hash_tokens(pa.array(texts), punct):
            got |= {lo + i: h[o[i] : o[i + 1]].tolist() for i in range(hi - lo)}
        for i, t in enumerate(texts[:5]):
            assert got[i] == [common.token_hash(w) for w in brute.words(t, punct)]
        assert len(got[5]) == 1_500_000 * (1 + punct)


def test_lines_against_all_pairs(spark, documents, data):
    sample = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(80).collect()]
    for rows in (LINES[:-1], sample):
        got = {(r.doc_id, r.line_no) for r in linededup.duplicate_lines(documents(rows)).collect()}
        assert got == brute.gone_lines(rows)
        kept = sorted(((r.doc_id, r.text) for r in linededup.drop_lines(documents(rows)).collect()), key=repr)
        assert kept == sorted(brute.without_lines(rows), key=repr)


def test_lines_keep_columns_and_long_texts(spark, documents):
    out = linededup.drop_lines(documents(LINES))
    assert out.columns == documents(LINES).columns
    long = out.where("doc_id = 14").first()
    assert long.text == LINES[-1][1] and long.n_chars == len(long.text)
    assert linededup.drop_lines(documents([])).count() == 0


def test_rows_that_share_an_id(spark, documents):
    rows = [(1, BASE), (2, f"{BASE}\n{OTHER}"), (2, None), (2, ""), (3, BASE)]
    got = sorted(((r.doc_id, r.text) for r in linededup.drop_lines(documents(rows)).collect()), key=repr)
    assert got == sorted([(1, BASE), (2, OTHER), (2, None), (2, "")], key=repr)


def test_lines_meet_whatever_the_partitions(spark, documents):
    """One inserted, deleted or replaced word, against all pairs, over more partitions than a small table would get."""
    rng, rows = np.random.default_rng(11), []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 20 + i % 15)]
        at = int(rng.integers(0, len(words)))
        near = words[:at] + [["new"], [], ["new", words[at]]][i % 3] + words[at + 1 :]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    want = brute.gone_lines(rows)
    assert len(want) == 60
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert {(r.doc_id, r.line_no) for r in linededup.duplicate_lines(documents(rows)).collect()} == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_crowded_variants(spark, documents):
    """More lines under one variant than are paired off, some of them near copies, in one cell and in several."""
    rng = np.random.default_rng(12)
    head, rows = "these six words begin every line", []
    for i in range(300):
        words = [f"w{x}" for x in rng.integers(0, 4000, 14 + i % 12)]
        rows.append((i, f"{head} {' '.join(words)}"))
        if i % 3 == 0:
            words[int(rng.integers(0, len(words)))] = "new"
            rows.append((1000 + i, f"{head} {' '.join(words)}"))
    rows += [(2000 + i, f"page {i} of the very same old book") for i in range(300)]
    rows += [(3000 + i, f"all of these begin alike number {i % 2150} {'x' if i % 7 else 'y'}") for i in range(2160)]
    want = brute.gone_lines(rows[:-2160]) | brute.gone_lines(rows[-2160:])  # the last ones share too few words with the others
    assert sum(1 for d, _ in want if d < 3000) > 300 and sum(1 for d, _ in want if d >= 3000) > 1000
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert {(r.doc_id, r.line_no) for r in linededup.duplicate_lines(documents(rows)).collect()} == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_earliest_matches_of_a_cell():
    rng = np.random.default_rng(15)
    lines = [rng.integers(0, 3, rng.integers(8, 20)).astype(np.uint32) for _ in range(120)]
    block, offsets = rng.integers(0, 2, 120), np.r_[0, np.cumsum([len(x) for x in lines])]
    for across in (False, True):
        first, far = linededup.earliest(block, np.concatenate(lines), offsets, across)
        for q in range(120):
            want = [(p, d) for p in range(q) if not (across and block[p] == block[q]) and (d := brute.edit_distance(lines[p].tolist(), lines[q].tolist())) <= linededup.bound(min(len(lines[p]), len(lines[q])))]
            assert (first[q], far[q]) == (want[0] if want else (-1, 0))


def test_distances_of_many_pairs():
    rng = np.random.default_rng(16)
    one, two = [], []
    for _ in range(400):
        a = rng.integers(0, 6, rng.integers(8, 40)).astype(np.uint32)
        b = a.tolist()
        for _ in range(int(rng.integers(0, 5))):
            at = int(rng.integers(0, len(b)))
            b[at : at + int(rng.integers(0, 2))] = rng.integers(0, 6, rng.integers(0, 2)).tolist()
        one.append(a), two.append(np.array(b, np.uint32))
    got = linededup.distances(*(pa.array([x.tobytes() for x in side], pa.binary()) for side in (one, two)))
    for x, y, d in zip(one, two, got):
        true, most = brute.edit_distance(x.tolist(), y.tolist()), linededup.bound(min(len(x), len(y)))
        assert d == (true if true <= most else linededup.MAX_EDITS + 1)


CJK = "春が来ると山の雪が解けて川の水が増える"


def test_scripts_without_spaces(spark, documents):
    assert [len(h) for _, _, h, _ in common.hash_tokens(pa.array(["日本語。「引用」 “foo”\u00a0bar…baz 한국어"]), unicode=True)] == [9]
    rows = [(1, CJK), (2, CJK + "。"), (3, "一二三四五六七八九十" + CJK), (4, CJK.replace("川", "谷")), (5, "“quoted”\u00a0words… here"), (6, "quoted words here"), (7, "one “quoted”\u00a0word… here"), (8, "one quoted word here"), (9, "สวัสดีครับผม"), (10, "สวัสดีครับผม")]
    assert {r.doc_id for r in linededup.duplicate_lines(documents(rows)).collect()} == {2, 4, 8, 10}
    assert {r.doc_id for r in linededup.duplicate_lines(documents(rows), min_words=1).collect()} == {2, 4, 6, 8, 10}


def test_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(0, 12)).astype(np.uint32) for _ in range(2))
        assert linededup.distance(a, b, 3) == min(4, brute.edit_distance(a.tolist(), b.tolist()))


NEAR = [(20, BASE), (3, BASE + " now"), (5, OTHER), (6, None), (7, ""), (8, "?!"), (9, BASE), (9, BASE), (30, OTHER + " and"), (None, BASE), (40, "word"), (41, "word"), (42, " ".join(f"w{i}" for i in range(50_000)))]


def test_near_copies_against_all_pairs(spark, documents, data):
    sample = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("n_chars < 1500").limit(60).collect()]
    for rows in (NEAR[:-1], sample):
        got = {r.doc_id: r.kept_doc_id for r in minhash.near_duplicates(documents(rows)).collect()}
        assert got == {d: k for d, k in brute.near_groups(rows).items() if d != k}
        kept = sorted(((r.doc_id, r.text) for r in minhash.drop_near_duplicates(documents(rows)).collect()), key=repr)
        assert kept == sorted(brute.without_copies(rows), key=repr)
    assert minhash.drop_near_duplicates(documents(NEAR)).columns == documents(NEAR).columns
    assert minhash.near_duplicates(documents([])).count() == 0


def test_estimate(spark):
    """Agreement of signatures against the probability Jaccard similarity."""
    rng, errors = np.random.default_rng(5), []
    for _ in range(8):
        shared, own = rng.integers(0, 1 << 49, 150).astype(np.uint64), rng.integers(0, 1 << 49, (2, 60)).astype(np.uint64)
        weights = [dict(zip(np.concatenate([shared, own[i]]).tolist(), rng.integers(1, 5, 210).astype(float).tolist())) for i in (0, 1)]
        union = set(weights[0]) | set(weights[1])
        exact = sum(1 / sum(max(weights[0].get(e, 0) / weights[0][x], weights[1].get(e, 0) / weights[1][x]) for e in union) for x in set(weights[0]) & set(weights[1]))
        sig = [minhash.signatures(np.zeros(len(w), np.int64), np.array(list(w), np.uint64), np.array(list(w.values())), 1)[0] for w in weights]
        errors.append((sig[0] == sig[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.05 and np.abs(errors).max() < 0.2


def exact_similarity(a, b):
    """Probability Jaccard of two texts' weighted bigrams."""
    x, y = (dict(zip(e.tolist(), w.tolist())) for _, e, w in (minhash.elements(h, o) for _, _, h, o in (next(common.hash_tokens(pa.array([t]))) for t in (a, b))))
    union = sorted(set(x) | set(y))
    p, q = (np.array([w.get(e, 0.0) for e in union]) for w in (x, y))
    return sum(1 / np.maximum(p / p[i], q / q[i]).sum() for i in np.flatnonzero((p > 0) & (q > 0)))


def test_recall_against_exact_similarity(spark, documents):
    """Pairs of known similarity: clear copies are all found, clearly different texts never."""
    rng, rows, true = np.random.default_rng(14), [], {}
    for i in range(120):
        words = [f"p{i}x{x}" for x in rng.integers(0, 150, 200)]
        near = [w if rng.random() > 0.25 * (i % 12) / 12 else f"new{j}" for j, w in enumerate(words)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
        true[2 * i + 1] = exact_similarity(rows[-2][1], rows[-1][1])
    got = {r.doc_id: r.kept_doc_id for r in minhash.near_duplicates(documents(rows)).collect()}
    assert all(k == d - 1 for d, k in got.items())
    clear, far = {d for d, s in true.items() if s >= 0.7}, {d for d, s in true.items() if s < 0.4}
    assert len(clear) > 30 and len(far) > 0 and clear <= set(got) and not far & set(got)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 200), (150, 200), (5, 5)], "a long, b long").where("a < b")
    got = {r.doc_id: r.kept_doc_id for r in minhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {150: 100, 200: 100}


def test_components_that_do_not_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError):
        minhash.components(edges, most=2)


def test_rows_that_repeat(spark, documents):
    rows = [(1, "?!"), (1, "?!"), (1, None), (1, None), (2, "some words here"), (2, "some words here"), (None, "?!"), (None, "?!")]
    for more in ([], [(3, BASE), (3, BASE)]):
        kept = sorted(((r.doc_id, r.text) for r in minhash.drop_near_duplicates(documents(rows + more)).collect()), key=repr)
        assert kept == sorted([(1, "?!"), (1, None), (2, "some words here"), (None, "?!"), (None, "?!"), *more[:1]], key=repr)


def test_imatch(spark, documents):
    rows = [(1, "alpha beta gamma delta"), (2, "delta beta alpha GAMMA, alpha"), (3, None), (4, ""), (5, "unique words stand alone"), (None, "alpha"), (5, "unique words stand alone"), (6, "the " * 300_000)]
    out = imatch.fingerprints(documents(rows), idf_min=0.3, idf_max=1.5).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[1].f0 == by[2].f0 and by[1].n_terms == 4 and by[1].f3 == by[2].f3
    assert by[3].n_terms == 0 and by[3].f0 is None and by[6].n_terms == 0
    assert imatch.fingerprints(documents([])).count() == 0
    assert {r.doc_id: r.kept_doc_id for r in imatch.copies(documents(rows), idf_min=0.3, idf_max=1.5).collect()} == {2: 1}


@pytest.mark.parametrize("n", [1, 3])
def test_imatch_counts_every_document(spark, documents, n):
    words = imatch.lexicon(documents([(i, "common " + ("rare" if i < n else "x")) for i in range(10)]), 0.5, 10.0)
    assert np.uint64(common.token_hash("rare")) in words and np.uint64(common.token_hash("common")) not in words
