import brute
import duckdb

import corpus_pipeline
from docquarry.llm import packing, pii, quality


def test_run_against_brute_force(spark, data):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    kept = {r[0] for r in con.execute(quality.ORACLE_SQL).fetchall()}
    docs = [r for r in con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if r[0] in kept]
    docs = brute.without_copies(brute.without_lines(docs))
    model = pii.trained()

    def redacted(text):
        for a, b, k in reversed(model.find(text or "")):
            text = f"{text[:a]}[{k}]{text[b:]}"
        return text

    want = brute.packed([(d, redacted(t)) for d, t in docs])
    got = corpus_pipeline.run(spark, data)
    assert sorted((r.bin, r.doc_id, r.piece, r.n_tokens) for r in got.collect()) == want
    assert {r.bin_group for r in got.collect()} == {0} and packing.GROUP_SIZE > len(docs)


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns, name


def test_odd_rows_through_the_chain(spark, documents, tmp_path):
    text = "these are the words of a document that stays as it is, with nothing in it that another one has"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "a null id " + text), (4, " \n?! \n"), (5, "mail ada@mail7.example.com " + " ".join(f"own{i}" for i in range(9000))), (6, "春が来ると山の雪が解けて川の水が増える"), (7, "春が来ると山の雪が解けて川の水が増える")]
    for name, own in (("full", rows), ("empty", [])):
        folder = str(tmp_path / name)
        documents(own).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        if not own:
            assert got == []
            continue
        texts = {d: "".join(r.text for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.piece)) for d in (1, 5, 6, None)}
        assert texts[1] == text and texts[6] == rows[7][1] and texts[None] == "a null id " + text
        assert texts[5].startswith("mail [EMAIL] own0 ") and texts[5].endswith("own8999")
        assert {r.doc_id for r in got} == {1, 4, 5, 6, None}
