"""The pipeline and the queries with SQL, on the smallest given tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from listwright.llm import line_dedup, near_dedup, packing, substring_dedup, toxicity
from listwright.llm.registry import ORACLES, QUERIES
from tools.check import canonical

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(ORACLES[name])
    assert canonical(df.columns, df.collect()) == canonical([d[0] for d in cur.description], cur.fetchall())


def test_stages(spark):
    """Every stage does what its operator, looked at alone, says of the stage's input."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = given
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        before = {r.doc_id: r for r in docs.collect()}
        after = out.collect()
        if name == "best_fit_packing":
            want = packing.pack(docs).drop("sequence_id", "offset").collect()
            assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in after) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in want)
            break
        assert out.columns == given.columns
        texts = {r.doc_id: r.text for r in after}
        assert len(texts) == len(after) and all(r.n_chars == len(r.text) for r in after)
        if name == "toxicity":
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where(~toxicity.held_out("doc_id", 5, 0))
            scored = toxicity.scores(docs, toxicity.fit(docs, labels)).collect()
            assert texts == {r.doc_id: r.text for r in scored if r.score < 0.5}
        elif name == "line_dedup":
            gone = {}
            for r in line_dedup.line_groups(docs).where("NOT kept").collect():
                gone.setdefault(r.doc_id, set()).add(r.line_no)
            want = {i: "\n".join(t for k, t in enumerate(r.text.split("\n")) if k not in gone.get(i, ())) for i, r in before.items()}
            assert texts == want
        elif name == "minhash_near_dedup":
            assert texts == {r.doc_id: before[r.doc_id].text for r in near_dedup.near_groups(docs).where("kept").collect()}
        else:
            counts = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.kept_words(docs).collect()}
            assert all(len(t.split()) == counts[i][0] - counts[i][1] for i, t in texts.items())
            assert all(texts[i] == before[i].text for i, (_, n) in counts.items() if not n)
        docs = spark.createDataFrame([tuple(r) for r in after], given.schema)
