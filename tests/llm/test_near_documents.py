"""Rows of one id where some have no words."""

from factlake.llm import minhash
from factlake.llm.minhash import near_documents


def test_texts_without_words_share_the_id_of_an_open_document(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", 0)
    text = " ".join(f"w{i}" for i in range(80))
    docs = [(1, text), (2, text + " end"), (2, "?!"), (1, ""), (2, None), (3, "?!")]
    for parts in (1, 6):
        rows = near_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id == 3) == [(3, 3)]
        assert len(rows) == len(docs)
        # links are of the document; rows without words have the id of their own
        assert {(r.doc_id, r.component_id) for r in rows} >= {(1, 1), (2, 1)}
