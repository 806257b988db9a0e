"""Texts go to Python workers in batches of bounded size."""

import public_tokenizers

from foldwise.llm import base, jaccard, packing

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _watched(make, most):
    def made(*args):
        run = make(*args)

        def small(batches):
            for b in batches:
                if b.num_rows > most:
                    raise ValueError(f"{b.num_rows} rows in a batch")
                yield b
        return lambda batches: run(small(batches))
    return made


def _docs(spark):
    return spark.range(0, 5000, 1, 1).selectExpr("id doc_id", "concat('text of document ', id) text")


def test_pack_and_similarity_send_texts_in_small_batches(spark, monkeypatch):
    before = spark.conf.get(NAME)
    monkeypatch.setattr(packing, "_pieces", _watched(packing._pieces, base.TEXT_ROWS))
    for name in ("_scan", "_post"):
        monkeypatch.setattr(jaccard, name, _watched(getattr(jaccard, name), base.TEXT_ROWS))
    docs = _docs(spark)
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert packed.select("doc_id").distinct().count() == 5000
    assert jaccard.similarity_components(docs).count() == 5000
    assert spark.conf.get(NAME) == before
