"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from shalecrest.llm import bpe, chat, codec, embeddings, packing, pii, quality, simhash, urls, wrappers

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_embeddings": embeddings.query,
    "op3_simhash": simhash.query,
    "op4_html": wrappers.query,
    "op5_chat": chat.query,
    "op6_tokens": codec.query,
    "op7_quality": quality.query,
    "op8_urls": urls.query,
    "op9_pii": pii.query,
    "op10_packing": packing.query,
}

ORACLE_SQL = {"op2_embeddings": embeddings.SQL, "op5_chat": chat.SQL, "op8_urls": urls.SQL}


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
