"""Registered corpus queries: SQL twins, and brute force where there is none."""

import hashlib

import pytest
from compare import difference, duck_rows, spark_rows

from logweave.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf, name):
    assert difference(spark_rows(QUERIES[name](spark, sf)), duck_rows(con, SQL[name])) is None


def test_tokens_match_the_library(spark, con, sf):
    import public_tokenizers
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for doc_id, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r) for r in QUERIES["op10_sentencepiece"](spark, sf).collect()) == sorted(want)


@pytest.mark.parametrize("name, table", [("op1_pii_surrogates", "documents"), ("op3_compression_toxicity", "documents"),
                                         ("op5_secret_network", "documents"), ("op6_html_layout", "pages")])
def test_one_row_for_each_input(spark, con, sf, name, table):
    assert QUERIES[name](spark, sf).count() == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
