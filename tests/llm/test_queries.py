from pathlib import Path

import pytest

from stridewell.llm import queries

from ..oracle import FOLDER, compare, connect

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, name):
    compare(spark, connect(), queries.queries()[name], queries.oracle_sql()[name])


def test_ids_of_all_documents(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from stridewell.llm.bpe import DEFAULT_TOKENIZER

    t = tokenizers.Tokenizer.from_file(DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.p8_ids(spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


def test_shares_are_reached(spark):
    for r in queries.p9_shares(spark, FOLDER).collect():
        assert r.most_uses <= r.max_repeats
