import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stridewell.llm.bpe import DEFAULT_TOKENIZER, encode, encode_block, merge_table

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return t


def ids(texts):
    values, sizes = encode_block(texts, merge_table(DEFAULT_TOKENIZER))
    out, at = [], 0
    for n in sizes:
        out.append(values[at : at + n].tolist())
        at += n
    return out


def want(public, texts):
    return [public.encode(t or "", add_special_tokens=False).ids for t in texts]


HARD = ["", None, " ", "\n\n\n", "a   b  \n c", "<|endoftext|> hi", "it's we'll I'D don't", "\x1c\x1d!!\x1e a", "a" * 300, "ab" * 300, "\u0085　x ", "tab\t\tend \r\n\r\n x",
        "日本語テキスト 😀😀", "é ½ ² ١٢٣", "  x", "x" * 50_000, " " * 5000 + "x", "\x00\x7f"]


def test_hard_texts(public):
    assert ids(HARD) == want(public, HARD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=8))
def test_any_texts(public, texts):
    assert ids(texts) == want(public, texts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab' \n.1st", max_size=80), max_size=8))
def test_few_letters(public, texts):
    assert ids(texts) == want(public, texts)


def test_rows_and_columns_are_kept(spark, public):
    rows = [(k, t, "clash", k) for k, t in enumerate(HARD)] + [(None, "x", None, None), (0, "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, __n long")
    got = encode(df, block_chars=200)
    assert got.columns == ["doc_id", "__n", "ids"]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got.collect()) == sorted((k is None, k or 0, i) for (k, t, *_), i in zip(rows, want(public, [r[1] for r in rows])))
    counts = encode(df, keep=["doc_id"], ids="n", counts_only=True)
    assert sorted(r.n for r in counts.collect()) == sorted(len(i) for i in want(public, [r[1] for r in rows]))
    assert encode(df.limit(0)).count() == 0
