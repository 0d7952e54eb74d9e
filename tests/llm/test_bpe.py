import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logstrata.llm import bpe

ENCODER = bpe.Encoder(bpe.read_vocabulary(P.path("byte_bpe_50k.tiktoken")))
PUBLIC = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
PUBLIC.encode_special_tokens = True
RANKS = bpe.load_ranks(bpe.read_vocabulary(P.path("byte_bpe_50k.tiktoken")))
TOKENS = {v: k for k, v in RANKS.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab 1'é日\n\t<|endoftext>", max_size=200))
def test_ids_equal_the_public_library_and_decode_again(text):
    ids = ENCODER.encode(text)
    assert ids == PUBLIC.encode(text, add_special_tokens=False).ids
    assert b"".join(TOKENS[i] for i in ids).decode() == text


def test_long_pieces_and_special_strings():
    for text in ("a" * 50_001, "日本語" * 9000, "<|endoftext|>" * 3, " " * 3000 + "x", "!?" * 20_000, "­​"):
        assert ENCODER.encode(text) == PUBLIC.encode(text, add_special_tokens=False).ids
    assert ENCODER.encode("") == ENCODER.encode(None) == []


def test_every_row_gets_its_ids(spark):
    rows = [(1, "hello world", "s"), (2, "", "s"), (3, None, None), (None, "x", "s"), (1, "hello world", "s"), (5, "<|endoftext|>", "t")]
    df = spark.createDataFrame([(*r, [1], 7) for r in rows], "doc_id bigint, text string, source string, ids array<int>, tokens int")
    got = bpe.encode_documents(df).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == sorted(((i, PUBLIC.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows), key=repr)
    assert bpe.encode_documents(df.limit(0)).count() == 0
    assert sorted((r.tokens for r in bpe.token_counts(df).collect())) == sorted(len(PUBLIC.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows)
