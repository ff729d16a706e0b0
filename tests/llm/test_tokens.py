import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storelens.llm.bpe import ForcedBoundaryBpe, with_digests, with_ids
from storelens.llm.token_counts import Counter, with_token_counts

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, "  ", " a", "a ", " a  b   ▁c ▁▁ d ", "İ ΣΑΣ <|startoftext|>x <|ENDOFTEXT|> <|endoftext|>", "don't we'll I'M 's",
       "a\u0085b\x1cc\xa0d", "日本語 é ﬁ Ⅳ ½ ²", "\0\x01a", "a" * 5000, "x1y22z" + "é" * 50, "<|", "a\tb\n\n c", "word " * 30_000]
TEXT = st.text(st.sampled_from("\0中@ab 's<|>\t▁é1.,!İßΣ日‍\x85\xa0\x1c"), max_size=40)


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORD), sentencepiece.SentencePieceProcessor(model_file=PIECE)


@pytest.fixture(scope="module")
def own():
    return ForcedBoundaryBpe(WORD, memory=50), Counter(PIECE, 100, 50)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_any_text_as_the_libraries_do(library, own, text):
    want = library[0].encode(text, add_special_tokens=False).ids
    ids, decoded = own[0].encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded == library[0].decode(want, skip_special_tokens=False)
    assert own[1].counts([text]) == [len(library[1].encode(text))]


def test_cuts_are_forced(own):
    bpe = own[0]
    assert any(len(bpe.fragments([*w[:-1], w[-1] + bpe.end])) > 1 for w in ("qzxj", "vqxk", "zzqjv"))
    assert all(len(bpe.fragments(bpe.symbols(t))) == 1 for t in list(bpe.ids)[:5000])


def test_whole_columns(spark, library):
    df = spark.createDataFrame(list(enumerate(ODD)) + [(None, "again"), (None, "again")], "doc_id long, text string").selectExpr("*", "'x' as n_tokens", "1 as _bpe")
    for r in with_digests(df, WORD).collect():
        want = library[0].encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r._bpe == 1
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library[0].decode(want, skip_special_tokens=False).encode()).hexdigest()
    for r in with_ids(df, WORD, decoded="back").collect():
        want = library[0].encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.back == library[0].decode(want, skip_special_tokens=False)
    for r in with_token_counts(df, PIECE, limit=100, batch_bytes=64).collect():
        n = len(library[1].encode(r.text or ""))
        assert (r.n_tokens, r.over_limit) == (n, n > 100)
    assert with_digests(df.limit(0), WORD).count() == with_token_counts(df.limit(0), PIECE).count() == 0


def test_ids_do_not_depend_on_what_came_before(library):
    bpe = ForcedBoundaryBpe(WORD)
    texts = ["中 @", "a \x00@", "\0@ @", "@ 中 \0@", "a \x00@"]
    for order in (texts, texts[::-1], texts[2:] + texts[:2]):
        for text in order:
            assert np.frombuffer(bpe.encode(text)[0], "<u4").tolist() == library[0].encode(text, add_special_tokens=False).ids
