import os

import pytest
from helpers import documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from elastiq.llm import tokens
from elastiq.llm.tokens import BLANK

there = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


def reference(vocabulary):
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), *((f"<0x{k:02X}>", 0.0) for k in range(256)), *vocabulary.items()]
    return Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))


def own_count(tokenizer, text):
    return len(tokenizer.encode(BLANK + text.replace(" ", BLANK)).ids) if text else 0


TIES = {BLANK: -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "aba": -3.0, f"{BLANK}a": -2.0, f"{BLANK}{BLANK}": -2.0}
SMALL, SMALL_REFERENCE = tokens.PieceCounter(TIES), reference(TIES)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n", max_size=20))
def test_ties_are_those_of_the_tokenizer(text):
    assert SMALL.count(text) == own_count(SMALL_REFERENCE, text)


def test_pieces_across_a_blank_forbid_cuts_there():
    vocabulary = {**TIES, f"b{BLANK}b": -0.5}
    counter, tokenizer = tokens.PieceCounter(vocabulary), reference(vocabulary)
    for text in ("ab ba", "b b b", "\nb b\n", " b  b"):
        assert counter.count(text) == own_count(tokenizer, text)


@there
def test_whole_texts_with_the_public_vocabulary(spark):
    vocabulary = tokens.read_vocabulary()
    tokenizer = reference(vocabulary)
    rows = [(1, None), (2, ""), (3, " "), (4, "a  b   c"), (5, "naïve\n\nline 日本語 🙂 x"), (6, prose(1, 5000)), (7, "x" * 20_000)]
    rows += [(8, "same text"), (8, "same text"), (None, "Trailing   \t")]
    got = {(r.doc_id, r.n_tokens) for r in tokens.count_tokens(documents(spark, rows), vocabulary).collect()}
    assert got == {(i, own_count(tokenizer, t or "")) for i, t in rows}
    assert tokens.count_tokens(documents(spark, []), vocabulary).collect() == []
