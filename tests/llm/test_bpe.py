import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwire.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MODEL = bpe.sentencepiece_model(RANKS)
ENCODERS = [bpe.Encoder(RANKS, public_tokenizers.PATTERN, MODEL, spaced) for spaced in (True, False)]
TEXTS = ["", " ", "\n\n\t a", "a  b", "a   b ", "a \nb", "x" * 5000, "😀" * 9, "⁇ <unk> ▁a", "<|endoftext|>", "İK é́", "a\x1c b\x1cc \x1cd", "it's  we'll", "1234567 90"]


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t.,'s1aé"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_are_those_of_the_reference_library(text):
    for encoder in ENCODERS:
        assert np.frombuffer(encoder.packed(text), "<u4").tolist() == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("packed", [True, False])
def test_round_trip_on_spark(spark, packed):
    rows = [(i, t, "old") for i, t in enumerate(TEXTS)] + [(99, None, None), (99, None, None)]
    coded = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, decoded string"), RANKS, public_tokenizers.PATTERN, packed=packed)
    for row in bpe.decode(coded, RANKS, packed=packed).collect():
        ids = np.frombuffer(row["ids"], "<u4").tolist() if packed else row["ids"]
        assert ids == REFERENCE.encode_ordinary(row["text"] or "") and bytes(row["decoded"]) == (row["text"] or "").encode()


def test_one_pass_is_encode_then_decode(spark):
    rows = [(i, t, b"old") for i, t in enumerate([*TEXTS, None, "one two  three \n" * 200_000, "word " * 600_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary")
    for row in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert np.array_equal(np.frombuffer(row["ids"], "<u4"), REFERENCE.encode_ordinary(row["text"] or "")) and bytes(row["decoded"]) == (row["text"] or "").encode()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.decode(bpe.encode(none, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_emptied_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "RUN", 2)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN, MODEL, True)
    for text in TEXTS * 2:
        assert np.frombuffer(encoder.packed(text), "<u4").tolist() == REFERENCE.encode_ordinary(text)
