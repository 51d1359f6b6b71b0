import json

import pytest
from tokenizers import Tokenizer

from loamworks.llm import token_counts
from loamworks.session import read_table

from ..conftest import SF

HARD = [None, "", " ", "it's we'LL don't", "x<|endoftext|>y <|startoftext|>", "é ̈a Å", "ΑΣ ΣΑΣ. İI ß", "a b c​d　e", "漢字 123 4.5%%%", "\x00\x1f \x85 a", "w" * 5000, "the " * 9000]


def test_equals_the_library_on_whole_texts(spark, monkeypatch):
    texts = [r.text for r in read_table(spark, SF, "documents").collect()] + HARD
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)
    whole = Tokenizer.from_file(token_counts.vocabulary())
    want = [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = {r.doc_id: r for r in token_counts.token_counts(docs).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 2048) for i, t in enumerate(texts))
    monkeypatch.setattr(token_counts, "BATCH", 50)
    monkeypatch.setattr(token_counts, "REMEMBERED", 40)
    lengths = token_counts.Lengths(token_counts.vocabulary())
    assert [lengths.of(t or "") for t in texts] == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_byte_rules_equal_the_library_and_others_are_refused(spark, tmp_path, monkeypatch):
    texts = [r.text for r in read_table(spark, SF, "documents").collect()][:80] + HARD + ["a  b   c \n\n d", "x <|endoftext|> y", " lead", "trail ", "tab\t x", "\x1c \x1d a b"]
    path = token_counts.vocabulary("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    want = [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, name="byte_bpe_50k.json").collect()}
    assert [got[i] for i in range(len(texts))] == want
    monkeypatch.setattr(token_counts, "BATCH", 30)
    assert token_counts.Lengths(path).of_all(t or "" for t in texts) == want
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken"):
        with pytest.raises(ValueError):
            token_counts.token_counts(docs, name=name)
    file = json.load(open(token_counts.vocabulary()))
    file["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"[\p{L}\p{N}]+"}
    (tmp_path / "other.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        token_counts.rules(str(tmp_path / "other.json"))


def test_batches_hold_many_texts_or_part_of_one(monkeypatch):
    lengths, calls = token_counts.Lengths(token_counts.vocabulary()), []

    class Counted:
        def encode_batch_fast(self, chunks, real=lengths.tokenizer, **how):
            calls.append(len(chunks))
            return real.encode_batch_fast(chunks, **how)

    lengths.tokenizer = Counted()
    short = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q text {i}" for i in range(1000)]
    first = lengths.of_all(short)
    assert len(calls) == 1  # a thousand texts in one call
    monkeypatch.setattr(token_counts, "BATCH", 1000)
    lengths.known, calls[:] = {}, []
    assert lengths.of_all([" ".join(short)]) == [sum(first)] and len(calls) > 1


def test_repeated_rows_and_null_keys_are_counted_each(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "three"), (None, None), (None, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs).collect())
    assert got == [(0, 0, 0), (0, 1, 1), (1, 5, 1), (1, 7, 2), (1, 7, 2)]
