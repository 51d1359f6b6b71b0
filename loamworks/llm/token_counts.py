"""Token counts of whole texts, as the tokenizer's library gives them; only lengths leave the tasks."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in one encoding batch, whatever the number of texts; longer texts are split at safe boundaries.
BATCH = 1 << 20
#: Chunks whose lengths a worker remembers.
REMEMBERED = 500_000
#: ASCII white space: this kind of tokenizer drops it and never looks across it.
SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
#: Texts of these characters have no other form, and no special tokens without "<|".
SIMPLE = re.compile(r"[ \t\n\r!-~À-ÖØ-öø-ÿ]*")
#: In byte-level vocabularies a part may begin with one space, but none goes on behind a visible character and a space.
BEFORE_SPACE = re.compile(r"(?<=[!-~])(?= [!-~])")
# The pattern by which word vocabularies of this kind cut texts.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The tokenizer's own pieces, for lower-cased texts of such characters.
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\ra-zß-öø-ÿ0-9]+")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file, on the driver and the executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def rules(path: str) -> str:
    """How texts may be cut for a vocabulary file: "words" or "bytes". Files of any other kind are refused."""
    if not path.endswith(".json"):
        raise ValueError(f"not a vocabulary of the tokenizers library: {path}")
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    cut, form = file.get("pre_tokenizer") or {}, file.get("normalizer") or {}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in file.get("added_tokens", [])):
        raise ValueError(f"special tokens that reach over white space: {path}")
    if cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not form:
        return "bytes"
    steps, forms = cut.get("pretokenizers", []), [n["type"] for n in form.get("normalizers", [])]
    if forms == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in steps] == ["Split", "ByteLevel"]:
        split, level = steps
        if split["pattern"] == {"Regex": WORDS} and split["behavior"] == "Removed" and split["invert"] and not level["use_regex"] and not level["add_prefix_space"]:
            return "words"
    raise ValueError(f"no safe boundaries are known for {path}")


class Lengths:
    """Lengths of texts in tokens, by way of their distinct chunks between safe boundaries."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.rules, self.known = Tokenizer.from_file(path), rules(path), {}

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of BATCH characters, each up to the next safe boundary."""
        safe, at = SPACE if self.rules == "words" else BEFORE_SPACE, 0
        while at < len(text):
            found = safe.search(text, at + BATCH) if len(text) > at + BATCH else None
            end = found.start() if found else len(text)
            yield text[at:end]
            at = end

    def chunks(self, piece: str) -> list[str]:
        """What the tokenizer looks at one by one, or more of it in a row.

        Among word rules, simple characters fall into the tokenizer's own parts, others into what stands between white space.
        """
        if self.rules == "bytes":
            return BEFORE_SPACE.split(piece)
        if SIMPLE.fullmatch(piece) and "<|" not in piece:
            return PART.findall(piece.lower())
        words = SPACE.split(piece)
        hard = [not SIMPLE.fullmatch(c) or "<|" in c for c in words]
        plain = " ".join(c for c, h in zip(words, hard, strict=True) if not h)
        return PART.findall(plain.lower()) + [c for c, h in zip(words, hard, strict=True) if h]

    def of(self, text: str) -> int:
        """Tokens of one text."""
        return self.of_all([text])[0]

    def of_all(self, texts: Iterable[str]) -> list[int]:
        """Tokens of each text. The chunks of about BATCH bytes, of many texts or of a part of one, are encoded in one call."""
        totals, waiting, size = [], [], 0

        def encode() -> None:
            if len(self.known) > REMEMBERED:
                self.known = {}
            fresh = [c for c in {c for _, chunks in waiting for c in chunks} if c not in self.known]
            if fresh:
                encoded = self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
                self.known.update((c, len(e.ids)) for c, e in zip(fresh, encoded, strict=True))
            for row, chunks in waiting:
                totals[row] += sum(map(self.known.__getitem__, chunks))
            waiting.clear()

        for row, text in enumerate(texts):
            totals.append(0)
            for piece in self.pieces(text):
                waiting.append((row, self.chunks(piece)))
                size += len(piece) if piece.isascii() else len(piece.encode())
                if size >= BATCH:
                    encode()
                    size = 0
        encode()
        return totals


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(path)
        for batch in batches:
            counts = lengths.of_all(t.as_py() or "" for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 2048, name: str = "word_bpe_49k.json") -> DataFrame:
    """Per row of docs: key, n_bytes (UTF-8), n_tokens and over_limit.

    Null texts count as empty, with no token. All rows stay: repeated rows and keys are counted each, null keys too, and
    an empty table gives none. Very long texts are encoded in pieces, with the tokens of the whole. name is a file of
    word or byte rules (rules); others raise ValueError before anything runs.
    """
    rules(vocabulary(name))
    lean = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = lean.mapInArrow(_counter(vocabulary(name)), f"key {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
