"""Operator 6: byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import sys
import types

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters are cut at safe boundaries into pieces of about this length.
PIECE_CHARS = 20_000
#: Where no pre-token can span: a word, number or punctuation mark is never followed by white space
#: inside a pre-token, and letters and digits never share one.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
#: A run of white space is one pre-token, but for its last character before a word. Longer ones are cut out by this rule, since the pattern's look-ahead would try every end of them.
LONG_SPACE = regex.compile(r"\p{White_Space}{10000,}+")
SPACE_RULE = r"\s+(?!\S)|\s+"
BATCH_ROWS = 500


def encoding(path: str = RANKS, pattern: str = PATTERN):
    """The tiktoken Encoding of a rank file (base64 token, rank a line); built once a Python process."""
    import tiktoken

    kept = sys.modules.setdefault("_lodestone_encodings", types.ModuleType("_lodestone_encodings")).__dict__
    if (path, pattern) not in kept:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        kept[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return kept[path, pattern]


def pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """text, cut at the first safe boundary after every `limit` characters; a stretch without one stays whole."""
    out, start = [], 0
    while len(text) - start > limit:
        cut = SAFE.search(text, start + limit)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def encode_text(enc, text: str, limit: int = PIECE_CHARS, rule: str = SPACE_RULE) -> list[int]:
    """The tokens of text, as encode_ordinary has them, whatever its length."""
    out, start = [], 0
    if enc._pat_str.endswith(rule):
        for run in LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += _encode(enc, text[start : run.start()], limit)
            out += enc._encode_single_piece(text[run.start() : end])
            start = end
    return out + _encode(enc, text[start:] if start else text, limit)


def _encode(enc, text: str, limit: int) -> list[int]:
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    return [t for p in pieces(text, limit) for t in enc.encode_ordinary(p)]


def encode(df: DataFrame, text_col: str = "text", path: str = RANKS, pattern: str = PATTERN, piece_chars: int = PIECE_CHARS, tokens_col: str = "tokens", count_col: str = "n_tokens", exact_col: str = "round_trip", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with its tokens array<int>, their number, and whether decoding their bytes gives the text again.

    Runs inside the partitions, with no shuffle. A null text has null tokens, count and flag; an empty one
    has no tokens. A text of any length is encoded whole, and just as in one piece. Special tokens have no
    meaning: their strings are ordinary text. Repeated rows are encoded alike. A column of df that bears
    the name of an output is replaced; those in `drop` aren't returned, and all others pass through untouched.
    """
    df = df.drop(*(c for c in df.columns if c in (tokens_col, count_col, exact_col) and c != text_col))
    source = df.columns
    kept = [c for c in source if c not in (tokens_col, count_col, exact_col, *drop)]
    schema = df.select(*kept).schema.add(tokens_col, ArrayType(IntegerType())).add(count_col, "integer").add(exact_col, "boolean")
    at, out = source.index(text_col), [source.index(c) for c in kept]

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                texts = part.column(at).to_pylist()
                tokens = [None if t is None else encode_text(enc, t, piece_chars) for t in texts]
                exact = [None if k is None else enc.decode_bytes(k) == t.encode() for k, t in zip(tokens, texts)]
                columns = [*(part.column(i) for i in out), pa.array(tokens, pa.list_(pa.int32())), pa.array([None if k is None else len(k) for k in tokens], pa.int32()), pa.array(exact, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, tokens_col, count_col, exact_col])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, tokens_col: str = "tokens", path: str = RANKS, pattern: str = PATTERN, bytes_col: str = "decoded") -> DataFrame:
    """df with the raw bytes of its tokens, which need not be valid UTF-8 where a token list was cut.

    Null tokens give null, no tokens give no bytes, and a token that the rank file lacks, or a null one,
    makes the whole row null. A column named bytes_col is replaced.
    """
    kept = [c for c in df.columns if c != bytes_col]
    at = kept.index(tokens_col)

    def run(batches):
        enc = encoding(path, pattern)

        def raw(tokens):
            try:
                return None if tokens is None else enc.decode_bytes(tokens)
            except (KeyError, TypeError, OverflowError):
                return None

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([raw(t) for t in batch.column(at).to_pylist()], pa.binary())], [*kept, bytes_col])

    return df.select(*kept).mapInArrow(run, df.select(*kept).schema.add(bytes_col, "binary"))


def bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens."""
    from .session import read

    return encode(read(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",)).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "tokens", "round_trip")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their tokens; no row goes, and odd rows are as encode has them."""
    return encode(docs)
