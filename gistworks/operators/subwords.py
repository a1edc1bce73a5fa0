"""Model inputs of subword ids from a public vocabulary file.

The vocabulary is never built here: its file is a parameter. A text becomes ids,
and ids become text, in the row, by small Arrow functions that hold the file, so
that nothing is shuffled. Where only lengths are wanted, texts are cut into the
file's own kind of pieces by column expressions, Spark finds the different pieces of
a corpus, each is cut once, and the texts meet their sizes by a join, which
broadcasts the frequent pieces, a bounded number.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistworks.functions import vectors
from gistworks.session import checkpointed

MAX_INPUT, MAX_OUTPUT = 512, 128

#: A piece in more than one of so many piece rows is frequent: no more than that many pieces are.
FREQUENT_SHARE = 10_000

#: Rows that are plain Python values at a time.
SLICE = 64

#: Ends a word's last subword.
WORD_END = "</w>"


def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def pattern(path: str) -> str:
    """The regular expression of a vocabulary file's pieces."""
    steps = _file(path)["pre_tokenizer"]
    for step in steps.get("pretokenizers", [steps]):
        if step["type"] == "Split":
            return step["pattern"]["Regex"]
    raise ValueError(f"{path} does not say how a text is cut into pieces")


def end_of_text(path: str) -> int:
    """The id of the last special token, which also fills up."""
    return max(t["id"] for t in _file(path)["added_tokens"] if t["special"])


def pieces(value: Column, regex: str) -> Column:
    """The pieces of a text, lower-cased, white space dropped; none of a null."""
    return F.coalesce(F.regexp_extract_all(F.lower(value), F.lit(f"(?U){regex}"), F.lit(0)), F.array().cast("array<string>"))


_TOKENIZERS: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


def piece_ids(df: DataFrame, columns: list[str], path: str, length: int | None = None) -> DataFrame:
    """``piece, frequent, ids`` of all different pieces of the columns, of their first ``length`` pieces if given."""
    regex = pattern(path)
    cut = [F.slice(pieces(F.col(c), regex), 1, length) if length else pieces(F.col(c), regex) for c in columns]
    counted = df.select(F.explode(F.concat(*cut)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    counted = checkpointed(counted)
    total = counted.agg(F.sum("n")).first()[0] or 0
    marked = counted.select("piece", (F.col("n") * FREQUENT_SHARE > total).alias("frequent"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _tokenizer(path).encode_batch(batch.column("piece").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([e.ids for e in found], pa.list_(pa.int32()))], ["piece", "frequent", "ids"])

    return checkpointed(marked.mapInArrow(run, "piece string, frequent boolean, ids array<int>"))


def _ids(value: Column, path: str, length: int) -> Column:
    """The first ids of a text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for at in range(0, len(batch), SLICE):
                rows = [_tokenizer(path).encode(t, add_special_tokens=False).ids[:length] if t else [] for t in batch.slice(at, SLICE).to_pylist()]
                parts.append(pa.array(rows, pa.list_(pa.int32())))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(value)


def encoded(df: DataFrame, path: str, keys: list[str], columns: dict[str, int]) -> DataFrame:
    """``keys`` and ``{column}_ids``, the first ids of each column, at most the given number, a row for each row.

    A null or empty text has no ids.
    """
    return df.select(*keys, *[_ids(F.col(c), path, n).alias(f"{c}_ids") for c, n in columns.items()])


def model_inputs(df: DataFrame, path: str, keys: list[str], max_input: int = MAX_INPUT, max_output: int = MAX_OUTPUT) -> DataFrame:
    """``keys, input_ids, attention_mask, global_attention_mask, labels`` of each row, all of fixed length; padded labels are -100."""
    pad = end_of_text(path)
    ids = encoded(df, path, keys, {"article": max_input, "lay_summary": max_output})
    return ids.select(
        *keys,
        vectors.pad_to(F.col("article_ids"), max_input, pad).alias("input_ids"),
        vectors.attention_mask(F.col("article_ids"), max_input).alias("attention_mask"),
        vectors.global_attention_mask(max_input).alias("global_attention_mask"),
        vectors.mask_labels(vectors.pad_to(F.col("lay_summary_ids"), max_output, pad), pad).alias("labels"),
    )


def lengths(df: DataFrame, path: str, column: str) -> DataFrame:
    """The rows with ``n_tokens``, the number of subwords of a column: the sum of its pieces', which never leave the table of pieces."""
    regex = pattern(path)
    table = piece_ids(df, [column], path).select("piece", "frequent", F.size("ids").alias("n"))
    rows = df.withColumn("_text", F.xxhash64(column))
    counted = rows.groupBy("_text").agg(F.any_value(column).alias("_value")).select("_text", F.explode(pieces(F.col("_value"), regex)).alias("piece"))
    counted = counted.groupBy("_text", "piece").agg(F.count("*").alias("times"))
    near = counted.join(F.broadcast(table.where("frequent")), "piece")
    far = counted.join(F.broadcast(table.where("frequent").select("piece")), "piece", "left_anti").join(table.where("not frequent"), "piece")
    sums = near.unionByName(far).groupBy("_text").agg(F.sum(F.col("n") * F.col("times")).alias("n_tokens"))
    return rows.join(sums, "_text", "left").select(*df.columns, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def _alphabet() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, the others for those from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_BYTES: dict[str, dict[int, bytes]] = {}


def _vocabulary(path: str) -> dict[int, bytes]:
    """The bytes of each subword of the file, a blank behind the last of a word."""
    if path not in _BYTES:
        alphabet, found = _alphabet(), {}
        for token, number in _file(path)["model"]["vocab"].items():
            body = token.removesuffix(WORD_END)
            found[number] = bytes([*[alphabet[c] for c in body], *([32] if token != body else [])])
        _BYTES[path] = found
    return _BYTES[path]


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``token_id, piece``: the bytes of each subword of the file, a blank behind the last of a word."""
    return spark.createDataFrame([(number, bytearray(piece)) for number, piece in _vocabulary(path).items()], "token_id int, piece binary")


def decoded(df: DataFrame, path: str, keys: list[str], column: str = "labels") -> DataFrame:
    """``keys, text`` of each row: its ids back to pieces with blanks between them; masked and special ids are skipped."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _vocabulary(path)
        for batch in batches:
            parts = [
                pa.array([b"".join(table.get(i, b"") for i in ids or [] if i is not None).decode("utf-8").rstrip(" ") for ids in batch.slice(at, SLICE).to_pylist()], pa.string())
                for at in range(0, len(batch), SLICE)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return df.select(*keys, F.arrow_udf(run, T.StringType())(F.col(column)).alias("text"))
