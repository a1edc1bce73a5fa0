"""Article corpora as JSON Lines and sentence tables as CSV.

A corpus is addressed by name: ``{corpus}_{split}.jsonl`` in a folder, each a
file or a folder of part files. Schemas are explicit, never inferred, and a
damaged line or a label that is no number fails the read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistworks.operators import sampling
from gistworks.operators.observed import observed

ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("article", T.StringType()),
        T.StructField("lay_summary", T.StringType()),
        T.StructField("headings", T.ArrayType(T.StringType())),
        T.StructField("keywords", T.ArrayType(T.StringType())),
    ]
)
SENTENCE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("sent_idx", T.IntegerType()),
        T.StructField("sentence", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)
CSV_OPTIONS = {"header": True, "escape": '"', "mode": "FAILFAST", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def corpus_path(folder: str, corpus: str, split: str) -> str:
    return f"{folder}/{corpus}_{split}.jsonl"


def read_articles(spark: SparkSession, paths: str | Iterable[str], limit: int | None = None) -> DataFrame:
    """One or more JSON Lines paths as articles; ``limit`` rows of each by id,
    0 or None for all."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not limit:
        return _json(spark, paths)
    return union_all([first_rows(_json(spark, p), limit) for p in paths])


def _json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(ARTICLE_SCHEMA).json(paths, mode="FAILFAST")


def read_corpora(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.jsonl`` corpus of a folder, with ``corpus`` and ``split`` from
    its name."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl(?:/|$)", 1)
    return _json(spark, f"{folder}/*.jsonl").withColumns(
        {"corpus": F.substring_index(name, "_", 1), "split": F.substring_index(name, "_", -1)}
    )


def write_articles(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_sentences(
    spark: SparkSession, path: str, schema: T.StructType = SENTENCE_SCHEMA, multi_line: bool = False
) -> DataFrame:
    """A sentence table. Files are split among tasks; ``multi_line`` reads files
    whose sentences hold newlines, each as a whole."""
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=multi_line).csv(path)


def write_sentences(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes, commas and newlines in sentences survive.
    Cleaned sentences hold no newline, so that any task can read its part."""
    df.write.mode("overwrite").options(**{k: v for k, v in CSV_OPTIONS.items() if k != "mode"}).csv(path)


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    """Rows of all parts by column name; a column missing in one part is null."""
    parts = list(parts)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def first_rows(df: DataFrame, limit: int | None, key: str = "id") -> DataFrame:
    """The first ``limit`` rows by ``key``; all for 0 or None. No rows are
    gathered to find them."""
    return sampling.take_first(df, F.col(key), limit) if limit else df


# --- damaged records --------------------------------------------------------


def _quarantined(read: DataFrame, damage: str, path: str, good_path: str, bad_path: str) -> dict[str, int]:
    """Write the good rows and the damaged lines of one reading; both are counted as they pass."""
    kept = [c for c in read.columns if c != damage]
    place = {"file": F.col("_metadata.file_path"), "block_start": F.col("_metadata.file_block_start")}
    marked = read.select(*read.columns, *[value.alias(f"_{name}") for name, value in place.items()], F.col(damage).isNotNull().alias("_bad"))
    marked = marked.persist(StorageLevel.DISK_ONLY)  # the parser may drop columns nobody asks for, and with them the damage
    try:
        good, seen = observed(marked.where("NOT _bad").select(kept), rows=F.count("*"))
        good.write.mode("overwrite").parquet(good_path)
        bad, lost = observed(marked.where("_bad").select(F.col(damage).alias("line"), *[F.col(f"_{n}").alias(n) for n in place]), rows=F.count("*"))
        bad.write.mode("overwrite").parquet(bad_path)
    finally:
        marked.unpersist()
    return {"good": seen.get["rows"], "bad": lost.get["rows"]}


def quarantine_articles(spark: SparkSession, path: str, good_path: str, bad_path: str) -> dict[str, int]:
    """A JSON Lines corpus as two tables: the rows that are whole, and the damaged lines with the file and block they are in.

    A line is damaged if it is no JSON object or a field has another type; blank
    lines are none. Returns the numbers of both, whose sum is the lines read.
    """
    schema = T.StructType([*ARTICLE_SCHEMA.fields, T.StructField("_damage", T.StringType())])
    read = spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_damage")
    return _quarantined(read, "_damage", path, good_path, bad_path)


def quarantine_sentences(spark: SparkSession, path: str, good_path: str, bad_path: str) -> dict[str, int]:
    """A CSV sentence table likewise: a line with too few or too many fields, or a label that is no number, is damaged."""
    schema = T.StructType([*SENTENCE_SCHEMA.fields, T.StructField("_damage", T.StringType())])
    options = CSV_OPTIONS | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damage", "enforceSchema": True}
    return _quarantined(spark.read.schema(schema).options(**options).csv(path), "_damage", path, good_path, bad_path)


# --- corpora as one partitioned table ---------------------------------------


#: Characters of texts that one file of a partitioned table holds, and the task that writes it reads.
CHARS_PER_FILE = 64_000_000


def _files(df: DataFrame, rows_per_file: int) -> DataFrame:
    """``corpus, split, _files``: the files that the rows and the texts of each partition need."""
    texts = [F.coalesce(F.length(c), F.lit(0)).cast("long") for c in ("article", "lay_summary") if c in df.columns]
    counts = df.groupBy("corpus", "split").agg(F.count("*").alias("_n"), F.sum(sum(texts, F.lit(0).cast("long"))).alias("_chars"))
    needed = F.ceil(F.greatest(F.col("_n") / rows_per_file, F.col("_chars") / CHARS_PER_FILE))
    return counts.select("corpus", "split", F.greatest(needed, F.lit(1)).cast("int").alias("_files"))


def write_partitions(df: DataFrame, path: str, rows_per_file: int = 200_000) -> None:
    """Articles with ``corpus, split`` into a table partitioned by them. Partitions that ``df`` holds are replaced, the
    others stay: a split that is made anew does not touch its neighbours.

    Rows are gathered by partition before they are written, a large one dealt out
    to as many tasks as its rows and the length of its texts need, so that the
    number of files follows the rows and not tasks times partitions. The counts, a
    row for each partition, are broadcast: a join would bring a whole one to a task.
    """
    parts = _files(df, rows_per_file)
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("corpus", "split")]
    dealt = df.alias("d").join(F.broadcast(parts).alias("p"), same).select("d.*", F.pmod(F.xxhash64("d.id"), F.col("p._files")).alias("_file"))
    dealt = dealt.repartition("corpus", "split", "_file").drop("_file")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy("corpus", "split").parquet(path)


def read_partitions(spark: SparkSession, path: str, corpus: str | None = None, split: str | None = None) -> DataFrame:
    """The articles of a partitioned table, of one corpus or split if named: Spark opens no other folder."""
    schema = T.StructType([*ARTICLE_SCHEMA.fields, T.StructField("corpus", T.StringType()), T.StructField("split", T.StringType())])
    df = spark.read.schema(schema).parquet(path)
    for name, value in (("corpus", corpus), ("split", split)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df
