"""CSV extracts (SRC1-SRC5): comma separated, optional double quotes, one header line.

The four files are read with their text schema (``possum.schemas.RAW``) plus a
corrupt-record column, in PERMISSIVE mode: a malformed, short or over-long row
keeps its raw text in ``_corrupt_record`` and becomes a reject in the cleaning
step instead of failing the job. Spark parses only the selected columns of a
CSV file by default, and then a short row goes unnoticed when its missing
fields are not selected; the reader's ``columnPruning`` option is therefore
off. ``\\N`` is null, as the reference's loader reads it.

A quoted field may hold line breaks. ``line_breaks`` says how a file is read:

* ``split`` (default): the records are found over the file's splits, which
  many tasks read (``possum.sources.csv_splits``), then parsed one by one;
* ``none``: no quoted field holds a line break, and Spark's reader splits the
  file itself, in one reading;
* ``whole``: Spark's ``multiLine`` reader, one task a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from possum.schemas import RAW
from possum.sources import csv_splits

CORRUPT = "_corrupt_record"
NULL_TEXT = "\\N"
LINE_BREAKS = ("split", "none", "whole")


def extract_schema(kind: str) -> T.StructType:
    return T.StructType(list(RAW[kind].fields) + [T.StructField(CORRUPT, T.StringType(), True)])


def read_extract(spark: SparkSession, path: str, kind: str, escape: str = "\\", header: bool = True,
                 sep: str = ",", line_breaks: str = "split", stage: str | None = None) -> DataFrame:
    """Read one extract (``customers``, ``orders``, ``products`` or
    ``orderlines``). ``escape`` is the character before a quote inside a quoted
    field: backslash (default) or ``"`` for doubled quotes (Q15). ``stage``: the
    folder that ``split`` writes the records to."""
    if line_breaks not in LINE_BREAKS:
        raise ValueError(f"line_breaks is one of {LINE_BREAKS}")
    schema = extract_schema(kind)
    if line_breaks == "split":
        records = csv_splits.read_records(spark, path, stage, header=header, sep=sep, escape=escape)
        parsed = csv_splits.parse_records(records, schema.toDDL(), CORRUPT, sep=sep, escape=escape)
        rows = records.select(parsed.alias("_row")).select("_row.*")
    else:
        rows = (
            spark.read.schema(schema)
            .option("header", header)
            .option("sep", sep)
            .option("quote", '"')
            .option("escape", escape)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("multiLine", line_breaks == "whole")
            .option("columnPruning", False)
            .csv(path)
        )
    fields = [F.nullif(F.col(c), F.lit(NULL_TEXT)).alias(c) for c in RAW[kind].fieldNames()]
    return rows.select(*fields, CORRUPT)


def write_extract(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a raw text DataFrame as a CSV extract with a header line."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", "\\")
     .option("quoteAll", False).csv(path))
