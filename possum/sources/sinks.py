"""Document and table sinks (SNK1-SNK8, SRC6).

* ``json_text``: one JSON object per document, nulls kept (``ignoreNullFields``
  off, so ``"ShippingDate": null`` stays like the reference's export).
* ``write_json``: a directory of part files, one document per line. Modes:
  ``ignore`` skips an existing export (SNK3), ``overwrite`` replaces it (SNK4).
  No ``coalesce(1)``: every task writes its own part.
* ``publish``: write a new version folder, then switch a small pointer file,
  so readers never see a half-written set (SNK5).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from possum.operators.collect import PIECE
from possum.sources.files import file_system, read_text, replace_text
from possum.sources.files import rename_over as _replace  # noqa: F401
from possum.sources.lease import Lease, LeaseLost

JSON_OPTIONS = {"ignoreNullFields": "false"}
PRETTY_OPTIONS = {"ignoreNullFields": "false", "pretty": "true"}


def json_text(fields: Sequence[str], pretty: bool = False) -> Column:
    """``JSON_OBJECT`` of the listed columns, in order, as text."""
    return F.to_json(F.struct(*[F.col(f) for f in fields]), PRETTY_OPTIONS if pretty else JSON_OPTIONS)


def json_documents(docs: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Key columns plus ``doc``, the JSON text of ``fields`` (SNK1 row form).
    Documents in pieces (``collect.collect_pieces``) become one text each."""
    if PIECE in docs.columns:
        return _joined_documents(docs, fields, keys)
    return docs.select(*[F.col(k) for k in keys], json_text(fields).alias("doc"))


def _joined_documents(docs: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``json_documents`` of documents whose array field lies in pieces, one row
    each: a piece becomes text where it is, and a document's task joins the
    texts. All other columns are the same in the rows of a document and tell it from others."""
    array = next(f for f in fields if isinstance(docs.schema[f].dataType, T.ArrayType))
    at = list(fields).index(array)

    def inner(json: Column) -> Column:
        """JSON text without its outer brackets."""
        return F.substring(json, F.lit(2), F.length(json) - 2)

    def members(names: Sequence[str], before: str = "", after: str = "") -> Column:
        return F.concat(F.lit(before), inner(json_text(names)), F.lit(after)) if names else F.lit("")

    text = F.nullif(inner(F.to_json(F.col(array), JSON_OPTIONS)), F.lit(""))
    piece = F.when(F.col(array).isNotNull(), F.struct(PIECE, F.col(array).alias("text")))
    elements = F.concat_ws(",", F.sort_array(F.collect_list(piece))["text"])
    head, tail = members(fields[:at], after=","), members(fields[at + 1:], before=",")
    # in one concat: each copies the document
    doc = F.concat(F.lit("{"), head, F.lit(f'"{array}":['), elements, F.lit("]"), tail, F.lit("}"))
    same = [c for c in docs.columns if c not in (array, PIECE)]
    return docs.withColumn(array, text).groupBy(*same).agg(doc.alias("doc")).select(*keys, "doc")


def write_json(docs: DataFrame, fields: Sequence[str], path: str, mode: str = "overwrite",
               pretty_path: str | None = None, compression: str = "none") -> None:
    """SNK1/SNK3/SNK4: write one JSON document per line; SNK2 a pretty copy."""
    docs.select(json_text(fields).alias("value")).write.mode(mode).text(path, compression=compression)
    if pretty_path:
        docs.select(json_text(fields, pretty=True).alias("value")).write.mode(mode).text(pretty_path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC6: read exported documents back with an explicit schema (decimals stay
    decimals, dates stay dates)."""
    return spark.read.schema(schema).json(path)


# --- atomic publish (SNK5) ----------------------------------------------------

POINTER = "_CURRENT"


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under ``path``, the least recently changed first; none if it doesn't exist."""
    fs, p, _ = file_system(spark, path)
    found = [f for f in fs.listStatus(p) if f.isDirectory()] if fs.exists(p) else []
    return [n for _, n in sorted((f.getModificationTime(), f.getPath().getName()) for f in found)]


def remove(spark: SparkSession, path: str) -> None:
    fs, p, _ = file_system(spark, path)
    fs.delete(p, True)


def byte_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``."""
    fs, p, _ = file_system(spark, path)
    return fs.getContentSummary(p).getLength()


def prune(spark: SparkSession, root: str, keep: int) -> None:
    """Remove published versions but the current one and the ``keep`` newest others, for readers still on them."""
    current = f"v={current_version(spark, root)}"
    others = [n for n in folders(spark, root) if n.startswith("v=") and n != current]
    for n in others[: max(0, len(others) - keep)]:
        remove(spark, f"{root.rstrip('/')}/{n}")


def _pointer(spark: SparkSession, root: str) -> dict | None:
    """What the pointer file under ``root`` says, or None."""
    path = f"{root.rstrip('/')}/{POINTER}"
    fs, p, _ = file_system(spark, path)
    return json.loads(read_text(spark, path)) if fs.exists(p) else None


def current_version(spark: SparkSession, root: str) -> str | None:
    """The published version folder name under ``root``, or None."""
    pointer = _pointer(spark, root)
    return pointer["version"] if pointer else None


def publish(spark: SparkSession, df: DataFrame, root: str, version: str | None = None,
            fmt: str = "parquet", fields: Sequence[str] | None = None, lease: Lease | None = None,
            compression: str = "none") -> str:
    """Write ``df`` as a new version under ``root`` and make it current.

    The data goes to ``root/v=<version>`` first; only after the write job
    committed is the pointer file replaced (write to a temporary name, then
    rename, which is atomic on HDFS-like stores). Publishing a version that is
    already current does nothing, so a replayed batch is harmless. Old
    versions are left for readers still on them.

    With a ``lease`` the pointer is switched only while the lease is held and
    no later token has published here; else ``LeaseLost`` is raised and the
    pointer stays. ``compression`` is that of JSON part files, which Spark reads back as they are.
    """
    version = version or uuid.uuid4().hex
    if current_version(spark, root) == version:
        return version
    target = f"{root.rstrip('/')}/v={version}"
    if fmt == "json":
        write_json(df, fields or df.columns, target, mode="overwrite", compression=compression)
    else:
        df.write.mode("overwrite").format(fmt).save(target)
    pointer = {"version": version, "format": fmt}
    if lease is not None:
        lease.check()
        if ((_pointer(spark, root) or {}).get("token") or 0) > lease.token:
            raise LeaseLost(f"{root}: published under a later token than {lease.token}")
        pointer["token"] = lease.token
    replace_text(spark, f"{root.rstrip('/')}/{POINTER}", json.dumps(pointer))
    return version


def read_published(spark: SparkSession, root: str, fmt: str = "parquet",
                   schema: T.StructType | None = None) -> DataFrame:
    """Read the current version under ``root``."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing published under {root}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "json":
        return reader.json(f"{root.rstrip('/')}/v={version}")
    return reader.format(fmt).load(os.path.join(root, f"v={version}"))
