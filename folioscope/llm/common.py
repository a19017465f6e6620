"""What the operators of this subpackage share: the work folder, partition counts and safe column handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: White space that separates words everywhere in this subpackage: [\x20\x09-\x0D], which is what bytes.split() splits on.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Stands for a null document id where ids are ordered: null ids come first.
NULL_ID = -(2**63)
#: From this estimate on the planner knows nothing.
UNKNOWN_SIZE = 1 << 50


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own if everything runs in
    this process (tests); on a cluster that is an error, for a folder of one machine would be seen by no other."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that no later failure runs its lineage again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def part_count(df: DataFrame, mb_each: int) -> int:
    """Partitions of about ``mb_each`` MB of the planner's size estimate, and at least the session's shuffle partitions.

    Where the planner has no estimate (it then says a petabyte or far more), the session's setting alone counts.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (mb_each << 20) if size < UNKNOWN_SIZE else 0)


HASH_SPAN = 2**63 - 1


def in_share(share: float, *key: str) -> Column:
    """Whether a row is in a share of all rows, by 63 bits of a hash of ``key``: a share of one row in 10**15 still has rows."""
    return F.xxhash64(*key).bitwiseAND(F.lit(HASH_SPAN)) <= F.lit(min(HASH_SPAN, int(share * HASH_SPAN)))


def sample_rows(df: DataFrame, rows: int, key: Sequence[str], total: int | None = None) -> list:
    """About ``rows`` rows (at most twice as many) of ``df``, chosen by a hash of ``key``, on the driver in order of ``key``.

    Where few distinct rows are repeated very often the hash may choose none: then those with the lowest hashes are taken. A
    table with rows never gives an empty sample. ``total`` is the number of rows if it is known already.
    """
    total = df.count() if total is None else total
    if not total:
        return []
    order = F.xxhash64(*key).bitwiseAND(F.lit(HASH_SPAN))
    found = df.where(in_share(rows / total, *key)).limit(2 * rows).collect() or df.orderBy(order).limit(min(rows, 100)).collect()
    if not found:
        raise ValueError(f"no row was sampled of {total}")
    return sorted(found, key=lambda r: [(r[c] is not None, r[c]) for c in key])


def id_and_text(docs: DataFrame, id_col: str, text_col: str, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """Only the columns that an operator reads, under names that no other column can clash with, and those of ``carry``."""
    ship(docs.sparkSession)
    rest = (column.alias(name) for name, column in (carry or {}).items())
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *rest)


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(NULL_ID))


#: Names of simple types, as DDL has them; building a schema from these needs no running session.
SIMPLE = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
SPAN_LIST = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def schema(**kinds: str | T.DataType) -> T.StructType:
    """A schema from name=type."""
    return T.StructType([T.StructField(n, SIMPLE[k] if isinstance(k, str) else k) for n, k in kinds.items()])
