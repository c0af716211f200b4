"""Relational sources and sinks.

Columns are matched by their names in the header, never by place; every type is
explicit.  A file whose header does not fit is refused with the difference, and a
value that does not fit its type is a reject, not a silent null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.plans.session import scratch_path


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
          "date": T.DateType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in text.split(","))])


CUSTOMERS = _schema("cust_id bigint, first_name string, last_name string, location string, revenue bigint, "
                    "credit_score int, age_bucket string, birth_date date")
PRODUCTS = _schema("prod_id int, name string, category string, risk_class string, price double, interest_rate double, "
                   "short_desc string, long_desc string")
OWNERSHIP = _schema("cust_id bigint, prod_id int, since_date date, deal_volume double, credit_type string, "
                    "interest_rate double, risk_class string, adviser_id bigint")
SALES = _schema("sale_id string, cust_id bigint, prod_id int, amount double, sale_date date, adviser_id bigint, "
                "decision string, reason string")
SCHEMAS = {"customers": CUSTOMERS, "products": PRODUCTS, "ownership": OWNERSHIP, "sales": SALES}
#: Columns that a file may leave out.
OPTIONAL = {"birth_date"}
# Header names of the given files, and ours.
HEADER_NAMES = {"kundenbetreuer_id": "adviser_id", "entscheidung": "decision", "begruendung": "reason"}


class HeaderMismatch(ValueError):
    """A header without a needed column, or with one that the table does not have."""

    def __init__(self, path: str, missing: list[str], unknown: list[str]):
        super().__init__(f"{path}: missing columns {missing}, unknown columns {unknown}")
        self.missing, self.unknown = missing, unknown


@dataclass(frozen=True)
class Read:
    """A table as read: the typed rows, and the rows with a value that fits no type
    (``bad_columns`` and all values as text).  Together they are all rows."""

    rows: DataFrame
    rejects: DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> Read:
    """Header, quoted fields (commas inside quotes), empty field = null.

    The header of the first file names the columns; with ``enforceSchema`` off, Spark
    compares the header of every other file with it and refuses a different one."""
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    header = spark.read.options(**options).csv(path).columns
    names = [HEADER_NAMES.get(h.strip().lower(), h.strip().lower()) for h in header]
    wanted = schema.fieldNames()
    missing = [c for c in wanted if c not in names and c not in OPTIONAL]
    unknown = [h for h, c in zip(header, names, strict=True) if c not in wanted]
    if missing or unknown or len(set(names)) < len(names):
        raise HeaderMismatch(path, missing, unknown or [n for n in names if names.count(n) > 1])
    text = T.StructType([T.StructField(h, T.StringType()) for h in header])
    raw = spark.read.schema(text).options(**options, enforceSchema=False).csv(path).toDF(*names)
    typed = {f.name: F.col(f.name).try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)
             for f in schema.fields}
    bad = F.filter(F.array(*[F.when(F.col(c).isNotNull() & typed[c].isNull(), F.lit(c)) for c in names]),
                   lambda c: c.isNotNull())
    marked = raw.withColumn("bad_columns", bad)
    good = marked.filter(F.size("bad_columns") == 0).select(*(typed[c].alias(c) for c in wanted))
    return Read(good, marked.filter(F.size("bad_columns") > 0))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """The rows of :func:`read_csv_checked`; a file with rejects is refused, so that
    no row is lost unseen."""
    read = read_csv_checked(spark, path, schema, multi_line)
    example = read.rejects.first()
    if example is not None:
        raise ValueError(f"{path}: a value does not fit the type of {example['bad_columns']}, e.g. in {example.asDict()}")
    return read.rows


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """S1 by table name: CSV for the small original files, parquet otherwise."""
    if path.endswith(".csv") or name.endswith("_csv"):
        return read_csv(spark, path, SCHEMAS[name.removesuffix("_csv")])
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def column_digests(df: DataFrame, table: str) -> DataFrame:
    """``table_name, column_name, rows, present, digest`` per column: the digest adds
    up a hash of every value's text (money and rates with two digits)."""
    def told(f):
        c = F.col(f.name)
        return c.cast("decimal(18,2)").cast("string") if isinstance(f.dataType, T.DoubleType) else c.cast("string")

    sums = [F.struct(F.lit(f.name).alias("column_name"), F.count(f.name).alias("present"), F.coalesce(F.sum(
        F.conv(F.substring(F.md5(told(f).cast("binary")), 1, 8), 16, 10).cast("bigint")), F.lit(0)).alias("digest"))
        for f in df.schema.fields]
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*sums).alias("c"))
    return one.select(F.lit(table).alias("table_name"), "rows", F.inline("c")).select(
        "table_name", "column_name", "rows", "present", "digest")


def write_parquet(df: DataFrame, path: str) -> None:
    """S3: features and other derived tables."""
    df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A missing path raises AnalysisException (PATH_NOT_FOUND)."""
    return spark.read.parquet(path)


FILE_BYTES = 128 << 20
#: Small files that one task writes one after the other.
TASK_FILES = 64


def written_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files under ``path``, from their listing (no content is read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.sum("length")).first()[0] or 0


def write_sorted(df: DataFrame, path: str, keys, file_bytes: int = FILE_BYTES) -> int:
    """Range-partition on the keys, sort inside partitions, write; returns the
    number of files.

    The rows are written aside first: that measures the bytes from which the number of
    files follows, and the range sampling then reads files instead of repeating the
    plan.  A key that holds a third of the rows is spread by the keys behind it.

    The driver gets a sample of keys for each range and the commit of each task.  So a
    range holds many small files (``TASK_FILES``), which its task cuts by rows."""
    spark, keys = df.sparkSession, list(keys)
    aside = scratch_path(spark, "sort_input")
    df.write.parquet(aside)
    n = max(1, -(-written_bytes(spark, aside) // file_bytes))
    together = max(1, min(TASK_FILES, FILE_BYTES // file_bytes))
    found = spark.read.parquet(aside)
    ordered = found.repartitionByRange(-(-n // together), *keys).sortWithinPartitions(*keys)
    if together == 1:
        ordered.write.mode("overwrite").parquet(path)
        return n
    rows = max(1, -(-found.count() // n))
    # A file begins at every so many rows of a partition: the lower 33 bits are the row's place there.
    begins = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) % rows == 0
    files = Observation()
    ordered.observe(files, F.count_if(begins).alias("n")).write.mode("overwrite").option(
        "maxRecordsPerFile", rows).parquet(path)
    return max(1, files.get["n"])


def sorted_files(spark: SparkSession, path: str, keys) -> DataFrame:
    """Check of S8, a row per file: ``file, rows, inside`` (its rows are in order) and
    ``behind`` (none sorts before the last row of the file before)."""
    key = F.struct(*keys)
    rows = spark.read.parquet(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("i"), key.alias("k"))
    before = F.lag("k").over(Window.partitionBy("file").orderBy("i"))
    per_file = rows.withColumn("before", before).groupBy("file").agg(
        F.count("*").alias("rows"), F.min("k").alias("least"), F.max("k").alias("most"),
        F.bool_and(F.col("before").isNull() | (F.col("before") <= F.col("k"))).alias("inside"))
    # Names count partitions and the files of each, with five and three digits at least.
    number = lambda pattern: F.regexp_extract("file", pattern, 1).try_cast("long")
    last = F.lag("most").over(Window.orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)"), "file"))
    return per_file.select("file", "rows", "inside", F.coalesce(last <= F.col("least"), F.lit(True)).alias("behind"))
