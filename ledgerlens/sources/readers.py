"""Typed readers: CSV, JSON lines, binary files; and the warehouse of Parquet tables."""

from __future__ import annotations

import hashlib
import os
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType

from .schema import LOANS, TABLES, raw_header

#: Header names accepted for industry titles, first match wins.
CODE_HEADERS, TITLE_HEADERS = ("naics_code", "naics", "code", "seq_no"), ("title", "description", "naics_title", "naics_description")
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "tif", "tiff")


def typed(column: Column, kind: DataType) -> Column:
    """A text value as kind; blanks and malformed values become null. Dates are MM/dd/yyyy."""
    blank = F.nullif(F.trim(column), F.lit(""))
    if isinstance(kind, DateType):
        return F.try_to_date(blank, "MM/dd/yyyy")
    return column if isinstance(kind, StringType) else blank.try_cast(kind)


def _csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=False, mode="DROPMALFORMED")


def read_loans_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw loan files (one path, several or a glob in one scan) as the 42 warehouse columns; rows without a number drop."""
    raw = _csv(spark, path)
    have = {c.lower(): c for c in raw.columns}
    cols = [typed(F.col(f"`{have[raw_header(f.name).lower()]}`"), f.dataType).alias(f.name) for f in LOANS]
    return raw.select(*cols).where(F.col("loan_number").isNotNull())


def read_establishments_csv(spark: SparkSession, path: str) -> DataFrame:
    """zip, naics, est with headers in any case; est that is no whole number becomes null."""
    raw = _csv(spark, path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    return raw.select(F.col("zip"), F.col("naics"), F.trim("est").try_cast("int").alias("establishments"))


def read_naics_titles_csv(spark: SparkSession, path: str) -> DataFrame:
    """Code and title from the first headers known; ValueError if either is missing."""
    raw = _csv(spark, path)
    have = {c.strip().lower(): c for c in raw.columns}
    pick = [next((have[h] for h in names if h in have), None) for names in (CODE_HEADERS, TITLE_HEADERS)]
    if None in pick:
        raise ValueError(f"no code or title column among {raw.columns}")
    code, title = (F.trim(F.col(f"`{c}`")) for c in pick)
    return raw.select(code.alias("naics_code"), title.alias("title")).where(F.col("naics_code").isNotNull() & F.col("title").isNotNull())


def read_raw_releases(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines of a release feed: title, body (markup), date (epoch seconds as text), url, topic."""
    return spark.read.json(path, schema="title string, body string, date string, url string, topic array<struct<uuid:string>>")


def read_labelled_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, content) of the images under authentic/ and forged/: label 0 and 1. Endings in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ending = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    label = F.when(F.col("path").contains("/authentic/"), 0).when(F.col("path").contains("/forged/"), 1)
    return files.where(ending.isin(*IMAGE_ENDINGS)).select("path", label.alias("label"), "content")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file, hashed where the file is read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def sha256_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Warehouse:
    """A folder of Parquet tables with fixed schemas.

    A table that doesn't exist yet reads as an empty one; a warning tells, unless missing_ok says that it may be missing.
    """

    def __init__(self, spark: SparkSession, folder: str, missing_ok: bool = False):
        self.spark, self.folder, self.missing_ok = spark, folder, missing_ok

    def path(self, table: str) -> str:
        return os.path.join(self.folder, f"{table}.parquet")

    def read(self, table: str) -> DataFrame:
        """The table, or an empty one of its schema where it doesn't exist yet."""
        try:
            return self.spark.read.parquet(self.path(table))
        except Exception as e:  # noqa: BLE001
            if table in TABLES and "PATH_NOT_FOUND" in str(e):
                if not self.missing_ok:
                    warnings.warn(f"{self.path(table)} doesn't exist and reads as empty", stacklevel=2)
                return self.spark.createDataFrame([], TABLES[table])
            raise

    def loans(self, *columns: str) -> DataFrame:
        """One row a loan: repeated rows and newer versions, which differ in status only, count once.

        Only the columns asked for are read and compared; of loan_status and its date the earliest is kept.
        """
        return one_per_loan(self.read("loans"), *columns)


def one_per_loan(loans: DataFrame, *columns: str) -> DataFrame:
    cols = list(dict.fromkeys(("loan_number", *(columns or loans.columns))))
    status = [c for c in ("loan_status_date", "loan_status") if c in cols]
    df = loans.where(F.col("loan_number").isNotNull()).select(*cols)
    if not status:
        return df.dropDuplicates(["loan_number"])
    # an aggregate, not a window: combined before the shuffle
    first = F.min_by(F.struct(*[c for c in cols if c != "loan_number"]), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in status]))
    return df.groupBy("loan_number").agg(first.alias("r")).select("loan_number", "r.*").select(*cols)
