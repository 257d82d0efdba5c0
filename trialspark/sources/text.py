"""Delimited-text sources and sinks.

* :func:`read_delimited`  header + separator + ``NA`` marker, explicit schema
  (no inference pass over the data), NaN -> NULL for fractional columns.
* :func:`read_genotype_text` / :func:`write_genotype_text`  wide marker text
  (id column, then one column per marker) <-> ``(Hybrid, array<double>)``;
  the wide matrix never becomes thousands of DataFrame columns.
* :func:`read_vcf_table`  a VCF read as a plain tab table (``##`` meta lines
  dropped, ``#CHROM`` line as the header).
* :func:`write_delimited`  tab sink with header, no quoting, ``NA`` for NULL.
* :func:`write_csv`  comma sink with header (prediction files).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.functions.keys import nan_to_null


def normalize_nan(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every double/float column."""
    return df.select(*[nan_to_null(f"`{f.name}`").cast(f.dataType).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def first_line(spark: SparkSession, path: str) -> str:
    """First line of the first file by name (Spark itself reads files by size); empty if there is none."""
    files = sorted(spark.read.text(path).inputFiles())
    row = spark.read.text(files[0]).first() if files else None
    return row["value"] if row else ""


def detect_separator(spark: SparkSession, path: str, candidates: str = "\t,;") -> str:
    """Separator of a delimited file: the candidate most frequent in its first line.

    Spaces are not candidates (column names may contain them); tab is the default.
    """
    line = first_line(spark, path)
    best = max(candidates, key=line.count)
    return best if line.count(best) else "\t"


def header_columns(spark: SparkSession, path: str, sep: str | None = None) -> tuple[list[str], str]:
    """Column names from the first line (one line read), and the separator used."""
    sep = sep or detect_separator(spark, path)
    line = first_line(spark, path)
    return (line.split(sep) if line else []), sep


def schema_from_header(spark: SparkSession, path: str, strings=(), ints=(),
                       sep: str | None = None) -> tuple[T.StructType, str]:
    """Declared schema for a wide table: named text / integer columns, every other column double.

    Avoids an inference pass over the data for tables with hundreds of measures.
    """
    names, sep = header_columns(spark, path, sep)
    fields = []
    for n in names:
        t = T.StringType() if n in set(strings) else T.IntegerType() if n in set(ints) else T.DoubleType()
        fields.append(T.StructField(n, t, True))
    return T.StructType(fields), sep


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str,
                   sep: str | None = "\t", na: str = "NA", header: bool = True) -> DataFrame:
    """Read delimited text with a declared schema; ``na`` and empty numerics -> NULL.

    ``sep=None`` detects the separator from the first line.
    """
    sep = sep or detect_separator(spark, path)
    df = (spark.read.schema(schema)
          .option("header", header).option("sep", sep).option("nullValue", na)
          .option("nanValue", "NaN").option("mode", "PERMISSIVE")
          .csv(path))
    return normalize_nan(df)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", na: str = "NA",
                    mode: str = "overwrite") -> None:
    """Tab sink: header, no quotes, ``NA`` for NULL (one part file per partition)."""
    (df.write.mode(mode).option("header", True).option("sep", sep)
     .option("nullValue", na).option("emptyValue", "").option("quote", "")
     .option("escapeQuotes", False).csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Comma sink with header (prediction tables)."""
    df.write.mode(mode).option("header", True).csv(path)


def _first_token(sep: str):
    return F.substring_index(F.col("value"), sep, 1)


def read_genotype_text(spark: SparkSession, path: str, sep: str = "\t", na: str = "NA",
                       id_col: str = "Hybrid", value_col: str = "dosage",
                       header_token: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Wide numeric genotype text -> ``(id, array<double>)`` rows and a marker-name table.

    The first line of the first file (by name) is the header unless ``header_token``
    (the header's first field) is given; header lines are recognised by that
    token wherever they occur, so multi-part outputs with one header per part
    read correctly.  Returns (genotypes, markers(i, marker)).
    """
    lines = spark.read.text(path).filter(F.length("value") > 0)
    if header_token is None:
        header_token = first_line(spark, path).partition(sep)[0]
    tok = _first_token(sep)
    parts = F.split(F.col("value"), sep)
    rest = F.slice(parts, 2, F.size(parts) - 1)
    data = lines.filter(tok != F.lit(header_token))
    geno = data.select(
        F.get(parts, 0).alias(id_col),
        F.transform(rest, lambda s: F.when(s == na, F.lit(None).cast("double"))
                    .otherwise(nan_to_null(s.try_cast("double")))).alias(value_col))
    markers = (lines.filter(tok == F.lit(header_token)).limit(1)
               .select(F.posexplode(rest).alias("i", "marker")))
    return geno, markers


def write_genotype_text(geno: DataFrame, markers: DataFrame | list[str], path: str,
                        sep: str = "\t", na: str = "NA", id_col: str = "Hybrid",
                        value_col: str = "dosage", header_token: str = "Hybrid") -> None:
    """``(id, array<double>)`` rows -> wide text, every part file with a header line.

    Nothing is sorted or moved: a row is written where it is, as one text
    column whose name is the header line (the marker names, which the format
    puts on one line, are all the driver holds).  A NULL array gives a row
    with the id alone.
    """
    if not isinstance(markers, list):
        markers = [r["marker"] for r in markers.orderBy("i").collect()]  # one header line
    header = sep.join([header_token, *markers])
    line = F.concat_ws(sep, F.col(id_col), F.array_join(F.transform(
        value_col, lambda x: F.coalesce(x.cast("string"), F.lit(na))), sep))
    (geno.select(line.alias(header)).write.mode("overwrite").option("header", True).option("quote", "")
     .option("sep", "\x01").option("escapeQuotes", False).option("emptyValue", "").csv(path))


def read_vcf_table(spark: SparkSession, path: str) -> DataFrame:
    """VCF as a plain table: columns from the ``#CHROM`` header line, values as text."""
    lines = spark.read.text(path)
    header = lines.filter(F.col("value").startswith("#CHROM")).first()
    names = header["value"].lstrip("#").split("\t") if header else []
    body = lines.filter(~F.col("value").startswith("#"))
    parts = F.split(F.col("value"), "\t")
    return body.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])
