"""Matrices and vectors as comma-separated text, one row per line, and as ``(i, j, value)`` tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.sources.corpus import read_lines

# A comma follows every value, so lines end with one; values have six decimals.
VALUE_SEPARATOR = ","
VALUE_FORMAT = "%.6f"


@F.arrow_udf(T.StringType())
def _written(rows: pa.Array) -> pa.Array:
    """The numbers of every row as text with commas between. Python rounds the exact value of a number, as C does;
    the JVM rounds its shortest decimals, and halves always up."""
    return pa.array([VALUE_SEPARATOR.join([VALUE_FORMAT % x for x in row]) for row in rows.to_pylist()], pa.string())


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(i, j, value)`` of a matrix file; line and column positions start at zero."""
    return parse_matrix_lines(read_lines(spark, path).withColumnRenamed("doc_id", "i"))


def parse_matrix_lines(lines: DataFrame) -> DataFrame:
    """``(i, j, value)`` of ``(i, line)``; the empty piece after a trailing comma is not a column.

    An empty piece elsewhere is a cell without a value: it keeps its column and has no row.
    """
    cells = lines.select("i", F.posexplode(F.split(F.col("line"), VALUE_SEPARATOR)).alias("j", "text"))
    filled = cells.where(F.trim("text") != "")
    return filled.select("i", F.col("j").cast("bigint").alias("j"), F.trim("text").cast("double").alias("value"))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """``(i, value)`` of a file with one value per line."""
    return read_lines(spark, path).select(F.col("doc_id").alias("i"), F.trim("line").cast("double").alias("value"))


def matrix_shape(matrix: DataFrame) -> DataFrame:
    """One row ``(num_rows, num_cols)``."""
    last = lambda c: F.coalesce(F.max(c), F.lit(-1)) + 1
    return matrix.agg(last("i").alias("num_rows"), last("j").alias("num_cols"))


def matrix_lines(matrix: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """``(i, line)`` of a matrix: every row's values in column order, a comma after each.

    Absent cells are zero, absent rows are rows of zeros; without ``shape`` the matrix ends at its last
    row and column. Cells outside of it are an error when the lines are computed. A line is one row of the matrix, K or another model-sized number of values; documents
    are rows.
    """
    rows, columns = shape or matrix_shape(matrix).first()
    inside = (F.col("i") >= 0) & (F.col("i") < rows) & (F.col("j") >= 0) & (F.col("j") < columns)
    matrix = matrix.select("i", "j", _only(inside, "a cell lies outside of the matrix").alias("value"))
    cells = matrix.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "value"))).alias("cells"))
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(columns - 1).cast("bigint"))
    values = F.transform(places, lambda j: F.coalesce(F.try_element_at("cells", j), F.lit(0.0)))
    line = F.concat(_written(values), F.lit(VALUE_SEPARATOR)) if columns else F.lit("")
    every = matrix.sparkSession.range(rows).withColumnRenamed("id", "i")
    return every.join(cells, "i", "left").select("i", line.alias("line"))


def _only(inside: Column, message: str) -> Column:
    """The value of a cell that is inside; an error for any other."""
    return F.when(inside, F.col("value")).otherwise(F.raise_error(F.lit(message)).cast("double"))


def write_matrix(matrix: DataFrame, path: str, shape: tuple[int, int] | None = None) -> None:
    matrix_lines(matrix, shape).orderBy("i").select("line").write.mode("overwrite").text(path)


def write_vector(vector: DataFrame, path: str, size: int | None = None) -> None:
    """One value per line; absent places are zero, places outside are an error."""
    if size is None:
        size = vector.agg(F.coalesce(F.max("i"), F.lit(-1)) + 1).first()[0]
    inside = (F.col("i") >= 0) & (F.col("i") < size)
    # a full join, so that no place is left out before it is checked
    values = vector.select("i", "value").join(vector.sparkSession.range(size).withColumnRenamed("id", "i"), "i", "full")
    every = values.select("i", _only(inside, "a place lies outside of the vector").alias("value"))
    text = _written(F.array(F.coalesce("value", F.lit(0.0)))).alias("line")
    every.orderBy("i").select(text).write.mode("overwrite").text(path)


def array_matrix(table: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """An array column as ``(i, j, value)``."""
    cells = table.select(F.col(id_col).alias("i"), F.posexplode(array_col).alias("j", "value"))
    return cells.select("i", F.col("j").cast("bigint").alias("j"), F.col("value").cast("double").alias("value"))
