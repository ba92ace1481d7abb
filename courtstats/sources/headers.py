"""Text tables whose header is in the data.

A file's first record names its columns.  Files of one load may have their columns in
different orders, lack some or have others, repeat the header between their rows, and
have names of several lines (the first line counts).  All files are read in one scan as
cells; the header of each file comes from its own first record, and a column of the
result is the cell under its name.  Which file a row is from is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_COLUMNS = 200
#: headers of more files than this are joined, not broadcast
MAX_BROADCAST_FILES = 100_000


def clean_name(c: Column) -> Column:
    """A column name as in ``clean_names``, of the text before the first line break."""
    s = F.split(c, r"[\r\n]")[0]
    s = F.regexp_replace(F.replace(s, F.lit("%"), F.lit("_percent_")), "([a-z])([A-Z])", "$1_$2")
    s = F.lower(F.btrim(F.regexp_replace(s, "[^0-9A-Za-z]+", "_"), F.lit("_")))
    return F.when(s == "", "x").when(s.rlike("^[0-9]"), F.concat(F.lit("x"), s)).otherwise(s)


def _numbered(names: Column) -> Column:
    """Repeated names get _2, _3 ..."""
    def one(n, i):
        k = F.size(F.filter(F.slice(names, F.lit(1), i + 1), lambda x: x == n))
        return F.when(k > 1, F.concat(n, F.lit("_"), k.cast("string"))).otherwise(n)
    return F.transform(names, one)


def _small(df: DataFrame, cells: DataFrame) -> DataFrame:
    """A table of a row per file of ``cells``: broadcast, unless there are very many files."""
    return F.broadcast(df) if len(cells.inputFiles()) <= MAX_BROADCAST_FILES else df


def headers(cells: DataFrame) -> DataFrame:
    """One row per file: _file, _head (cells of the first record), _names.

    The number of a file's first record is found first, from numbers alone; then that
    record's cells are read.  No other record is sorted, kept or moved for it."""
    first = cells.groupBy("_file", "_block").agg(F.min("_at").alias("_at")).groupBy("_file").agg(F.min_by("_at", "_block").alias("_at"))
    first = cells.select("_file", "_at", F.col("_cells").alias("_head")).join(_small(first.select("_at"), cells), "_at")
    first = first.groupBy("_file").agg(F.any_value("_head").alias("_head"))  # one row each; below it no check of a header can move
    first = first.withColumn("_clean", F.transform("_head", clean_name))
    return first.select("_file", "_head", _numbered(F.col("_clean")).alias("_names"))


def read_cells(spark: SparkSession, paths, multi_line: bool = True, null_value: str = "NA", max_columns: int = MAX_COLUMNS) -> DataFrame:
    """Every record as an array of cells, with its file and its place in it.  With
    ``multi_line`` (cells may hold line breaks) a file is read by one task."""
    # The last column is never read.  Spark parses a selection of columns without a look at how many a record
    # has; with all of them selected, it raises and catches an error for every cell that a record lacks.  All the
    # others are in the test below, so that every scan reads the same ones and numbers the records alike.
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(max_columns + 2)])
    raw = (spark.read.schema(schema).option("header", False).option("multiLine", multi_line).option("quote", '"')
           .option("escape", '"').option("nullValue", null_value).option("columnPruning", True).csv(paths))
    over = F.when(F.col(f"_c{max_columns}").isNotNull(), F.raise_error(F.concat(
        F.lit(f"more than {max_columns} columns in "), F.col("_metadata.file_path"), F.lit(": "),
        F.concat_ws(",", *[F.col(f"_c{i}") for i in range(max_columns)]))).cast("boolean")).otherwise(True)
    d = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_at"), F.array(*[F.col(f"_c{i}") for i in range(max_columns)]).alias("_cells"),
                   over.alias("_fits"))
    return d.filter("_fits").drop("_fits")


def read_headed(spark: SparkSession, paths, columns: T.StructType, optional=(), ignore=None, multi_line: bool = True,
                null_value: str = "NA", lineage: str = "source_file", max_columns: int = MAX_COLUMNS) -> DataFrame:
    """The columns of ``columns`` (names as ``clean_name`` gives them), typed, and ``lineage``.

    A file without a column raises, but for ``optional`` ones (NULL there).  Names that are
    neither in ``columns`` nor in ``ignore`` raise; ``ignore=None`` lets any other column pass
    unread.  A value that does not fit its type raises.  The missing-value token and empty
    cells are NULL.  A file without a record gives no rows."""
    cells = read_cells(spark, paths, multi_line, null_value, max_columns)
    heads = headers(cells)
    wanted = [f.name for f in columns.fields]
    need = [n for n in wanted if n not in set(optional)]
    lack = F.array_except(F.array(*[F.lit(n) for n in need]).cast("array<string>"), F.coalesce("_names", F.array().cast("array<string>")))
    bad = F.size(lack) > 0
    said = F.concat(F.lit("columns missing: "), F.array_join(lack, ", "))
    if ignore is not None:
        other = F.array_except(F.array_compact("_names"), F.array(*[F.lit(n) for n in [*wanted, *ignore]]).cast("array<string>"))
        bad = bad | (F.size(other) > 0)
        said = F.concat(said, F.lit("; unknown: "), F.array_join(other, ", "))
    heads = heads.filter(F.when(bad, F.raise_error(F.concat(said, F.lit(" in "), F.col("_file"))).cast("boolean")).otherwise(True))
    # where a file has each column (-1: nowhere) is found once per file
    heads = heads.select("_file", "_head", *[(F.array_position("_names", F.lit(n)) - 1).cast("int").alias(f"_at{i}") for i, n in enumerate(wanted)])
    d = cells.drop("_at").join(_small(heads, cells), "_file").filter(~F.col("_cells").eqNullSafe(F.col("_head")))
    at = [F.nullif(F.get("_cells", F.col(f"_at{i}")), F.lit("")) for i in range(len(wanted))]
    return d.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(at, columns.fields)], F.col("_file").alias(lineage))
