"""Delimited records: valid rows as typed values, the others apart with the reason.

Structure is checked on the record's pieces between quotes, all in built-in expressions. Values are cast once for each
distinct value of a column: the distinct values are validated, the invalid ones with their reason form a dictionary,
and the dictionary is joined back to the fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.runtime import small_side, written

# fixed values: the declared types and their forms
INT = r"\A[+-]?[0-9]+\z"
FLOAT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DAY = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z"


def real_day(v: Column) -> Column:
    """Whether the first ten characters, already of the form YYYY-MM-DD, are a day of the calendar."""
    y, m, d = (F.substring(v, a, n).cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last)


def valid(v: Column, dtype: Column) -> Column:
    """Whether a non-empty trimmed value has the declared type; types not known here take anything."""
    digits = F.regexp_replace(v, r"\A([+-]?)0+(?=[0-9])", "$1")
    return (
        F.when(dtype == "int64", v.rlike(INT) & (F.length(digits) <= 20) & digits.try_cast("bigint").isNotNull())
        .when(dtype == "float64", v.rlike(FLOAT))
        .when(dtype == "bool", F.lower(v).isin("true", "false"))
        .when(dtype == "date", F.when(v.rlike(DAY), real_day(v)).otherwise(False))
        .when(dtype == "datetime64", F.when(v.rlike(TIME), real_day(v)).otherwise(False))
        .otherwise(True)
    )


def file_layouts(cards: DataFrame, columns: DataFrame) -> DataFrame:
    """(file_path, dataset_id, delimiter, dtypes, names) of each file; of several cards of a file the newest counts."""
    declared = (
        columns.where("dataset_id is not null")
        .groupBy("dataset_id")
        .agg(F.array_sort(F.collect_set(F.struct("col_pos", F.col("name").alias("n"), F.col("dtype").alias("t")))).alias("c"))
        .select("dataset_id", F.col("c.t").alias("dtypes"), F.col("c.n").alias("names"))
    )
    newest = cards.where("file_path is not null and delimiter is not null").groupBy("file_path").agg(
        F.max_by(F.struct("dataset_id", "delimiter"), F.struct("created_at", "card_id")).alias("f")
    )
    return newest.select("file_path", "f.dataset_id", "f.delimiter").join(declared, "dataset_id", "left")


def split_records(records: DataFrame, layouts: DataFrame) -> DataFrame:
    """Each record after the header with ``fields`` (array, unquoted) and the structural ``reason`` or null.

    A null or blank record has one empty field. Files without a layout are left out; for data sets without declared
    columns only the quoting is checked.
    """
    joined = records.where("line_no > 1").select("file_path", "line_no", F.coalesce("raw_record", F.lit("")).alias("r")).join(
        small_side(layouts, "p5-layouts"), "file_path"
    )
    d = F.col("delimiter")
    cut = F.when(F.length(d) == 1, F.concat(F.lit("\\"), d)).otherwise(F.concat(F.lit("\\Q"), d, F.lit("\\E")))
    rows = joined.withColumn("s", F.split("r", '"', -1))
    n = F.size("s")
    # pieces at even places are outside quotes; an empty one between two quotes is a quote written twice
    outside = F.transform(
        "s",
        lambda x, i: F.when(i % 2 == 1, True)
        .when(n == 1, True)
        .when(x == "", True)
        .when(i == 0, F.endswith(x, d))
        .when(i == n - 1, F.startswith(x, d))
        .otherwise(F.startswith(x, d) & F.endswith(x, d)),
    )
    rows = rows.withColumn("quoted_well", (n % 2 == 1) & F.forall(outside, lambda ok: ok))
    # delimiters inside quotes are written as \u0001b while the record is split, and \u0001 as \u0001a
    mark, hide = F.lit("\x01"), lambda x: F.replace(x, F.lit("\x01"), F.lit("\x01a"))
    joined_up = F.array_join(
        F.transform(
            "s",
            lambda x, i: F.when(i % 2 == 1, F.replace(hide(x), d, F.concat(mark, F.lit("b"))))
            .when((x == "") & (i > 0) & (i < n - 1), F.lit('"'))
            .otherwise(hide(x)),
        ),
        "",
    )
    shown = F.transform(F.split(joined_up, cut, -1), lambda x: F.replace(F.replace(x, F.concat(mark, F.lit("b")), d), F.lit("\x01a"), mark))
    rows = rows.withColumn("fields", F.when(n == 1, F.split("r", cut, -1)).when(F.col("quoted_well"), shown))
    reason = F.when(~F.col("quoted_well"), "quoting").when(F.col("dtypes").isNotNull() & (F.size("fields") != F.size("dtypes")), "column_count")
    return rows.select("file_path", "line_no", "dataset_id", "names", "dtypes", "fields", reason.alias("reason"))


def values_of(split: DataFrame) -> DataFrame:
    """(file_path, line_no, dataset_id, col_pos, dtype, v) of all non-empty values of typed columns in sound records."""
    cells = F.arrays_zip(F.col("fields").alias("v"), F.col("dtypes").alias("t"))
    return (
        split.where("reason is null and dtypes is not null")
        .select("file_path", "line_no", "dataset_id", F.posexplode(cells).alias("col_pos", "c"))
        .select("file_path", "line_no", "dataset_id", "col_pos", F.col("c.t").alias("dtype"), F.trim("c.v").alias("v"))
        .where("v <> '' and dtype <> 'object'")
    )


def invalid_values(split: DataFrame) -> DataFrame:
    """(dataset_id, col_pos, dtype, v): the dictionary of distinct values that don't have their column's type."""
    distinct = values_of(split).select("dataset_id", "col_pos", "dtype", "v").distinct()
    return distinct.where(~valid(F.col("v"), F.col("dtype")))


def failures(records: DataFrame, cards: DataFrame, columns: DataFrame) -> DataFrame:
    """(file_path, line_no, reason) of every record after the header that doesn't parse; the first reason counts.

    Records are split once and written; the dictionary is broadcast where it was counted to be small, else joined by a shuffle. Empty tables give no rows;
    extra columns are not read; a record stored twice under one line number gives one row.
    """
    return _failures(written(split_records(records, file_layouts(cards, columns)), "p5-split"))


def _failures(split: DataFrame) -> DataFrame:
    wrong = small_side(invalid_values(split), "p5-invalid")
    values = values_of(split).join(wrong, ["dataset_id", "col_pos", "dtype", "v"], "left_semi").select("file_path", "line_no", F.lit("value").alias("reason"))
    structure = split.where("reason is not null").select("file_path", "line_no", "reason")
    return structure.union(values).distinct()


def typed_rows(records: DataFrame, cards: DataFrame, columns: DataFrame, dataset_id: str) -> DataFrame:
    """The valid records of one data set as (file_path, line_no, its declared columns with their types).

    Declared names that differ by case only, or that clash with file_path and line_no, get ``_<position>`` appended.
    """
    own = cards.where(F.col("dataset_id") == dataset_id)
    declared = columns.where(F.col("dataset_id") == dataset_id).orderBy("col_pos").collect()  # one row for each column
    spark_type = {"int64": "bigint", "float64": "double", "bool": "boolean", "date": "date", "datetime64": "timestamp_ntz"}
    split = written(split_records(records, file_layouts(own, columns)), "p5-split")
    good = split.where("reason is null").join(_failures(split).select("file_path", "line_no"), ["file_path", "line_no"], "left_anti")
    taken, picks = {"file_path", "line_no"}, []
    for i, c in enumerate(declared):
        name = c["name"] if c["name"].lower() not in taken else f"{c['name']}_{i + 1}"
        taken.add(name.lower())
        value = F.nullif(F.trim(F.get("fields", F.lit(i))), F.lit(""))
        picks.append(value.try_cast(spark_type.get(c["dtype"], "string")).alias(name))
    return good.select("file_path", "line_no", *picks)


def row_counts(records: DataFrame, cards: DataFrame, columns: DataFrame) -> DataFrame:
    """(file_path, claimed, records, failed, row_count) of every file of the cards; claimed is the newest card's."""
    files = cards.where("file_path is not null").groupBy("file_path").agg(F.max_by("row_count", F.struct("created_at", "card_id")).alias("claimed"))
    all_rows = records.where("line_no > 1").groupBy("file_path").agg(F.count_distinct("line_no").alias("records"))
    failed = failures(records, cards, columns).groupBy("file_path").agg(F.count("*").alias("failed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counted = files.join(all_rows, "file_path", "left").join(failed, "file_path", "left").select("file_path", "claimed", zero("records"), zero("failed"))
    return counted.withColumn("row_count", F.col("records") - F.col("failed"))
