"""Column-level quality profile of Parquet data from footers, dictionaries and, where these don't do, values.

The units of work are row groups, cut further by columns where they are large. A task opens a file once for all its units.
For each column of a row group the footer is asked first. It gives null counts and extrema where the row group holds
one group (load); in a row group of several loads it still rules things out for all of them: no nulls, extrema within the
accepted range, all values below or above a cut, one value only. A column is decoded only for what is left; text columns
come as dictionary and indices, and any column is reduced to distinct values and counts, so patterns, keys and bounds are
tested once for each distinct value. What leaves a task is one small record for each row group, group and column, with the
bytes that were decoded for it, and distinct values where they are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.runtime import written

#: Values for each output record of distinct values.
SLICE = 20_000
#: Compressed bytes of columns for each unit of work.
UNIT = 16 << 20


@dataclass
class ColumnSpec:
    """What to learn of a column: ``cuts`` counts values <= each cut, ``keys`` counts each key and all other values.

    With ``accepted`` (low, high; either may be null) extrema are wanted only as far as they lie outside.
    """

    name: str
    pattern: str | None = None
    cuts: list[float] = field(default_factory=list)
    keys: list[str] | None = None
    distinct: bool = False
    accepted: tuple[float | None, float | None] | None = None


def arrow_path(path: str) -> tuple[pyarrow.fs.FileSystem | None, str]:
    """(file system, path in it) for a path as Spark lists it; none for local paths. ``s3a`` and ``s3n`` are S3 too."""
    if path.startswith("file:"):
        return None, "/" + unquote(path[5:]).lstrip("/")
    if "://" not in path:
        return None, path
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def open_parquet(path: str) -> pq.ParquetFile:
    """The file with its text columns as dictionary and indices; the footer is parsed once."""
    fs, inner = arrow_path(path)
    source = inner if fs is None else fs.open_input_file(inner)
    plain = pq.ParquetFile(source)
    texts = [f.name for f in plain.schema_arrow if pa.types.is_string(f.type) or pa.types.is_large_string(f.type)]
    return pq.ParquetFile(source, metadata=plain.metadata, read_dictionary=texts) if texts else plain


@dataclass
class FooterColumn:
    """What a footer says of one column of one row group."""

    nulls: int | None = None
    low: float | None = None
    high: float | None = None
    constant: object = None


def as_micros(kind: pa.DataType) -> bool:
    """Whether extrema of this type are taken as microseconds."""
    return pa.types.is_timestamp(kind) or pa.types.is_date(kind)


def micros(value: object) -> float:
    """Microseconds since 1970 of a time or day, exact in a double until the year 2255."""
    return float(pa.scalar(value).cast(pa.timestamp("us", tz=getattr(pa.scalar(value).type, "tz", None))).value)


def footer_column(group: pq.RowGroupMetaData, index: dict[str, int], name: str, numeric: bool, times: bool = False) -> FooterColumn:
    if name not in index:
        return FooterColumn(nulls=group.num_rows)
    stats = group.column(index[name]).statistics
    out = FooterColumn()
    if stats is None:
        return out
    if stats.has_null_count:
        out.nulls = stats.null_count
    if stats.has_min_max:
        if stats.min == stats.max and out.nulls == 0:
            out.constant = stats.min
        if numeric:
            low, high = (micros(stats.min), micros(stats.max)) if times else (float(stats.min), float(stats.max))
            if low <= high:  # false for NaN
                out.low, out.high = low, high
    return out


SCHEMA = pa.schema(
    [
        ("grp", pa.int64()), ("name", pa.string()), ("n_rows", pa.int64()), ("nulls", pa.int64()), ("low", pa.float64()), ("high", pa.float64()),
        ("upto", pa.list_(pa.int64())), ("per_key", pa.list_(pa.int64())), ("other", pa.int64()), ("odd", pa.int64()), ("decoded", pa.int64()), ("read_bytes", pa.int64()),
        ("texts", pa.list_(pa.string())), ("numbers", pa.list_(pa.float64())),
    ]
)
SPARK_SCHEMA = """grp bigint, name string, n_rows bigint, nulls bigint, low double, high double, upto array<bigint>, per_key array<bigint>,
    other bigint, odd bigint, decoded bigint, read_bytes bigint, texts array<string>, numbers array<double>"""


def distinct_codes(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct non-null values of a column and each row's index among them, -1 for null."""
    if isinstance(column.type, pa.DictionaryType):
        array = column.unify_dictionaries().combine_chunks()
    else:
        if pa.types.is_floating(column.type):
            column = pc.add(column, pa.scalar(0.0, column.type))  # -0.0 and 0.0 are one value
        array = column.combine_chunks().dictionary_encode()
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    values, at = array.dictionary, np.asarray(array.indices.fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
    unique = values.dictionary_encode()
    if len(unique.dictionary) < len(values):  # a writer may store an entry twice
        at = np.append(np.asarray(unique.indices, np.int64), -1)[at]
        values = unique.dictionary
    return values, at


def text_of(value: object, kind: pa.DataType) -> str:
    """A value as decoded text columns give it."""
    return pa.array([value], kind).cast(pa.string())[0].as_py()


def ruled_out(spec: ColumnSpec, footer: FooterColumn, numeric: bool, kind: pa.DataType) -> dict | None:
    """What the footer alone says of all non-null values of a column in a row group; None if it leaves something open.

    The dict has ``upto`` (for each cut whether values are <= it), ``key`` (the index of the one key all values are, or
    None), ``odd`` and ``texts`` where they can be known.
    """
    constant = footer.constant is not None and not pa.types.is_floating(kind)
    text = text_of(footer.constant, kind) if constant and (spec.keys is not None or spec.pattern or spec.distinct) else None
    out: dict = {"upto": [], "key": None, "odd": False, "texts": None}
    if spec.cuts:
        if not numeric or footer.low is None:
            return None
        for cut in spec.cuts:
            if not footer.high <= cut and not footer.low > cut:
                return None
            out["upto"].append(footer.high <= cut)
    if spec.keys is not None or spec.pattern or spec.distinct:
        if not constant:
            return None
        out["key"] = spec.keys.index(text) if spec.keys and text in spec.keys else None
        out["odd"] = bool(spec.pattern) and re.fullmatch(spec.pattern, text) is None
        out["texts"] = [text] if spec.distinct else None
    return out


def within(spec: ColumnSpec, footer: FooterColumn) -> bool:
    if spec.accepted is None or footer.low is None:
        return False
    low, high = spec.accepted
    return (low is None or footer.low >= low) and (high is None or footer.high <= high)


def profile_row_group(file: pq.ParquetFile, k: int, by: str | None, specs: list[ColumnSpec]) -> Iterator[dict]:
    group, schema = file.metadata.row_group(k), file.schema_arrow
    index = {group.column(i).path_in_schema: i for i in range(group.num_columns)}
    rows = group.num_rows
    if not rows:
        return
    single, codes, groups = True, np.zeros(rows, np.int64), [None]
    if by is not None:
        footer = footer_column(group, index, by, False)
        if footer.constant is not None:
            groups = [footer.constant]
        else:
            values, codes = distinct_codes(file.read_row_group(k, columns=[by]).column(0))
            groups = [*values.to_pylist(), None]
            codes = np.where(codes < 0, len(groups) - 1, codes)
            single = len(np.unique(codes)) == 1
            if single:
                groups, codes = [groups[codes[0]]], np.zeros(rows, np.int64)
    per_group = np.bincount(codes, minlength=len(groups))
    for spec in specs:
        kind = schema.field(spec.name).type if spec.name in index else pa.null()
        if isinstance(kind, pa.DictionaryType):
            kind = kind.value_type
        times = as_micros(kind)
        numeric = pa.types.is_floating(kind) or pa.types.is_integer(kind) or pa.types.is_decimal(kind) or times
        footer = footer_column(group, index, spec.name, numeric, times)
        base = [dict(grp=g, name=spec.name, n_rows=int(n), low=None, high=None, decoded=0, read_bytes=0, other=0, odd=0) for g, n in zip(groups, per_group)]
        known = ruled_out(spec, footer, numeric, kind)
        if footer.nulls == rows:
            for b in base:
                b |= dict(nulls=b["n_rows"], upto=[0] * len(spec.cuts), per_key=[0] * len(spec.keys or []))
        elif (
            known is not None
            and (footer.nulls == 0 or single and footer.nulls is not None)
            and (not numeric or single and footer.low is not None or within(spec, footer))
        ):
            for b in base:
                n = b["n_rows"] - footer.nulls
                per_key = [n * (i == known["key"]) for i in range(len(spec.keys or []))]
                b |= dict(nulls=footer.nulls, low=footer.low, high=footer.high, upto=[n * u for u in known["upto"]], per_key=per_key)
                b |= dict(other=n * (spec.keys is not None and known["key"] is None), odd=n * known["odd"])
                if known["texts"] and b["n_rows"]:
                    yield dict(grp=b["grp"], name=spec.name, texts=known["texts"])
        else:
            yield from _decoded(file, k, spec, numeric, codes, base)
            size = group.column(index[spec.name]).total_compressed_size if spec.name in index else 0
            next(b for b in base if b["n_rows"]).update(decoded=1, read_bytes=size)
        yield from (b for b in base if b["n_rows"])


def _decoded(file: pq.ParquetFile, k: int, spec: ColumnSpec, numeric: bool, codes: np.ndarray, base: list[dict]) -> Iterator[dict]:
    values, at = distinct_codes(file.read_row_group(k, columns=[spec.name]).column(0))
    present = at >= 0
    pair, count = np.unique(codes[present] * max(1, len(values)) + at[present], return_counts=True)
    of_group, of_value = pair // max(1, len(values)), pair % max(1, len(values))
    total = lambda keep: np.bincount(of_group[keep], weights=count[keep], minlength=len(base)).astype(np.int64)
    nulls = np.array([b["n_rows"] for b in base]) - total(np.ones(len(pair), bool))
    if numeric and as_micros(values.type):
        numbers = np.asarray(values.cast(pa.timestamp("us", tz=getattr(values.type, "tz", None)), safe=False).cast(pa.int64()), np.float64)
    else:
        numbers = np.asarray(values.cast(pa.float64()), np.float64) if numeric else np.zeros(0)
    texts = None if numeric else values.cast(pa.string()).to_pylist()
    if numeric:
        low, high = np.full(len(base), np.inf), np.full(len(base), -np.inf)
        real = ~np.isnan(numbers[of_value])
        np.minimum.at(low, of_group[real], numbers[of_value][real])
        np.maximum.at(high, of_group[real], numbers[of_value][real])
    if spec.cuts:
        upto = np.stack([total(numbers[of_value] <= cut) for cut in spec.cuts]) if numeric else np.zeros((len(spec.cuts), len(base)), np.int64)
    if spec.keys is not None:
        found = {v: i for i, v in enumerate(values.cast(pa.string()).to_pylist() if texts is None else texts)}
        per_key = np.stack([total(of_value == found.get(key, -1)) for key in spec.keys]) if spec.keys else np.zeros((0, len(base)), np.int64)
        other = total(np.ones(len(pair), bool)) - per_key.sum(axis=0)
    if spec.pattern:
        full = re.compile(spec.pattern).fullmatch
        odd_value = np.fromiter((full(v) is None for v in (texts if texts is not None else map(str, values.to_pylist()))), bool, len(values))
        odd = total(odd_value[of_value])
    for g, b in enumerate(base):
        b |= dict(nulls=int(nulls[g]))
        if numeric and low[g] <= high[g]:
            b |= dict(low=float(low[g]), high=float(high[g]))
        b["upto"] = upto[:, g].tolist() if spec.cuts else []
        b["per_key"] = per_key[:, g].tolist() if spec.keys is not None else []
        b["other"] = int(other[g]) if spec.keys is not None else 0
        b["odd"] = int(odd[g]) if spec.pattern else 0
    if spec.distinct:
        starts = np.searchsorted(of_group, np.arange(len(base) + 1))
        for g, b in enumerate(base):
            own = of_value[starts[g] : starts[g + 1]]
            for i in range(0, len(own), SLICE):
                part = own[i : i + SLICE]
                yield dict(grp=b["grp"], name=spec.name, numbers=numbers[part].tolist()) if numeric and pa.types.is_floating(values.type) else dict(
                    grp=b["grp"], name=spec.name, texts=values.take(pa.array(part)).cast(pa.string()).to_pylist()
                )


def units_of(file: pq.ParquetFile, specs: list[ColumnSpec], size: int = UNIT) -> list[tuple[int, list[int]]]:
    """(row group, places of its specs): the columns of a row group in units of about ``size`` compressed bytes."""
    out = []
    for k in range(file.metadata.num_row_groups):
        group = file.metadata.row_group(k)
        sizes = {group.column(i).path_in_schema: group.column(i).total_compressed_size for i in range(group.num_columns)}
        own: list[int] = []
        held = 0
        for at, spec in enumerate(specs):
            if own and held + sizes.get(spec.name, 0) > size:
                out.append((k, own))
                own, held = [], 0
            own.append(at)
            held += sizes.get(spec.name, 0)
        out.append((k, own))
    return out


def row_group_records(spark: SparkSession, path: str, by: str | None, specs: list[ColumnSpec], size: int = UNIT) -> DataFrame:
    """One record for each row group, group and column (and slices of distinct values), lazily."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # a listing: contents aren't read
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, int(total // (64 << 20)) + 1)

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                units = units_of(open_parquet(p), specs, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * len(units), pa.string()), pa.array([k for k, _ in units], pa.int32()), pa.array([own for _, own in units], pa.list_(pa.int32()))], names=["path", "k", "own"]
                )

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for batch in batches:
            for p, k, own in zip(*(c.to_pylist() for c in batch.columns)):
                if p != at:
                    at, file = p, open_parquet(p)
                rows = list(profile_row_group(file, k, by, [specs[i] for i in own]))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    units = files.mapInArrow(footers, "path string, k int, own array<int>")
    return units.repartition(tasks, "path", "k", "own").sortWithinPartitions("path", "k").mapInArrow(profile, SPARK_SCHEMA)


def profile_columns(spark: SparkSession, path: str, by: str | None, specs: list[ColumnSpec]) -> DataFrame:
    """(grp, name, n_rows, nulls, low, high, upto, per_key, other, odd, decoded, read_bytes, n_unique) for each group and column.

    ``decoded`` and ``read_bytes`` are the column chunks that footers didn't do for and their compressed bytes, each counted
    for one of the groups it holds.

    ``low`` and ``high`` are of numbers without NaN and of times in microseconds since 1970, null for other types and where all is null; ``n_unique`` counts
    distinct non-null values where asked for, else it is null; rows with a null group form the group null; a column
    that a file lacks is null in its rows; repeated rows count as often as they are stored; no rows, no result.
    """
    records = written(row_group_records(spark, path, by, specs), "p4-records")
    cuts, keys = max(len(s.cuts) for s in specs), max(len(s.keys or []) for s in specs)
    stats = (
        records.where("n_rows is not null")
        .groupBy("grp", "name")
        .agg(
            *(F.sum(c).alias(c) for c in ("n_rows", "nulls", "other", "odd", "decoded", "read_bytes")), F.min("low").alias("low"), F.max("high").alias("high"),
            F.array(*(F.sum(F.get("upto", F.lit(i))) for i in range(cuts))).cast("array<bigint>").alias("upto"),
            F.array(*(F.sum(F.get("per_key", F.lit(i))) for i in range(keys))).cast("array<bigint>").alias("per_key"),
        )
    )
    if not any(s.distinct for s in specs):
        return stats.withColumn("n_unique", F.lit(None).cast("long"))
    names = [x.name for x in specs if x.distinct]
    slices = records.where("n_rows is null")
    each = slices.where("texts is not null").select("grp", "name", F.explode("texts").alias("t"), F.lit(None).cast("double").alias("d")).union(
        slices.where("numbers is not null").select("grp", "name", F.lit(None).cast("string").alias("t"), F.explode("numbers").alias("d"))
    )
    unique = each.distinct().groupBy("grp", "name").agg(F.count("*").alias("u"))
    s, u = stats.alias("s"), unique.alias("u")
    joined = s.join(u, F.col("s.grp").eqNullSafe(F.col("u.grp")) & (F.col("s.name") == F.col("u.name")), "left")
    return joined.select("s.*", F.when(F.col("s.name").isin(names), F.coalesce("u.u", F.lit(0))).alias("n_unique"))
