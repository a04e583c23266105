"""The lake: data set ids, where their files are, and how they are read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.runtime import bytes_of, files_under

FORMATS = {".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".orc": "orc", ".json": "json", ".jsonl": "json"}


DELIMITERS = (",", ";", "\t", "|")


def _outside(text: Column) -> Column:
    """The text without its quoted parts."""
    return F.regexp_replace(text, r'"(?:[^"]|"")*"', "")


def sniff(spark: SparkSession, path: str) -> dict[str, str]:
    """CSV options of a file from all its lines, in one pass of built-in expressions.

    The delimiter is the one that most lines hold as often as the first line does, then the one held most often; a first
    line of numbers is no header; ``multiLine``, which makes a file one task, is set only where some line leaves a quote
    open. The file may be on any file system; an empty one has the defaults.
    """
    lines = spark.read.text(path)
    first = lines.where(F.length(F.trim("value")) > 0).first()
    options = {"header": "true", "sep": ",", "multiLine": "false", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if first is None:
        return options
    plain = re.sub(r'"(?:[^"]|"")*"', "", first[0])
    often = {d: plain.count(d) for d in DELIMITERS}
    count = lambda d: F.length(F.col("p")) - F.length(F.replace(F.col("p"), F.lit(d)))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    seen = lines.select("value", _outside(F.col("value")).alias("p")).agg(
        F.max(quotes % 2).alias("open"), *(F.count_if(count(d) == n).alias(f"d{i}") for i, (d, n) in enumerate(often.items()))
    ).first()
    ranked = sorted((n > 0, seen[f"d{i}"], n, -i) for i, n in enumerate(often.values()))
    options["sep"] = DELIMITERS[-ranked[-1][3]]
    options["multiLine"] = str(bool(seen["open"])).lower()
    fields = [f.strip().strip('"') for f in first[0].split(options["sep"])]
    options["header"] = str(not fields or not all(re.fullmatch(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", f) for f in fields)).lower()
    return options


@dataclass
class Catalog:
    """Data sets by id. A schema is inferred once and kept, so later scans don't read the data twice."""

    spark: SparkSession
    paths: dict[str, str] = field(default_factory=dict)
    schemas: dict[str, T.StructType] = field(default_factory=dict)
    root: str | None = None
    options: dict[str, dict[str, str]] = field(default_factory=dict)

    @classmethod
    def of_lake(cls, spark: SparkSession, root: str, recursive: bool = True) -> Catalog:
        """All files under ``root``, on any file system, of a known format; the first path in sorted order wins a name held twice.

        A folder with the name of a format, such as ``t.parquet``, is one data set.
        """
        base = root if "://" in root or root.startswith("file:") else str(Path(root).resolve())
        inner = base.split("://", 1)[-1].removeprefix("file:").strip("/")
        found: dict[str, str] = {}
        for full in files_under(spark, base, True):
            at = full.find(inner) + len(inner)
            parts = full[at:].strip("/").split("/")
            k = next((i for i, part in enumerate(parts) if PurePosixPath(part).suffix in FORMATS), None)
            if k is None or any(part.startswith(("_", ".")) for part in parts[: k + 1]) or not recursive and k > 0:
                continue
            path = full[:at].rstrip("/") + "/" + "/".join(parts[: k + 1])
            found.setdefault(PurePosixPath(parts[k]).stem, path.removeprefix("file:") if "://" not in base and not base.startswith("file:") else path)
        return cls(spark, dict(sorted(found.items())), root=base)

    def resolve(self, dataset: str) -> str:
        """The path of an id, of a file name, or of a path within the lake; anything else is refused."""
        if dataset in self.paths:
            return self.paths[dataset]
        path = PurePosixPath(dataset)
        if self.root and path.is_absolute():
            real = Path(dataset).resolve()
            if real.is_relative_to(self.root) and real.exists():
                return str(real)
        if path.stem in self.paths and (not path.is_absolute() or self.root is None):
            return self.paths[path.stem]
        raise KeyError(f"no data set {dataset!r} in this lake")

    def options_of(self, dataset: str, path: str) -> dict[str, str]:
        if dataset not in self.options:
            self.options[dataset] = sniff(self.spark, path)
        return self.options[dataset]

    def sample(self, dataset: str, size: int = 256 << 20, files: int = 4) -> tuple[DataFrame, float]:
        """(some rows of a data set, the share of its bytes they come from): all of a small one, else some files spread over it."""
        df = self.scan(dataset)
        if bytes_of(df) <= size:
            return df, 1.0
        every = sorted(df.inputFiles())
        if len(every) <= files:
            return df, 1.0
        some = [every[i * len(every) // files] for i in range(files)]
        kind = FORMATS.get(PurePosixPath(self.resolve(dataset)).suffix, "parquet")
        reader = self.spark.read.format(kind).schema(df.schema)
        if kind == "csv":
            reader = reader.options(**self.options_of(dataset, self.resolve(dataset)))
        return reader.load(some), files / len(every)

    def scan(self, dataset: str) -> DataFrame:
        path = self.resolve(dataset)
        kind = FORMATS.get(PurePosixPath(path).suffix, "parquet")
        reader = self.spark.read.format(kind)
        if kind == "csv":
            reader = reader.options(**self.options_of(dataset, path))
            if dataset not in self.schemas:
                reader = reader.option("inferSchema", "true")
        if dataset in self.schemas:
            reader = reader.schema(self.schemas[dataset])
        df = reader.load(path)
        self.schemas.setdefault(dataset, df.schema)
        return df

    def download(self, dataset: str, path: str, rows: int = 5000) -> None:
        """The first rows of a data set as one CSV file with a header."""
        self.scan(dataset).limit(rows).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)

    def __iter__(self):
        return iter(sorted(self.paths))
