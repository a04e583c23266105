"""Data set cards and the column index, built from profiles.

One pure function makes a card or an index entry; it runs on the driver for a lake whose profiles fit there, and over
the profile table otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lakelens.functions import lexicon
from lakelens.functions.similarity import Encode, vector
from lakelens.functions.types import DIMENSION, MEASURE, TIME

# fixed values: how many entities and sample words a card and an entry hold
ENTITIES, WORDS = 10, 5

CARD = """dataset_id string, domain string, row_count bigint, column_names array<string>, measure_columns array<string>,
    dimension_columns array<string>, time_columns array<string>, entities array<string>, summary string, summary_embedding array<double>"""
ENTRY = """dataset_id string, name string, lexical_key string, aliases array<string>, dtype string, role string, unique_rate double,
    n_unique bigint, embedding array<double>"""
NEEDED = ["dataset_id", "name", "dtype", "n_rows", "unique_rate", "n_unique", "inferred_role", "top_values"]


def card_of(rows: list[dict], encode: Encode = vector) -> dict:
    """The card of one data set from the profiles of its columns."""
    names = sorted(r["name"] for r in rows)
    of_role = lambda role: sorted(r["name"] for r in rows if r["inferred_role"] == role)
    measures, dimensions, times = of_role(MEASURE), of_role(DIMENSION), of_role(TIME)
    dataset, domain = rows[0]["dataset_id"], lexicon.domain_of(names)
    entities = list(dict.fromkeys(re.sub(r"(_id|_name)$", "", d.lower()) for d in dimensions))[:ENTITIES]
    summary = f"{dataset} is a {domain} data set; measures: {', '.join(measures)}; dimensions: {', '.join(dimensions)}; time: {', '.join(times)}"
    return {
        "dataset_id": dataset, "domain": domain, "row_count": int(max(r["n_rows"] for r in rows)), "column_names": names, "measure_columns": measures,
        "dimension_columns": dimensions, "time_columns": times, "entities": entities, "summary": summary, "summary_embedding": encode(summary),
    }


def entry_of(r: dict, encode: Encode = vector, more: Callable[[str], list[str]] | None = None) -> dict:
    """The index entry of one column; ``more`` adds aliases."""
    key, known = r["name"].lower().strip(), lexicon.aliases(r["name"], more)
    values = " ".join(str(v) for v in list(r["top_values"] if r["top_values"] is not None else [])[:WORDS])
    text = " | ".join([key, " ".join(known[:WORDS]), f"role={r['inferred_role']}", f"type={r['dtype']}", f"values: {values}"])
    return {
        "dataset_id": r["dataset_id"], "name": r["name"], "lexical_key": key, "aliases": known, "dtype": r["dtype"], "role": r["inferred_role"],
        "unique_rate": float(r["unique_rate"]), "n_unique": int(r["n_unique"]), "embedding": encode(text),
    }


def _columns(schema: str) -> list[str]:
    return [p.split()[0] for p in schema.split(",")]


def dataset_cards(profiles: DataFrame, encode: Encode = vector) -> DataFrame:
    """The cards of all data sets; a group is the columns of one data set."""
    return profiles.select(*NEEDED).groupBy("dataset_id").applyInPandas(lambda g: pd.DataFrame([card_of(g.to_dict("records"), encode)], columns=_columns(CARD)), CARD)


def column_index(profiles: DataFrame, encode: Encode = vector, more: Callable[[str], list[str]] | None = None) -> DataFrame:
    """The index entries of all columns."""

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([entry_of(r, encode, more) for r in frame.to_dict("records")], columns=_columns(ENTRY))

    return profiles.select(*NEEDED).mapInPandas(entries, ENTRY)
