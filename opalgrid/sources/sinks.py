"""Results to files: CSV that a spreadsheet can't take for formulas, and JSON snapshots."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def escaped(df: DataFrame) -> DataFrame:
    """Text that begins like a formula gets an apostrophe; numbers stay."""
    return df.withColumns({c: F.when(F.col(f"`{c}`").rlike(r"(?U)^\s*[=+@-]"), F.concat(F.lit("'"), F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")) for c, t in df.dtypes if t == "string"})


def write_csv(df: DataFrame, path: str, escape: bool = False) -> None:
    """A directory of CSV files with header."""
    (escaped(df) if escape else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_report(outputs: dict[str, DataFrame], folder: str, escape: bool = True) -> list[str]:
    """One CSV file for each output table. They are reports of a few rows, fetched one after the other."""
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    for old in to.glob("*.csv"):
        old.unlink()
    for name, df in outputs.items():
        with (to / f"{name}.csv").open("w", newline="", encoding="utf-8") as f:
            w = csv.writer(f)
            w.writerow(df.columns)
            w.writerows((escaped(df) if escape else df).toLocalIterator())
    return sorted(outputs)


def write_snapshots(documents: dict[str, dict], folder: str) -> None:
    """JSON documents, indented, UTF-8; documents of earlier runs go first."""
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    for old in to.glob("*.json"):
        old.unlink()
    for name, doc in documents.items():
        (to / f"{name}.json").write_text(json.dumps(doc, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
