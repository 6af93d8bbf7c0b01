"""Sinks: single text files, Parquet bundles, models. Paths are local ones or URIs of any file system that Spark knows."""

from __future__ import annotations

import csv
import io
import uuid
from pathlib import Path

from pyspark.sql import DataFrame

from varsift.operators.fitness import ErrorModel, NormModel
from varsift.sources import files
from varsift.sources.files import Location


def write_text(df: DataFrame, path: Path | Location | str, sep: str = "\t", null: str = "NA", header: bool = True) -> None:
    """One text file with nulls as NA; a table without rows gives a file without bytes.

    The parts are written by all tasks; only their bytes are joined, in order, whatever their size.
    """
    path = files.locate(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    folder = path.parent / f"_{path.name}-{uuid.uuid4().hex}"
    df.write.option("sep", sep).option("nullValue", null).option("emptyValue", "").option("header", False).option("quote", "").csv(files.uri(folder))
    files.concatenate(folder, path, sep.join(df.columns) + "\n" if header else "")


def write_bundle(tables: dict[str, DataFrame], path: Path | Location | str) -> list[str]:
    """A folder with a Parquet table each; the suffix of path is cut and tables without rows are left out."""
    folder = files.locate(path).with_suffix("")
    folder.mkdir(parents=True, exist_ok=True)
    written = []
    for name, df in tables.items():
        if not df.isEmpty():
            df.write.mode("overwrite").parquet(files.uri(folder / f"{name}.parquet"))
            written.append(name)
    return written


def _write_rows(rows: list[dict], path: Path | Location) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    out = io.StringIO()
    writer = csv.DictWriter(out, rows[0], delimiter="\t", lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    path.write_text(out.getvalue())


def write_models(folder: Path | Location, errors: ErrorModel | None, norm: NormModel | None, suffix: str = "") -> None:
    if errors is not None:
        _write_rows(errors.rows, folder / "errormodel.txt")
    if norm is not None:
        _write_rows([norm.row()], folder / f"normalisationmodel{suffix}.txt")


def write_fitness(tables: dict[str, DataFrame], folder: Path | Location, project: str, coding: bool) -> None:
    """The text reports, the variant-database CSV and the Parquet bundle."""
    for name in ("wildtype", "singles", "doubles"):
        write_text(tables[name], folder / f"fitness_{name}.txt")
    if coding and not tables["synonymous"].isEmpty():
        write_text(tables["synonymous"], folder / "fitness_synonymous.txt")
    if not tables["database"].isEmpty():
        write_text(tables["database"], folder / "fitness_singles_MaveDB.csv", ",", "")
    write_bundle({n: t for n, t in tables.items() if n != "database"}, folder / f"{project}_fitness_replicates.parquet")


def write_enrichment(table: DataFrame, folder: Path | Location, project: str) -> None:
    write_text(table, folder / "enrichment_variant_data.txt")
    write_bundle({"variants": table}, folder / f"{project}_enrichment.parquet")
