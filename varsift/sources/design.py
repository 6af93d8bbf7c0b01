"""Experiment designs and the small side files of a run, read on the driver (a row a sample: tiny)."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass, field
from pathlib import Path

NUMBERS = ("experiment_replicate", "experiment", "selection_id", "selection_replicate", "biological_replicate", "technical_replicate")
MEASURES = ("generations", "cell_density", "selection_time")


def read_tsv(path: Path | str) -> list[dict[str, str | None]]:
    """Rows of a tab-separated file with any line ends; empty fields and NA are null."""
    text = Path(path).read_bytes().decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")
    rows = csv.DictReader(io.StringIO(text), delimiter="\t")
    return [{k: None if v in (None, "", "NA") else v for k, v in row.items() if k is not None} for row in rows]


def _number(value: str | None) -> int | str | None:
    try:
        return None if value is None else int(float(value))
    except ValueError:
        return value


@dataclass
class ExperimentDesign:
    """Samples with their replicate structure."""

    rows: list[dict] = field(default_factory=list)

    @classmethod
    def read(cls, path: Path | str, count_path: Path | None = None, fastq_file_dir: Path | None = None, allow_pair_duplicates: bool = False) -> ExperimentDesign:
        rows = [dict(r) for r in read_tsv(path) if r.get("sample_name", "") is not None]
        for row in rows:
            for new, old in (("experiment_replicate", "experiment"), ("selection_replicate", "biological_replicate")):
                if new not in row and old in row:
                    row[new] = row[old]
                if new in row:
                    row.setdefault(old, row[new])
            for name in MEASURES:
                row[name] = None if row.get(name) is None else float(row[name])
            for name in NUMBERS:
                if name in row:
                    row[name] = _number(row[name])
            if fastq_file_dir is not None:
                row["pair_directory"] = str(fastq_file_dir)
            if count_path is not None:
                row |= {name: None for name in ("technical_replicate", "pair1", "pair2") if name in row}
        design = cls(rows)
        design.check(allow_pair_duplicates)
        return design

    def check(self, allow_pair_duplicates: bool = False) -> None:
        names = set().union(*self.rows) if self.rows else set()
        if missing := [c for c in ("sample_name", "experiment_replicate", "selection_id") if c not in names]:
            raise ValueError(f"columns missing from the experiment design: {missing}")
        if odd := {r["selection_id"] for r in self.rows} - {0, 1}:
            raise ValueError(f"selection_id must be 0 (input) or 1 (output), found {sorted(map(str, odd))}")
        pairs = [(r.get("pair1"), r.get("pair2")) for r in self.rows if r.get("pair1") is not None]
        if not allow_pair_duplicates and len(set(pairs)) < len(pairs):
            raise ValueError("the experiment design repeats a pair of FASTQ files; set experiment_design_pair_duplicates to allow it")

    @property
    def replicates(self) -> list[int]:
        return sorted({r["experiment"] for r in self.rows})

    def retained(self, which: str) -> list[int]:
        """The replicates of a run: all, or those listed."""
        if which == "all":
            return self.replicates
        return [r for r in self.replicates if r in {int(x) for x in which.split(",")}]

    @property
    def sample_names(self) -> list[str]:
        return [r["sample_name"] for r in self.rows]

    def samples(self, replicate: int, selection: int) -> list[str]:
        """Distinct sample names of a replicate's inputs (0) or outputs (1), in order."""
        return list(dict.fromkeys(r["sample_name"] for r in self.rows if r["experiment"] == replicate and r["selection_id"] == selection))

    def input_sample(self, replicate: int) -> str:
        """The first input of a replicate; later ones aren't used."""
        if not (found := self.samples(replicate, 0)):
            raise ValueError(f"no input sample for replicate {replicate}")
        return found[0]

    def output_samples(self, replicate: int) -> list[str]:
        return self.samples(replicate, 1)

    def internal_name(self, sample: str) -> str:
        for r in self.rows:
            if r["sample_name"] == sample:
                b = r.get("biological_replicate")
                return f"{sample}_e{r['experiment']}_s{r['selection_id']}_b{'NA' if b is None else b}_tNA_count"
        raise KeyError(sample)

    def sample_code(self, row: dict) -> str:
        """Prefix of a sample's files."""
        b, t = (row.get(k) for k in ("biological_replicate", "technical_replicate"))
        return f"{row['sample_name']}_e{row['experiment']}_s{row['selection_id']}_b{'NA' if b is None else b}_t{'NA' if t is None else t}"

    def mean(self, name: str, selection: int) -> dict[int, float]:
        """Mean of a measure over a replicate's inputs or outputs where it is known."""
        found: dict[int, list[float]] = {}
        for r in self.rows:
            if r["selection_id"] == selection and r.get(name) is not None:
                found.setdefault(r["experiment"], []).append(r[name])
        return {e: sum(v) / len(v) for e, v in found.items()}

    def has_generations(self) -> bool:
        return all(r.get("generations") is not None for r in self.rows if r["selection_id"] == 1)

    def has_growth_data(self) -> bool:
        outputs = [r for r in self.rows if r["selection_id"] == 1]
        inputs = [r for r in self.rows if r["selection_id"] == 0]
        return bool(outputs) and all(r.get(k) is not None for r in outputs for k in ("cell_density", "selection_time")) and all(r.get("cell_density") is not None for r in inputs)


def read_barcode_design(path: Path | str) -> list[dict[str, str | None]]:
    """Rows of a barcode design; a single column `barcode` stands for barcode1."""
    rows = read_tsv(path)
    return [r | {"barcode1": r.get("barcode1") or r.get("barcode"), "barcode2": r.get("barcode2") or r.get("barcode")} for r in rows]


def read_synonyms(path: Path | str) -> list[str]:
    return [s for line in Path(path).read_text().splitlines() if (s := line.strip().lower())]
