"""Where inputs and results of a project lie."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path


def family(run: str) -> str:
    """Which kind of extractor a run's name belongs to."""
    name = run.lower()
    if "regex" in name:
        return "regex"
    return "encoder" if any(k in name for k in ("bert", "encoder", "qa")) else "llm"


@dataclass(frozen=True)
class Paths:
    root: Path

    @classmethod
    def discover(cls, start: str | Path = ".") -> Paths:
        """The nearest folder upwards that holds a pyproject.toml, else the start."""
        start = Path(start).resolve()
        return cls(next((p for p in (start, *start.parents) if (p / "pyproject.toml").exists()), start))

    def predictions(self, run: str) -> Path:
        return self.root / "baselines" / family(run) / f"{run}_predictions.csv"

    def metrics(self, run: str) -> Path:
        return self.root / "results" / "metrics" / f"{run}.csv"

    def slices(self, run: str) -> Path:
        return self.root / "results" / "slices" / f"{run}.csv"

    def splits(self) -> Path:
        return self.root / "data" / "splits"

    def make(self) -> None:
        """The folders that results are written to."""
        for p in (self.splits(), *(self.root / "baselines" / k for k in ("regex", "encoder", "llm")), self.root / "results" / "metrics", self.root / "results" / "slices"):
            p.mkdir(parents=True, exist_ok=True)
