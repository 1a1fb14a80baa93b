"""Where an application keeps its tables: a settings object, from the environment where that says so."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Folders of inputs, models and reports, feature tables and answers, and shuffle partitions (0: the session's own)."""

    data: str = "data"
    artifacts: str = "artifacts"
    features: str = "features"
    output: str = "output"
    partitions: int = 0

    @classmethod
    def from_environment(cls, environment=os.environ) -> Settings:
        """TRIBUTARY_DATA, TRIBUTARY_ARTIFACTS, TRIBUTARY_FEATURES, TRIBUTARY_OUTPUT and TRIBUTARY_PARTITIONS over the defaults."""
        given = {name: environment[f"TRIBUTARY_{name.upper()}"] for name in cls.__dataclass_fields__ if environment.get(f"TRIBUTARY_{name.upper()}")}
        return cls(**{k: int(v) if k == "partitions" else v for k, v in given.items()})

    def path(self, folder: str, *names: str) -> str:
        """A path below one of the folders, by its name."""
        return "/".join([getattr(self, folder).rstrip("/"), *names])
