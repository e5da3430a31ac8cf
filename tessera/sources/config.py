"""SRC-13: what a job reads from its surroundings, in one place."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    data_dir: str = "original_data"
    sweep_dir: str = "sweep_result_clean_split"
    run_name: str = ""
    cat_name: str = ""
    n_samples: int = 30
    seed: int = 42
    csv_path: str = ""

    @classmethod
    def of(cls, env: Mapping[str, str] = os.environ) -> Config:
        # The variables' names.
        names = {"data_dir": "DATA_DIR", "sweep_dir": "SWEEP_DIR", "run_name": "RUN_NAME", "cat_name": "CAT_NAME", "n_samples": "N_SAMPLES", "seed": "SEED", "csv_path": "CHEX_CSV"}
        return cls(**{f: type(getattr(cls, f))(env[n]) for f, n in names.items() if n in env})
