"""Deterministic rule engine over typed entity graphs, built on Spark DataFrames."""

from __future__ import annotations

import os
from pathlib import Path

__version__ = "0.1.0"


def reach_workers(spark) -> None:
    """Puts the folder of this package on the path of the session's Python workers, wherever the driver was started.

    On a cluster whose workers do not see that folder, ship the package with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
