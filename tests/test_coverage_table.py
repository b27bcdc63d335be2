"""The table of operators names only what is there."""

from __future__ import annotations

import importlib
import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_names_exist():
    names = re.findall(r"`((?:sources|functions|operators|sinks|streaming|plans)(?:\.\w+)+)`", (ROOT / "COVERAGE.md").read_text())
    assert len(names) > 150
    for name in names:
        module, attribute = name.rsplit(".", 1)
        assert hasattr(importlib.import_module(f"loamfield.{module}"), attribute), name
