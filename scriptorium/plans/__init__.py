"""Registered queries, a module a family."""

from __future__ import annotations

import importlib

FAMILIES = ("text", "telemetry", "runs", "rules", "sentences", "audio", "aggregates", "state", "normalize", "kernels", "chunks", "verdicts", "reports", "reflow", "alignments", "clips", "structure", "checks")


def load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"scriptorium.plans.{name}")
