"""Identities of code, settings and inputs, as hashes of canonical JSON made on the driver."""

from __future__ import annotations

import dataclasses
import hashlib

from .. import config
from .text import canonical_json


def digest(value: object, length: int = 20) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:length]


def settings() -> dict:
    """Every threshold in force."""
    return {"search": dataclasses.asdict(config.SEARCH), "vetoes": dataclasses.asdict(config.VETOES), "population": dataclasses.asdict(config.POPULATION)}


def scientific(code: str, product: str, targets: str) -> str:
    return digest({"code": code, "product": product, "settings": settings(), "targets": targets})


def vetting(code: str, snapshots: dict[str, str], matching: dict) -> str:
    return digest({"code": code, "matching": matching, "snapshots": snapshots})


def campaign(targets: str, given: dict, rows: list[tuple[int, str]]) -> str:
    """A campaign's identity: its targets and settings, less how it was stored and run."""
    return digest({"rows": sorted(rows), "settings": {k: v for k, v in given.items() if k not in ("storage_retention", "execution")}, "targets": targets})


def positions(rows: list[tuple[float, float]]) -> str:
    return digest(sorted((round(a, 6), round(b, 6)) for a, b in rows), 64)
