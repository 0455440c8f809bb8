"""Header clean-up. Names are driver-side metadata, so this is plain Python over a short list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

# Characters replaced in a report header, applied after lower-casing.
HEADER_REPLACEMENTS = {" ": "_", "-": "_", ".": "_", "(": "", ")": ""}

# The curated tables use these names for three duplicated or odd pipeline headers.
PIPELINE_RENAMES = {"type": "type_1", "type_1": "type_2", "mo__offer_amt": "mo_offer_amt"}


def numbered(names: Sequence[str]) -> list[str]:
    """Give the second and later copies of a header the suffixes ``_1``, ``_2``, and so on."""
    counts: dict[str, int] = {}
    out = []
    for name in names:
        n = counts.get(name, 0)
        out.append(name if n == 0 else f"{name}_{n}")
        counts[name] = n + 1
    return out


def normalize(name: str, percent: str = "_pct") -> str:
    table = str.maketrans(HEADER_REPLACEMENTS | {"%": percent})
    return name.lower().translate(table)


def clean_headers(names: Sequence[str], renames: Mapping[str, str] | None = None, percent: str = "_pct") -> list[str]:
    renames = renames or {}
    plain = [normalize(n, percent) for n in numbered([n.strip().strip('"').lstrip("﻿") for n in names])]
    return [renames.get(n, n) for n in plain]


def as_written(names: Sequence[str]) -> list[str]:
    """Undo the position numbers Spark's CSV reader appends to repeated headers."""
    bare = [n[: -len(str(i))] if n.endswith(str(i)) else None for i, n in enumerate(names)]
    repeated = {b.lower() for b in bare if b and sum(1 for o in bare if o and o.lower() == b.lower()) > 1}
    return [b if b and b.lower() in repeated else n for b, n in zip(bare, names)]
