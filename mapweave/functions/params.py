"""Request parameters, of today's interface and of the first one."""

from __future__ import annotations

import re

#: Parameters that name a map, and the type of their key.
MAP_TYPES = {"taxonKey": 1, "datasetKey": 2, "publishingOrg": 3, "country": 4, "publishingCountry": 5, "networkKey": 6}
BACKBONE = "d7dddbf4-2cf0-4f39-9b2a-bb099caae36c"
#: What a layer of the first interface shows.
LAYERS = {
    "OBS": ("OBSERVATION", "HUMAN_OBSERVATION", "MACHINE_OBSERVATION"),
    "SP": ("PRESERVED_SPECIMEN",),
    "OTH": ("MATERIAL_CITATION", "MATERIAL_SAMPLE", "OCCURRENCE", "LITERATURE", "UNKNOWN"),
}
#: The ranges of years that stand for all years.
WHOLE_RANGES = ((0, 2030), (1900, 2020))
V1_TYPES = {"TAXON": "taxonKey", "DATASET": "datasetKey", "PUBLISHER": "publishingOrg", "COUNTRY": "country", "PUBLISHING_COUNTRY": "publishingCountry"}


def map_keys(params: dict[str, list[str]]) -> tuple[str, str | None]:
    """The map's key, and the key of a country that masks it; empty parameters are ignored."""
    key = mask = None
    checklist = (params.get("checklistKey") or [BACKBONE])[0]
    for name, values in params.items():
        if name not in MAP_TYPES or not values or not values[0]:
            continue
        if len(values) > 1:
            raise ValueError(f"one {name} only; use an ad-hoc map for several")
        made = f"{MAP_TYPES[name]}:{checklist + '|' if name == 'taxonKey' else ''}{values[0]}"
        if name == "country":
            mask = made
        elif key:
            raise ValueError("one kind of map only; use an ad-hoc map for several")
        else:
            key = made
    return (key, mask) if key else (mask or "0:0", None)


def years(text: str | None) -> tuple[int | None, int | None]:
    """``1900``, ``1900,1950``, ``1900,`` or ``,1950``; nothing is no bound."""
    if not text:
        return None, None
    parts = text.split(",")
    if len(parts) > 2 or not any(parts):
        raise ValueError(f"a year, or a first and last year: {text}")
    ends = [int(p) if p else None for p in parts]
    if None not in ends and ends[0] > ends[-1]:
        raise ValueError(f"the first year is after the last: {text}")
    return ends[0], ends[-1]


def search(params: dict[str, list[str]], kinds: dict[str, type]) -> dict[str, list]:
    """Known search parameters, trimmed and typed; empty values go, wrong ones raise."""
    out: dict[str, list] = {}
    for name, values in params.items():
        if name in kinds and (kept := [v.strip() for v in values if v and v.strip()]):
            out[name] = [kinds[name](v) for v in kept]
    return out


def v1_map_key(kind: str, key: str, checklist: str = BACKBONE) -> str:
    """A key of the first interface as a map key; taxa are those of a checklist."""
    if not re.fullmatch(r"[0-9a-zA-Z_-]+", key):
        raise ValueError("not a map key")
    name = V1_TYPES.get(kind)
    return f"{MAP_TYPES[name]}:{checklist + '|' if name == 'taxonKey' else ''}{key}" if name else "0:0"


def v1_layers(layers: list[str]) -> tuple[set[str], tuple[int, int] | None]:
    """Bases of record and years that layers like ``OBS_1950_1960`` stand for; no bases and no years mean all.

    Years must be the same for each kind of layer. Undated records go with a whole range only (``WHOLE_RANGES``).
    """
    bases: set[str] = set()
    spans: dict[str, tuple[int, int]] = {}
    undated, kinds = False, []
    for layer in layers:
        if layer in ("LIVING", "FOSSIL"):
            bases.add(f"{layer}_SPECIMEN")
            continue
        prefix, first, last = (*layer.split("_", 2), "", "")[:3]
        if prefix not in LAYERS:
            continue
        bases.update(LAYERS[prefix])
        kinds.append(prefix)
        if first == "NO":
            undated = True
        else:
            low, high = 0 if first == "PRE" else int(first), int(last)
            old = spans.get(prefix, (low, high))
            spans[prefix] = (min(old[0], low), max(old[1], high))
    if len(set(spans.values())) > 1:
        raise ValueError(f"years differ between layers: {spans}")
    if len(bases) == len({b for x in LAYERS.values() for b in x}) + 2:
        bases = set()
    span = next(iter(spans.values()), None)
    if any(k not in spans for k in kinds):
        span = None
    if span and undated:
        if span not in WHOLE_RANGES:
            raise ValueError("undated records can't be shown beside a range of years")
        span = None
    return bases, span


def tile_address(path: str) -> tuple[int, int, int, float]:
    """(z, x, y, density) of ``.../{z}/{x}/{y}@{H,1..4}x.png``."""
    found = re.search(r"/(\d+)/(\d+)/(\d+)@(.)x\.png$", path)
    if not found or found[4] not in "H0123456789":
        raise ValueError("expected /{z}/{x}/{y}@{n}x.png")
    density = 0.5 if found[4] == "H" else float(found[4])
    return int(found[1]), int(found[2]), int(found[3]), 4.0 if density > 4 else density or 1.0


def vector_path(path: str) -> str:
    return re.sub(r"@[H0-9]+x\.png", ".mvt", path)
