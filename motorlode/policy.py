"""Decoding policy: fixed values that results depend on."""

from __future__ import annotations

# Fixed values of the pattern profile.
MARKET = "US"
REFERENCE_YEAR = 2026
YEAR_CODES = "ABCDEFGHJKLMNPRSTVWXY123456789"
YEAR_BASE, YEAR_CYCLE, YEAR_HORIZON = 1980, 30, 2
LIGHT_TYPES, TRUCK_VEHICLE_TYPE, LIGHT_TRUCK, CYCLE_BEFORE = (2, 7), 3, "1", 2010
KEY_SEPARATOR = "|"
MULTIPLE_ELEMENTS = (121, 129, 150, 154, 155, 114, 169)
ENGINE_ELEMENT, MODEL_ELEMENT, MAKE_ELEMENT, YEAR_ELEMENT = 18, 28, 26, 29
FORMULA_PRIORITY, ENGINE_PRIORITY = 100, 50
CONVERSION_SCALE = 6
FALLBACK_MESSAGE = "Possible match from {sourceMarket} data; applicability to {requestedMarket} is unverified."
UNSPECIFIED_MARKET = "an unspecified market"
UNKNOWN_MARKET_WARNING = "These possibilities assume US reporting scope; supply market US only when independently known."
YEAR_CONFLICT_WARNING = "VIN year code does not resolve within this scheme and supplied context."
YEAR_ALTERNATIVES_WARNING = "The VIN year code has multiple possible cycles; alternatives retain each year's associated facts."
STAGES = ("public-patterns", "model-make", "engine-model", "displacement-conversion")

# Primary fields and the element codes that decide them.
PRIMARY = {"make": "Make", "model": "Model", "modelYear": "ModelYear", "productionYear": "ProductionYear"}

# Status of an answer by what is known.
STATUSES = {"KNOWN": "RESOLVED", "NEEDS_CONTEXT": "SUGGESTED", "UNKNOWN": "UNKNOWN", "AMBIGUOUS": "AMBIGUOUS"}

# Bounds of model years, categories of passenger cars, elements and schemas left out.
FIRST_YEAR, LAST_YEAR, OPEN_END = 1886, 9999, 2999
PASSENGER_CATEGORIES = ("M1", "M1G")
PRIVATE_ELEMENTS = (26, 27, 29, 39)
SHARDS = 256
EDITION_GROWTH, EXCLUSION_POINTS = (0.95, 1.5), 0.01
EXAMPLES, MISMATCHES = 3, 25


def flatten(policy, path: str = "") -> list[tuple[str, str, str]]:
    """(dotted path, type S, I or B, text) of nested settings; arrays also have a .length."""
    if isinstance(policy, dict):
        return [row for k in sorted(policy) for row in flatten(policy[k], f"{path}.{k}" if path else k)]
    if isinstance(policy, list):
        return [(f"{path}.length", "I", str(len(policy)))] + [row for i, x in enumerate(policy) for row in flatten(x, f"{path}.{i}")]
    if isinstance(policy, bool):
        return [(path, "B", "true" if policy else "false")]
    if isinstance(policy, int):
        return [(path, "I", str(policy))]
    return [(path, "S", str(policy))]


def unflatten(rows) -> dict:
    """Typed settings by dotted path, from rows of `flatten`."""
    typed = {"S": str, "I": int, "B": lambda x: x == "true"}
    return {path: typed[kind](text) for path, kind, text in rows}
