"""Functions of source preparation that run once per distinct rule, in Python."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Characters that a wildcard key may have besides letters, digits and _, and that stand for themselves.
_LITERAL = "|.\\^$+?{}()"
#: What the marks of a key stand for: with classes only the star is one.
_CLASSED = str.maketrans({"*": "."} | {c: re.escape(c) for c in _LITERAL})
_MARKED = _CLASSED | str.maketrans({"_": ".", "%": ".*", "#": "[0-9]"})
_KEY = re.compile(rf"[\w*%#{re.escape(_LITERAL)}]*", re.ASCII)
_KEY_WITH_CLASSES = re.compile(rf"(?:\[[\w*\[{re.escape(_LITERAL)}-]*\]|[\w*\]{re.escape(_LITERAL)}])*", re.ASCII)
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|x[0-9A-Fa-f]{1,2}|.)", re.DOTALL)
# Single-letter escapes of the dump format.
_CONTROL = {b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"v": b"\v"}


def wildcard_to_regex(key: str) -> str | None:
    """A prefix regex of a wildcard key; None for classes with digits marks, which have no meaning.

    A star is any character. Without classes an underscore is too, a per cent sign any run, and a
    hash a digit. In a class 1-A lists both ends, and a star becomes a dot.
    """
    classes = "[" in key
    if classes and "#" in key:
        return None
    if not (_KEY_WITH_CLASSES if classes else _KEY).fullmatch(key):
        raise ValueError(f"no pattern: {key!r}")
    found = r"\A" + (key.replace("1-A", "1A").translate(_CLASSED) if classes else key.translate(_MARKED))
    re.compile(found)
    return found


def capture_of(key: str) -> tuple[int, int]:
    """(start, length) of the run from the first to the last hash; (-1, 0) without one."""
    return (-1, 0) if "#" not in key else (key.index("#"), key.rindex("#") - key.index("#") + 1)


def unescape_copy(cell: str) -> str | None:
    """A cell of a table dump: backslash N is null; octal, hex and letter escapes are bytes of UTF-8."""
    if cell == r"\N":
        return None

    def meant(m: re.Match) -> bytes:
        code = m[1]
        if code.isdigit() and code < b"8":
            return bytes([int(code, 8) % 256])
        return bytes([int(code[1:], 16)]) if len(code) > 1 else _CONTROL.get(code, code)

    return _ESCAPED.sub(meant, cell.encode()).decode()


def slug(label: str) -> str:
    """Bytes that are ASCII letters or digits in lower case, others as ~ and two hex digits."""
    return re.sub(rb"[^0-9A-Za-z]", lambda m: b"~%02x" % ord(m[0]), label.encode()).decode().lower()


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def canonical_id(value) -> str:
    """First 24 hex digits of the SHA-256 of the canonical JSON of a value."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:24]


def strict_json(text: str):
    """JSON in which no object repeats a key."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError(f"repeated key among {[k for k, _ in pairs]}")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=once)


# The identifiers' alphabet, and what a rule pattern is made of.
_ALPHABET = "0123456789ABCDEFGHJKLMNPRSTUVWXYZ"
_RULE_TOKEN = r"(?:[A-HJ-NPR-Z0-9.]|\[[A-HJ-NPR-Z0-9-]+\])(?:\{[0-9]{1,2}\})?"


def bounded_grammar(pattern: str) -> bool:
    """Whether a rule pattern has only characters of the alphabet, dots and classes, each with a count at most."""
    return re.fullmatch(f"(?:{_RULE_TOKEN})+", pattern) is not None


def literal_prefixes(pattern: str, most: int = 1296) -> list[str]:
    """Literal beginnings of at most three characters, one of which every match of the pattern has.

    A pattern outside the bounded grammar raises ValueError.
    """
    if not bounded_grammar(pattern):
        raise ValueError(f"no bounded pattern: {pattern!r}")
    every, found = _ALPHABET, [""]
    for m in list(re.finditer(r"(\[[^\]]+\]|.)(\{\d+\})?", pattern))[:3]:
        token, count = m[1], m[2]
        chars = every if token == "." else "".join(c for c in every if re.fullmatch(token, c)) if token[0] == "[" else token
        for _ in range(min(3, int(count[1:-1])) if count else 1):
            longer = [p + c for p in found for c in chars]
            if len(longer) > most or len(found[0]) == 3:
                return [p for p in found if p]
            found = longer
    return [p for p in found if p]


@pandas_udf(StringType())
def wildcard_regex(keys):
    known = {k: wildcard_to_regex(k) for k in keys.dropna().unique()}
    return keys.map(known.get, na_action="ignore")


@pandas_udf(StringType())
def unescaped(cells):
    return cells.map(unescape_copy, na_action="ignore")


@pandas_udf(StringType())
def slugs(labels):
    return labels.map(slug, na_action="ignore")


@pandas_udf(StringType())
def json_id(values):
    """canonical_id of JSON texts, however their keys are ordered."""
    return values.map(lambda v: canonical_id(json.loads(v)), na_action="ignore")


def json_of(*columns):
    """JSON of a struct with its nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
