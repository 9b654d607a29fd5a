"""Secret scan: known shapes, and sliding-window entropy per character class with an allow-list."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlode.llm.common import mapped, whole_texts

# Kinds in the order in which they are listed, and the shapes of the base kinds.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

#: Runs that can hold an access, hex or entropy span; every such span lies in one of them.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Character class of a candidate, its window and the bits a character that a window has at least.
CLASSES = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16, 3.0),
    ("base36", re.compile(r"[0-9a-z]+|[0-9A-Z]+"), 20, 3.5),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.7),
)
#: Placeholders and alphabets; a span with too little besides them isn't a secret.
PLACEHOLDERS = re.compile(r"example|sample|dummy|placeholder|changeme|xxxx|your[_-]|0123456789|abcdefghij|1234567890|qwerty", re.IGNORECASE)
#: Candidates that are as a whole one of these aren't secrets: numbers, plain words and paths.
ALLOWED = (
    re.compile(r"\A[0-9+/_=-]*\Z"),
    re.compile(r"\A[A-Za-z+/_=-]*\Z"),
    re.compile(r"\A[A-Za-z]*[0-9]{1,4}\Z"),
    re.compile(r"\A/?(?:[a-z0-9_-]{1,15}/)+[a-z0-9_-]{0,15}\Z"),
)

_TERM = [0.0, *(c * math.log2(c) for c in range(1, 65))]


def entropy_spans(s: str, width: int, least: float) -> list[tuple[int, int]]:
    """Merged spans of the windows of `width` characters whose Shannon entropy is `least` bits or more.

    Counts are kept incrementally: a step of the window changes two of them and so two terms of
    the sum. Strings shorter than the window have none.
    """
    if len(s) < width:
        return []
    counts: dict[str, int] = {}
    total, full, spans = 0.0, math.log2(width), []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        if i >= width:
            n = counts[s[i - width]]
            counts[s[i - width]] = n - 1
            total += _TERM[n - 1] - _TERM[n]
        if i >= width - 1 and full - total / width >= least:
            start = i - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def _real(span: str, width: int) -> bool:
    """Whether a span holds a window's worth of characters that no allow-list takes besides placeholders."""
    rest = PLACEHOLDERS.sub("", span)
    return rest == span or len(rest) >= width and not any(a.search(rest) for a in ALLOWED)


def find_secrets(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind's place in KINDS, end, start of the secret itself), in this order; code points."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    for run in RUN.finditer(text):
        at, s = run.start(), run[0]
        if "AKIA" in s:
            found += [(at + m.start(), 1, at + m.end(), at + m.start()) for m in ACCESS.finditer(s) if len(m[0]) >= ACCESS_LEAST]
        if not s.isalpha():
            found += [(at + m.start(), 2, at + m.end(), at + m.start()) for m in HEX.finditer(s) if len(m[0]) >= HEX_LEAST]
            if not any(a.search(s) for a in ALLOWED):
                wide = sorted({(at + m.start() + a, at + m.start() + b) for _, chars, width, least in CLASSES for m in chars.finditer(s) for a, b in entropy_spans(m[0], width, least) if _real(m[0][a:b], width)})
                end = -1
                for k, (a, b) in enumerate(wide):  # merged over the classes
                    if a > end:
                        found.append((a, 3, b, a))
                    elif b > end:
                        found[-1] = (found[-1][0], 3, b, found[-1][3])
                    end = max(end, b)
        else:
            found += [(at + m.start(), 2, at + m.end(), at + m.start()) for m in HEX.finditer(s) if len(m[0]) >= HEX_LEAST]
    return sorted(found)


def spans_text(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found)


def redact(text: str, found, mask: str = "[REDACTED]") -> str:
    """The text with the secret part of every span replaced, overlapping ones by one mask."""
    out, at = [], 0
    for a, b in sorted((s, b) for _, _, b, s in found):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) of every whole text.

    A null text counts as empty: no spans and the digest of nothing. Spans of a kind don't overlap
    one another; spans of different kinds can. Other columns are ignored.
    """

    def run(batch):
        found = [find_secrets(t) for t in batch.column(1).to_pylist()]
        count = lambda k: [sum(x[1] == k for x in f) for f in found]
        digest = lambda f: hashlib.sha256(spans_text([x for x in f if x[1] < 3]).encode()).hexdigest()
        return {key: batch.column(0), "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_sha256": [digest(f) for f in found], "spans": [spans_text(f) for f in found], "n_entropy": count(3)}

    return mapped(whole_texts(docs, text, key), run, f"{key} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the secrets in `text` masked; all rows and columns stay, null texts stay null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: t if t is None or not (f := find_secrets(t)) else redact(t, f))

    return docs.withColumn(text, masked(F.col(text)))
