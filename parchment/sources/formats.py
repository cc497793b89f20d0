"""Formats by content: never by name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions import fixed
from parchment.functions.text import _guessed

_HEADER = re.compile(fixed.MAIL_HEADER.encode(), re.I | re.M)
_MARKER = re.compile(fixed.HTML_MARKER.encode(), re.I)
CONTROL_SHARE = 0.05


def is_text(head: bytes) -> bool:
    if not head:
        return True
    guess = _guessed(head)
    if not guess:
        return False
    return sum(c < " " and c not in "\t\n\r" for c in guess) <= CONTROL_SHARE * len(guess)


def detect(head: bytes) -> str:
    """pdf, docx, eml, html, txt or unknown, from a file's first bytes."""
    if head[:5] == b"%PDF-":
        return "pdf"
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "docx"
    if _HEADER.match(head.partition(b"\n")[0]) and len(_HEADER.findall(head[:2048])) > 1:
        return "eml"
    if _MARKER.search(head[:1024]):
        return "html"
    return "txt" if is_text(head) else "unknown"


def detect_text(text: Column) -> Column:
    """The same for text already decoded, natively; what is neither mail nor markup is text unless controls abound."""
    head = F.substring(text, 1, fixed.HEAD_BYTES)
    header = F.lit(f"(?im)({fixed.MAIL_HEADER})")
    mail = F.regexp_like(F.substring_index(head, "\n", 1), F.lit(f"(?i){fixed.MAIL_HEADER}")) & (
        F.regexp_count(F.substring(head, 1, 2048), header) > 1
    )
    controls = F.regexp_count(head, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    return (
        F.when(head.startswith("%PDF-"), "pdf")
        .when(head.startswith("PK\u0003\u0004") | head.startswith("PK\u0005\u0006"), "docx")
        .when(mail, "eml")
        .when(F.regexp_like(F.substring(head, 1, 1024), F.lit(f"(?i){fixed.HTML_MARKER}")), "html")
        .when((head == "") | (controls <= CONTROL_SHARE * F.length(head)), "txt")
        .otherwise("unknown")
    )
