"""Business documents made for tests: what they say, how files say it, and archives of them."""

from __future__ import annotations

import io
import random
import unicodedata
import zipfile
from dataclasses import dataclass
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal
from email.message import EmailMessage
from xml.sax.saxutils import escape

from parchment.functions import fixed

CENT = Decimal("0.01")
PL = fixed.MONTHS_PL.split("|")
EN = fixed.MONTHS_EN.split("|")
ROMAN = fixed.ROMAN.split("|")


def tax_id(rng: random.Random) -> str:
    """Ten digits whose weighted sum modulo 11 is the last."""
    while True:
        own = [rng.randrange(1, 10), *(rng.randrange(10) for _ in range(8))]
        check = sum(a * b for a, b in zip(own, fixed.TAX_WEIGHTS, strict=True)) % 11
        if check < 10:
            return "".join(map(str, [*own, check]))


def tax_forms(n: str) -> list[str]:
    return [n, f"{n[:3]}-{n[3:6]}-{n[6:8]}-{n[8:]}", f"PL {n}", f"PL{n}", f"{n[:3]} {n[3:6]} {n[6:8]} {n[8:]}"]


def amount_forms(x: Decimal) -> list[str]:
    whole, cents = f"{x:.2f}".split(".")
    by = lambda mark: f"{int(whole):,}".replace(",", mark)
    return [f"{by(' ')},{cents} zł", f"{by(chr(160))},{cents} PLN", f"{by('.')},{cents} EUR", f"${by(',')}.{cents}", f"{whole}.{cents} USD", f"{whole},{cents}", f"PLN {whole}.{cents}", f"€{by(',')}.{cents}"]


def date_forms(d: date) -> list[str]:
    return [d.isoformat(), f"{d.day:02}.{d.month:02}.{d.year}", f"{d.month}/{d.day}/{d.year}", f"{d.day} {PL[d.month - 1]} {d.year}", f"{d.day} {ROMAN[d.month - 1]} {d.year}", f"{EN[d.month - 1]} {d.day}, {d.year}"]


@dataclass
class Document:
    kind: str
    seller: str
    tax: str
    issued: date
    due: date | None
    lines: list[tuple[str, int, Decimal]]
    currency: str
    text: str = ""

    @property
    def gross(self) -> Decimal:
        """Net of each line, its tax of 23 per cent, and the sum, each rounded half up."""
        total = Decimal(0)
        for _, n, price in self.lines:
            net = (n * price).quantize(CENT, ROUND_HALF_UP)
            total += net + (net * Decimal("0.23")).quantize(CENT, ROUND_HALF_UP)
        return total

    def golden(self, files: list[str]) -> dict:
        return {
            "files": files, "doc_type": self.kind, "counterparty_name": self.seller, "counterparty_tax_id": self.tax, "issue_date": self.issued.isoformat(),
            "due_date": self.due.isoformat() if self.due else None, "gross_amount": f"{self.gross:.2f}", "currency": self.currency, "summary": "",
        }


def documents(seed: int = 1) -> list[Document]:
    """Ten invoices, six contracts, four offers, six letters and two others, each different from the rest."""
    rng, out = random.Random(seed), []
    for kind, n in (("invoice", 10), ("contract", 6), ("offer", 4), ("correspondence", 6), ("other", 2)):
        for k in range(n):
            issued = date(2024, 1, 1) + timedelta(days=rng.randrange(360))
            lines = [(f"Item {j}", rng.randrange(1, 9), Decimal(rng.randrange(100, 900_000)) / 100) for j in range(1, 4)]
            d = Document(kind, f"Zakład {kind.title()} {k} Sp. z o.o.", tax_id(rng), issued, issued + timedelta(days=14) if kind == "invoice" else None, lines, "PLN")
            body = [f"{kind.title()} no. {k} of {rng.choice(date_forms(issued))}", f"Seller: {d.seller}", f"NIP {rng.choice(tax_forms(d.tax))}"]
            body += [f"{name}  {n} x {price}" for name, n, price in lines] + [f"Total {amount_forms(d.gross)[0]}"]
            d.text = "\n".join(body + ([f"Due {date_forms(d.due)[3]}"] if d.due else []))
            out.append(d)
    return out


def as_txt(text: str, code: str = "utf-8") -> bytes:
    return text.encode(code)


def as_html(text: str) -> bytes:
    body = "".join(f"<p>{escape(x)}</p>\n" for x in text.split("\n"))
    return f"<!doctype html><html><head><meta charset='utf-8'><title>page 7</title><style>p {{}}</style></head><body>{body}</body></html>".encode()


def as_eml(text: str, attachment: tuple[str, bytes] | None = None, html: bool = False) -> bytes:
    mail = EmailMessage()
    mail["From"], mail["To"], mail["Subject"] = "a@example.com", "b@example.com", "Faktura"
    mail.set_content(as_html(text).decode() if html else text, subtype="html" if html else "plain")
    if attachment:
        mail.add_attachment(attachment[1], maintype="application", subtype="octet-stream", filename=attachment[0])
    return bytes(mail)


def as_docx(text: str, rows: list[list[str]] | None = None) -> bytes:
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    p = lambda x: f"<w:p><w:r><w:t xml:space='preserve'>{escape(x)}</w:t></w:r></w:p>"
    table = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows or [])
    body = "".join(map(p, text.split("\n"))) + (f"<w:tbl>{table}</w:tbl>" if rows else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def copies_of(text: str) -> dict[str, bytes]:
    """The eight ways in which a file says again what another says."""
    return {
        "byte copy.txt": as_txt(text), "other code.txt": as_txt(text, "utf-16"), "other format.html": as_html(text), "crlf.txt": as_txt(text.replace("\n", "\r\n")),
        "blank lines.txt": as_txt(text.replace("\n", "  \n\n") + "\n \n"), "hard blanks.txt": as_txt(text.replace(" ", "\u00a0")), "attached.eml": as_eml("See the file.", ("a.docx", as_docx(text))),
        unicodedata.normalize("NFD", "składnia.txt"): as_txt(unicodedata.normalize("NFD", text)),
    }


def corrupt() -> dict[str, tuple[bytes, str]]:
    """Eight files that give no text, and why."""
    rng = random.Random(2)
    noise = bytes(rng.randrange(256) for _ in range(4000))
    broken = io.BytesIO()
    with zipfile.ZipFile(broken, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("readme.txt", "x")
    return {
        "zero.txt": (b"", "empty_text"), "blank.txt": (b" \n\t ", "empty_text"), "picture.pdf": (b"\x89PNG\r\n\x1a\n" + noise, "unsupported_format"), "noise.docx": (noise, "unsupported_format"),
        "noise.txt": (b"\x00\x01\x02" + noise, "unsupported_format"), "no part.docx": (broken.getvalue(), "corrupt_file"), "no word.docx": (other.getvalue(), "unsupported_format"),
        "cut.docx": (as_docx("some words")[:60], "corrupt_file"),
    }


def scale_archive(path: str, files: int = 5000, different: float = 0.03, seed: int = 3) -> int:
    """A ZIP of short texts, nearly all of them copies; returns how many differ."""
    rng = random.Random(seed)
    texts = [f"Letter {k} about {rng.getrandbits(40)}" for k in range(max(1, int(files * different)))]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(files):
            z.writestr(f"box{k % 7}/{k:06}.txt", texts[k] if k < len(texts) else rng.choice(texts))
    return len(texts)


def huge_file(path: str, megabytes: int, at_end: bool, text: str) -> None:
    """A text file of filler lines with one document at its beginning or its end."""
    line = b"filler line without anything to find in it at all\n"
    with open(path, "wb") as f:
        if not at_end:
            f.write(text.encode() + b"\n")
        for _ in range((megabytes << 20) // (len(line) * 1000)):
            f.write(line * 1000)
        if at_end:
            f.write(text.encode())
