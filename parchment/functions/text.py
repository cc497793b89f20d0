"""Scalar text functions: native expressions where they are exact, Arrow UDFs where Spark has no such function."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions import fixed

_SPACE = re.compile(r"\s+")
_DIVIDER = re.compile(fixed.DIVIDER)
#: Line ends that Python's splitlines knows.
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
#: White space as Python sees it; Java's (?U)\s lacks the four separators.
WHITE = r"[\s\u001c-\u001f]"
#: Characters that stay as they are in composition, whatever stands beside them out of these and ASCII, and whose case folds by lower() and ß:
#: Latin, Cyrillic, punctuation, currencies, kana, ideographs, Hangul.
PLAIN = (
    r"\x80-\xb4\xb6-\u012f\u0131-\u0148\u014a-\u017e\u0400-\u045f\u2010-\u2029\u2030-\u205e\u20a0-\u20bf"
    r"\u3001-\u3029\u3041-\u3094\u30a1-\u30f6\u4e00-\u9fff\uac00-\ud7a3"
)
#: Values that a worker holds as Python objects at once.
SLICE = 32


def normal_form(text: str) -> str:
    """What identifies a text: composed, without divider lines, single spaces, case folded."""
    lines = (x for x in unicodedata.normalize("NFC", text).splitlines() if not _DIVIDER.match(x.strip()))
    return _SPACE.sub(" ", "\n".join(lines)).strip().casefold()


def sound(text: str) -> str:
    """``text`` with halves of surrogate pairs joined, or replaced where they stand alone; such halves are in no UTF-8."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def decoded(data: bytes, declared: str | None = None) -> str:
    """Text of bytes: by byte order mark, the declared charset, a guess, and at last UTF-8 with replacements."""
    for mark, name in (
        (b"\xef\xbb\xbf", "utf-8-sig"),
        (b"\xff\xfe\x00\x00", "utf-32"),
        (b"\x00\x00\xfe\xff", "utf-32"),
        (b"\xff\xfe", "utf-16"),
        (b"\xfe\xff", "utf-16"),
    ):
        if data.startswith(mark):
            return data.decode(name, "replace")
    if declared:
        try:
            return data.decode(declared)
        except (LookupError, UnicodeDecodeError):
            pass
    guess = _guessed(data)
    return guess if guess is not None else data.decode("utf-8", "replace")


def _guessed(data: bytes) -> str | None:
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return None
    best = from_bytes(data).best()
    return None if best is None else str(best)


def _mapped(kind: str, f):  # noqa: ANN001, ANN202
    """``f`` of each value that isn't null. A batch has up to 10,000 texts; it stays in Arrow, and SLICE of them at a time become objects."""
    of = pa.string() if kind == "string" else pa.type_for_alias(kind)

    @F.arrow_udf(kind)
    def run(x: pa.Array) -> pa.Array:
        parts = (x.slice(i, SLICE).to_pylist() for i in range(0, len(x), SLICE))
        out = [pa.array([None if v is None else f(v) for v in part], of) for part in parts]
        return pa.concat_arrays(out) if out else pa.array([], of)

    return run


def plain_text(text: Column) -> Column:
    """Whether all characters of a text are ASCII or PLAIN."""
    return text.rlike(rf"^\p{{ASCII}}*+(?:[{PLAIN}]++\p{{ASCII}}*+)*+\z")


def normalized(text: Column) -> Column:
    """Exact normal form: of PLAIN texts by native expressions, of others by an Arrow UDF, so that few texts leave the JVM."""
    exact = _mapped("string", normal_form)(F.when(~plain_text(text), text))
    return F.coalesce(F.when(plain_text(text), normalized_native(text)), exact)


def composed(text: Column) -> Column:
    """Canonical composition; PLAIN text is composed already and never leaves the JVM."""
    other = F.when(~plain_text(text), text)
    return F.coalesce(_mapped("string", lambda x: unicodedata.normalize("NFC", x))(other), text)


def folded_name(text: Column) -> Column:
    """Composed, trimmed, case folded, single spaces; empty becomes null. By an Arrow UDF."""
    return F.nullif(_mapped("string", lambda x: _SPACE.sub(" ", unicodedata.normalize("NFC", x).strip().casefold()))(text), F.lit(""))


def bytes_text(data: Column, declared: str | None = None) -> Column:
    return _mapped("string", lambda x: decoded(bytes(x), declared))(data)


def normalized_native(text: Column) -> Column:
    """The normal form by native expressions: equal to the exact one for composed text whose case folds by
    lower() and ß; used where no Python is wanted."""
    lines = F.filter(
        F.split(text, LINE_END, -1), lambda x: ~F.regexp_like(F.regexp_replace(x, f"(?U)^{WHITE}+|{WHITE}+$", ""), F.lit(fixed.DIVIDER))
    )
    kept = F.when(text.rlike(r"[=\-_*~#]{3}"), F.array_join(lines, "\n")).otherwise(text)
    joined = F.regexp_replace(kept, f"(?U){WHITE}+", " ")
    return F.replace(F.lower(F.trim(joined)), F.lit("ß"), F.lit("ss"))


def context_clean(text: Column) -> Column:
    """Runs of blanks to one, three line feeds and more to two, trimmed; the text must be composed."""
    x = F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.regexp_replace(x, f"(?U)^{WHITE}+|{WHITE}+$", "")


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


def tax_id_valid(number: Column) -> Column:
    """Ten digits whose weighted sum modulo 11 is the last one."""
    weights = F.array(*[F.lit(w) for w in fixed.TAX_WEIGHTS])
    own = F.split(F.substring(number, 1, 9), "")
    total = F.aggregate(F.zip_with(own, weights, lambda d, w: d.try_cast("int") * w), F.lit(0), lambda a, x: a + x)
    right = total % 11 == F.substring(number, 10, 1).try_cast("int")
    return F.coalesce(number.rlike("^[0-9]{10}$") & right, F.lit(False))


def amount(text: Column) -> Column:
    """Two decimals, halves away from zero; null for what isn't a number or doesn't fit."""
    return F.round(F.trim(text).try_cast("decimal(38,18)"), 2).try_cast("decimal(20,2)")


def amount_even(text: Column) -> Column:
    """Two decimals, halves to the even neighbour, as scoring compares them."""
    return F.bround(F.trim(text).try_cast("decimal(38,18)"), 2).try_cast("decimal(20,2)")


def currency(text: Column) -> Column:
    """An unambiguous symbol's code, a known code in upper case, or null."""
    x = F.trim(text)
    out = F.when(F.upper(x).isin(*fixed.ISO_4217), F.upper(x))
    for symbol, code in fixed.SYMBOLS.items():
        out = F.when(x == symbol, F.lit(code)).otherwise(out)
    return out


def plain(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def tax_key(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(text, "[^0-9A-Za-z]", "")), F.lit(""))


def currency_key(text: Column) -> Column:
    return F.nullif(F.upper(F.trim(text)), F.lit(""))


def one_sentence(text: Column) -> Column:
    """Whether no sentence ends inside the text: a mark followed by white space and a capital."""
    core = F.regexp_replace(F.trim(text), "[.!?]+$", "")
    return ~core.rlike(r"(?U)[.!?]\s+[A-ZĄĆĘŁŃÓŚŹŻ]")


def name_token(name: Column) -> Column:
    """The longest word of a name, the first at a tie, generic words apart unless there is nothing else; folded."""
    found = F.regexp_extract_all(name, F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), 1)
    generic = F.array(*[F.lit(x) for x in fixed.GENERIC_WORDS])
    own = F.filter(found, lambda x: ~F.array_contains(generic, F.lower(x)))
    pool = F.when(F.size(own) > 0, own).otherwise(found)
    longest = F.aggregate(pool, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.nullif(F.replace(F.lower(longest), F.lit("ß"), F.lit("ss")), F.lit(""))


def summary_loose(summary: Column, doc_type: Column, name: Column) -> Column:
    """One sentence that names the other party and the type of document, as far as these are known."""
    low = F.replace(F.lower(F.trim(summary)), F.lit("ß"), F.lit("ss"))
    token = name_token(name)
    words = F.lit(True)
    for kind, keys in fixed.TYPE_WORDS.items():
        any_of = low.contains(keys[0])
        for k in keys[1:]:
            any_of = any_of | low.contains(k)
        words = F.when(doc_type == kind, any_of).otherwise(words)
    good = (F.trim(summary) != "") & one_sentence(summary) & (token.isNull() | low.contains(token)) & words
    return F.when(doc_type.isNull(), True).otherwise(F.coalesce(good, F.lit(False)))


def resolved_currency(explicit: Column, symbol: Column, country: Column, has_address: Column, vat_prefix: Column) -> Column:
    """``struct<currency, level>`` by precedence: code, clear symbol, symbol with country, address, VAT prefix."""

    def looked_up(table: dict, key: Column) -> Column:
        pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
        return F.try_element_at(F.create_map(*pairs), F.coalesce(key, F.lit("")))

    both = {f"{s}/{c}": v for (s, c), v in fixed.AMBIGUOUS.items()}
    address = F.coalesce(has_address, F.lit(False))
    levels = [
        (F.nullif(explicit, F.lit("")), "explicit"),
        (looked_up(fixed.SYMBOLS, symbol), "symbol_unambiguous"),
        (looked_up(both, F.concat(symbol, F.lit("/"), country)), "symbol_ambiguous"),
        (F.when(address, looked_up(fixed.COUNTRY_CURRENCY, country)), "address"),
        (F.when(~address, looked_up(fixed.VAT_CURRENCY, vat_prefix)), "vat_prefix"),
    ]
    level = F.lit("none")
    for value, name in reversed(levels):
        level = F.when(value.isNotNull(), F.lit(name)).otherwise(level)
    return F.struct(F.coalesce(*[v for v, _ in levels]).alias("currency"), level.alias("level"))
