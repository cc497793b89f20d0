import io
import json
import random
import re
import time
import unicodedata
import zipfile
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from parchment.functions import candidates, fixed, text
from parchment.operators import evaluation, inference, ledger, runs, validation, windowing
from parchment.plans import documents
from parchment.sources import archive, extract, formats
from parchment.sources.config import Config, golden, load
from parchment.streaming import arrivals


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(f(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


TEXTS = ["Straße\n=====\n  A  b C ", "", "x\r\ny z", "~~~", "ŁÓDŹ  Ω", "a\x0bb\x85c", "--- not\n---"]


def test_normal_form_native_equals_exact(spark):
    assert column(spark, TEXTS, text.normalized_native) == [text.normal_form(x) for x in TEXTS]
    assert column(spark, [*TEXTS, None], text.normalized) == [*map(text.normal_form, TEXTS), None]


def python_passes(df):
    """Nodes of a plan that send rows to Python workers; each is a worker of its own in every task."""
    return str(df._jdf.queryExecution().optimizedPlan().toString()).count("ArrowEvalPython")


def test_plain_texts_have_their_normal_form_without_python(spark):
    plain = re.compile(f"[{text.PLAIN}\\x00-\\x7f]")
    chars = [chr(c) for c in range(0x30000) if plain.match(chr(c))]
    assert all(unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and c.casefold() == c.lower().replace("ß", "ss") for c in chars)
    parts = [unicodedata.decomposition(chr(c)).split() for c in range(0x110000)]
    assert not any(len(p) == 2 and p[0][0] != "<" and plain.match(chr(int(p[1], 16))) for p in parts)  # none composes with what precedes it
    cases = ["x" + "y z".join(chars[i : i + 50]) + " \n" for i in range(0, len(chars), 50)]
    cases += [*TEXTS, "e\u0301 \u2028---\u2029 a", "ΑΣ Σ", "İı", "a\u0085", "\x1f=== \x1d b", "ſ", "x\u2000y", "\U0001f600 A", "--\n---\n----x"]
    assert column(spark, [*cases, None], text.normalized) == [*map(text.normal_form, cases), None]
    assert column(spark, cases, text.composed) == [unicodedata.normalize("NFC", x) for x in cases]
    seen = spark.createDataFrame([(x,) for x in cases], "t string").select(text.plain_text(F.col("t")).alias("p"), "t").collect()
    assert all(r["p"] == all(plain.match(c) for c in r["t"]) for r in seen)


def test_a_worker_holds_few_texts_as_objects(spark):
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([f"{i} " + "ab" * 10_000 for i in range(2000)] + [None])
    run = text._mapped("string", str.upper).func
    tracemalloc.start()
    out = run(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4_000_000 and out[-1].as_py() is None and out[7].as_py() == "7 " + "AB" * 10_000 and run(texts[:0]).to_pylist() == []


def test_answers_and_sources_share_a_worker(spark):
    rows = spark.createDataFrame([("Kraków, 2024-01-05", '{"doc_type": "other", "summary": "A.", "counterparty_name": "KRAKÓW"}')], "s string, r string")
    out = validation.validated(rows, "r", "s")
    assert python_passes(out) == 1 and out.first()["counterparty_name"] == "KRAKÓW"


def test_scalar_functions(spark):
    assert column(spark, ["5260001246", "8104482459", "6633681957", "12", None], text.tax_id_valid) == [True, True, False, False, False]
    assert column(spark, ["861.005", "-1.005", "1e30", "0.00499999999999", "x", None], text.amount) == [
        Decimal("861.01"), Decimal("-1.01"), None, Decimal("0.00"), None, None,
    ]
    assert column(spark, ["0.125", "0.135"], text.amount_even) == [Decimal("0.12"), Decimal("0.14")]
    assert column(spark, ["zł", " eur", "$", "PLZ", None], text.currency) == ["PLN", "EUR", None, None, None]
    assert column(spark, ["Zakład Usługowy Kowalski Sp. z o.o.", "the", ""], text.name_token) == ["kowalski", "the", None]
    assert column(spark, ["Sp. z o.o. sells.", "One. Two"], text.one_sentence) == [True, False]
    assert text.decoded(b"\xef\xbb\xbfa") == "a" and text.decoded("ł".encode("cp1250"), "cp1250") == "ł"


@pytest.mark.parametrize("most", [documents.ITEM_BYTES, 300])  # the second takes the benchmark in several passes
def test_every_item_is_looked_for_in_every_text(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(documents, "ITEM_BYTES", most)
    rng = random.Random(7)
    items = {i: f"Item {i} asks Straße\n{rng.randrange(10**6)}?" for i in range(60)} | {60: "", 61: None}
    docs = {d: " ".join(f"filler {items[i].upper()}" for i in rng.sample(range(60), d % 3)) + " NIP 526-000-77-46" * (d == 5) for d in range(90)} | {90: None, 91: ""}
    spark.createDataFrame([(d, x, len(x or "")) for d, x in docs.items()], "doc_id long, text string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, documents.values_in_source(spark, f"file://{tmp_path}").collect()))
    forms = {i: text.normal_form(x) for i, x in items.items() if x}
    want = [(d, "benchmark", str(i)) for d, x in docs.items() if x is not None for i, f in forms.items() if f in text.normal_form(x)]
    assert any(int(i) != d % 40 for d, _, i in want) and any(int(i) >= 40 for _, _, i in want)
    assert got == sorted(want + [(d, "tax_id", f"526000{d:02}46") for d, x in docs.items() if x is not None])


CASES = [
    "NIP: 526-000-12-46", "VAT PL 5260001246", "tel 12 34", "12 września 2024", "12 WRZEŚNIA 2024", "3/12/2024", "12 III 2024",
    "March 5, 2025 and 5 March 2025", "1 234,56 zł", "$1,234.50", "-450.00 PLN", "2024-1-5 2024-01-05x", "a 1.5 b 2,55", "",
]


def test_candidates_and_offsets_match_python(spark):
    for pattern, f in ((candidates.TAX_ID, "nip"), (candidates.DATE, "date"), (candidates.AMOUNT, "amount"), (candidates.KEYWORD, "keyword")):
        got = column(spark, CASES, lambda c, p=pattern, k=f: candidates.spans(c, p, k))
        plain = candidates.AMOUNT_PLAIN if f == "amount" else pattern
        plain = re.compile(plain.replace("(?iU)", ""), re.I)
        for case, found in zip(CASES, got, strict=True):
            assert [(x["start"], x["text"]) for x in found] == [(m.start(), m.group()) for m in plain.finditer(case)], (f, case)


def test_amounts_are_those_of_the_plain_pattern(spark):
    """The pattern in use skips starts that can't match; both must find the same, also right after another match."""
    rng = random.Random(1)
    parts = ["123", "4567", "12", "1", " ", ".", ",", "-", " ", ",50", "  ", "zł", "890", "\n", "$", "\ufdd0"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    plain = re.compile(candidates.AMOUNT_PLAIN.replace("(?iU)", ""), re.I)
    got = column(spark, cases, lambda c: candidates.spans(c, candidates.AMOUNT, "amount"))
    for case, found in zip(cases, got, strict=True):
        assert [(x["start"], x["text"]) for x in found] == [(m.start(), m.group()) for m in plain.finditer(case)], case
    assert column(spark, cases, candidates.amounts) == [[m.group() for m in plain.finditer(c)] for c in cases]


def far_cases():
    """Texts in which digits are few, with what patterns look for at all distances from them."""
    rng = random.Random(4)
    parts = ["12", "1 234,56 zł", "2024", "526-000-12-46", "NIP", "VAT:  PL ", "March ", "października", " III ", "-", ".", ",", " ", "        ", "         ", "\n", "$", "PLN", "word", "ł", "\ufdd1", "\ufdd0"]
    fill = lambda: "".join(rng.choice("abcdef  ż.") for _ in range(rng.choice((5, 11, 12, 13, 24, 30, 63, 64, 65, 200))))
    return ["".join(fill() if rng.random() < 0.3 else rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]


def test_what_is_far_from_digits_is_in_no_candidate(spark):
    cases = far_cases()
    near = column(spark, cases, candidates.near_digits)
    assert sum(map(len, near)) < 0.9 * sum(map(len, cases))
    for pattern, f in ((candidates.TAX_ID, candidates.tax_ids), (candidates.DATE, candidates.dates), (candidates.AMOUNT_PLAIN, candidates.amounts)):
        plain = re.compile(pattern.replace("(?iU)", ""), re.I)
        want = [[m.group() for m in plain.finditer(c)] for c in cases]
        ten = lambda m: len(re.sub(r"\D", "", m)) == 10
        assert column(spark, cases, f) == [[m for m in x if f is not candidates.tax_ids or ten(m)] for x in want]


def test_places_near_digits_are_those_in_the_whole_text(spark):
    cases = [*far_cases(), "", None]
    got = column(spark, cases, candidates.all_spans)
    assert got[-2:] == [[], None]
    kinds = [("nip", candidates.TAX_ID), ("date", candidates.DATE), ("amount", candidates.AMOUNT_PLAIN)]
    for case, found in zip(cases[:-2], got, strict=False):
        want = [(k, m.start(), m.group()) for k, p in kinds for m in re.finditer(p.replace("(?iU)", ""), case, re.I)]
        assert [(x["kind"], x["start"], x["text"]) for x in found] == [x for x in want if x[0] != "nip" or len(re.sub(r"\D", "", x[2])) == 10], case


def test_the_tree_of_keywords_has_the_matches_of_their_list(spark):
    rng = random.Random(5)
    like = lambda c: rng.choice([c, c.upper(), c.lower(), *{"i": "İı", "k": "\u212a", "s": "ſ", " ": "\u00a0"}.get(c.lower(), "")])
    cases = ["".join(like(c) for k in rng.choices(fixed.KEYWORDS, k=5) for c in k[: rng.choice((2, 99, 99))] + rng.choice(("", " "))) for _ in range(2000)]
    letters = {c for k in fixed.KEYWORDS for c in k.lower() if c.isalpha()}
    assert column(spark, cases, lambda c: candidates.spans(c, candidates.KEYWORD_TREE, "k")) == column(spark, cases, lambda c: candidates.spans(c, candidates.KEYWORD, "k"))
    every = "".join(chr(c) for c in range(1, 0xD800))
    for c in sorted(letters):  # all characters that Java takes for a letter of a keyword
        assert column(spark, [every], lambda x, c=c: F.regexp_extract_all(x, F.lit(candidates._letter(c)), 0)) == column(spark, [every], lambda x, c=c: F.regexp_extract_all(x, F.lit(f"(?iU){c}"), 0)), c


def test_candidates_take_no_long_time_where_digits_are_few(spark):
    """Per character, the patterns took over twenty times a pass that only looks for digits."""
    rows = spark.range(400).select(F.concat(F.expr("repeat('some prose of a document without numbers, ', 1000)"), F.lit("12,50 zł"), "id").alias("t")).cache()
    rows.count()

    def took(f):
        times = []
        for _ in range(3):
            began = time.time()
            rows.agg(F.sum(F.hash(f(F.col("t"))))).collect()
            times.append(time.time() - began)
        return min(times)

    whole = lambda t: F.concat(*[candidates.spans(t, p, "x") for p in (candidates.TAX_ID, candidates.DATE, candidates.AMOUNT)])
    assert took(candidates.all_spans) < took(whole) / 3


@pytest.mark.parametrize("unit", [" ", "1", "1 ", "- ", "123 ", "1,50 ", "1.234", "NIP "])
def test_candidates_take_linear_time(spark, unit):
    long = unit * (100_000 // len(unit))
    df = spark.createDataFrame([(long,)], "t string")
    began = time.time()
    for pattern in (candidates.TAX_ID, candidates.DATE, candidates.AMOUNT):
        df.select(F.size(candidates.spans(F.col("t"), pattern, "x"))).collect()
        df.select(F.col("t").rlike(pattern)).collect()
    assert time.time() - began < 12  # six jobs; the cubic pattern took 49 s for 2000 blanks


def spec_windows(hits, low, high, budget):
    out, used, cursor = [], 0, low
    for p in hits:
        a, b = max(p - fixed.RADIUS, low, cursor), min(p + fixed.RADIUS, high)
        n = min(b - a, budget - used)
        if used < budget and a < b:
            out.append((a, a + n))
            used, cursor = used + n, a + n
    return out


def test_windows_are_the_greedy_ones(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        low = rng.randrange(0, 500)
        high = low + rng.randrange(0, 2000)
        hits = sorted({rng.randrange(low, high + 1) for _ in range(rng.randrange(0, 30))})
        rows.append((i, hits, low, high, rng.randrange(-5, 900)))
    df = spark.createDataFrame(rows, "i int, hits array<int>, low int, high int, b int")
    got = df.select("i", windowing.selected(*[F.col(c) for c in ("hits", "low", "high", "b")]).alias("w")).collect()
    for r in got:
        assert [(w["a"], w["b"]) for w in r["w"]] == spec_windows(*rows[r["i"]][1:]), rows[r["i"]]


def test_context_keeps_a_hit_in_the_middle(spark):
    body = "lorem ipsum " * 400 + "NIP 526-000-12-46 kwota 12,50 zł " + "dolor sit " * 400
    df = spark.createDataFrame([(1, body, 1000), (2, "short", 1000), (3, None, 1000)], "id int, t string, b int")
    got = {r["id"]: r for r in windowing.with_context(df, "t", "b").collect()}
    assert "526-000-12-46" in got[1]["context"] and fixed.OMITTED in got[1]["context"]
    assert got[2]["context"] == "short" and got[3]["context"] is None
    assert windowing.context_tokens(2048, 1000, 900, 300) == 384 and windowing.context_tokens(100, 1000, 0, 300) == 200


def plain_context(clean, budget):
    """The context of a text, character by character as it is described."""
    if len(clean) <= budget:
        return clean
    head, tail_n = int(budget * fixed.HEAD_SHARE), int(budget * fixed.TAIL_SHARE)
    tail = max(head, len(clean) - tail_n)
    region, hits = clean[head:tail], set()
    for pattern in (candidates.KEYWORD, candidates.TAX_ID, candidates.DATE, candidates.AMOUNT_PLAIN):
        for m in re.finditer(pattern.replace("(?iU)", ""), region, re.I):
            if pattern != candidates.TAX_ID or len(re.sub(r"\D", "", m.group())) == 10:
                hits.add(m.start() + head)
    windows = spec_windows(sorted(hits), head, tail, budget - head - (len(clean) - tail))
    parts = [clean[:head], *(clean[a:b] for a, b in windows), clean[tail:]]
    return fixed.OMITTED.join(p for p in parts if p.strip())


def test_contexts_are_the_plain_ones(spark):
    rng = random.Random(8)
    parts = ["lorem ", "ipsum dolor ", "NIP 526-000-12-46 ", "12.03.2024 ", "1 234,50 zł ", "razem ", "termin płatności ", "\n", "   ", "due date March 5, 2025 "]
    rows = [(i, "".join(rng.choice(parts if rng.random() < 0.2 else parts[:2]) for _ in range(rng.randrange(1, 900))), rng.choice([50, 400, 1500])) for i in range(80)]
    got = windowing.with_context(spark.createDataFrame(rows, "id int, t string, b int"), "t", "b").collect()
    assert len(got) == 80
    for r in got:
        assert r["context"] == plain_context(r["t"], r["b"]), r["id"]


ANSWER = {"doc_type": "invoice", "counterparty_name": "ACME", "counterparty_tax_id": "PL 526-000-12-46", "issue_date": "2024-03-12", "due_date": None, "gross_amount": 1234.565, "currency": "zł", "summary": "An invoice."}
SOURCE = "Acme\nNIP 526-000-12-46, 12.03.2024, razem 1 234,57 zł"


def test_validation(spark):
    cases = [
        (ANSWER, SOURCE), (ANSWER, "nothing here"), (ANSWER | {"doc_type": "memo"}, SOURCE), (ANSWER | {"currency": "$"}, SOURCE),
        (ANSWER | {"summary": " "}, SOURCE), (ANSWER | {"issue_date": "12.03.2024"}, SOURCE), (ANSWER | {"counterparty_name": 5}, SOURCE), (None, SOURCE),
    ]
    df = spark.createDataFrame([(i, json.dumps(a) if a else None, s) for i, (a, s) in enumerate(cases)], "i int, raw string, source string")
    got = {r["i"]: r for r in validation.validated(df, "raw", "source").collect()}
    assert (got[0]["counterparty_tax_id"], got[0]["gross_amount"], got[0]["currency"], got[0]["nulled_fields"]) == ("5260001246", Decimal("1234.57"), "PLN", [])
    assert got[1]["nulled_fields"] == ["counterparty_name", "counterparty_tax_id", "issue_date", "gross_amount"]
    assert got[3]["nulled_fields"] == ["currency", "gross_amount"] and got[3]["gross_amount"] is None
    assert [got[i]["needs_repair"] for i in range(8)] == [False, False, True, False, True, True, True, True]
    assert got[4]["error"] == "summary is empty"


def test_no_answer_stops_a_run(spark):
    """Numbers of any length and lone surrogates are answers like any other."""
    long = '{"doc_type": "invoice", "summary": "s", "gross_amount": ' + "9" * 5000 + "}"
    lone = json.dumps(ANSWER | {"counterparty_name": "Acme \ud800", "summary": "\udfff!", "\ud801": 1})
    rows = [(0, long), (1, lone), (2, '{"doc_type": "invoice", "summary": "s", "gross_amount": NaN}'), (3, "[" * 100_000), (4, '{"doc_type": ["\\ud800"]}'), (5, '{"gross_amount": 1' + "0" * 6000)]
    df = spark.createDataFrame([(i, r, SOURCE) for i, r in rows], "i int, raw string, source string")
    got = {r["i"]: r for r in validation.validated(df, "raw", "source").collect()}
    assert got[0]["gross_amount"] is None and not got[0]["needs_repair"]
    assert got[1]["summary"] == "\ufffd!" and got[1]["nulled_fields"] == ["counterparty_name"]
    assert [got[i]["needs_repair"] for i in range(2, 6)] == [False, True, True, True]
    assert text.sound("a\ud83d\ude00b") == "a\U0001f600b"


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=5), c, max_size=3)))
def test_parsing_never_raises(value):
    out, error = validation.parsed(json.dumps(value))
    assert (out is None) != (error is None)


def test_formats_and_extraction():
    assert [formats.detect(x) for x in (b"%PDF-1.4", b"PK\x03\x04", b"From: a\nTo: b\n\nhi", b"<html> x", b"", b"plain words here", bytes(range(256)) * 4)][:6] == ["pdf", "docx", "eml", "html", "txt", "txt"]
    assert extract.outcome("html", b"<title>t</title><p>a &amp; b</p><script>x</script>c")["source_text"] == "a & bc"
    assert extract.outcome("txt", b" \n ")["reason"] == "empty_text"
    assert extract.outcome("docx", b"PK\x03\x04junk")["reason"] == "corrupt_file"
    assert extract.outcome("unknown", b"\x00")["reason"] == "unsupported_format"
    mail = b"From: a@b.c\nTo: d@e.f\nMIME-Version: 1.0\nContent-Type: text/plain\n\nhello\n"
    assert extract.outcome("eml", mail)["source_text"].strip() == "hello"


def test_isolated_extraction_is_stopped_and_goes_on():
    with extract.Isolated() as isolated:
        assert isolated("txt", b"hello")["source_text"] == "hello"
        first = isolated.process.pid
        assert isolated("html", b"<p>a")["source_text"] == "a" and isolated.process.pid == first
        assert isolated("txt", b"x" * 2_000_000, 1e-6)["reason"] == "parse_timeout"
        assert isolated("txt", b"again")["source_text"] == "again" and isolated.process.pid != first
        isolated.process.kill()
        assert isolated("txt", b"x")["reason"] in (None, "corrupt_file")
        assert isolated("txt", b"once more")["source_text"] == "once more"


def test_long_texts_are_read_at_both_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixed, "TEXT_CAP", 200)
    (tmp_path / "big.txt").write_text("head " + "x" * 5000 + " tail")
    data = (tmp_path / "big.txt").read_bytes()
    whole = lambda tail: archive.read(io.BytesIO(data), "txt", len(data), tail)
    assert whole(False) == data[:200]
    assert whole(True).startswith(b"head ") and whole(True).endswith(b" tail") and len(whole(True)) == 200 and archive.GAP in whole(True)


def corpus(root):
    (root / "sub").mkdir()
    (root / "a.txt").write_text("Invoice from Acme, NIP 526-000-12-46, 12.03.2024, 100,00 zł")
    (root / "sub" / "copy.html").write_text("<html><body>INVOICE from Acme,\n NIP 526-000-12-46, 12.03.2024, 100,00 zł</body></html>")
    (root / "b.txt").write_text("Offer by Beta of 2024-05-06 for 20.00 EUR")
    (root / "empty.txt").write_text("")
    (root / unicodedata.normalize("NFD", "żółw.txt")).write_text("A third letter")


def inventoried(spark, path, **options):
    found = archive.entries(spark, path, **options)
    return archive.inventory(found, archive.texts(found, path))


def test_archive_folder_and_zip_agree(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    corpus(root)
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        for p in sorted(root.rglob("*.*")):
            z.write(p, p.relative_to(root).as_posix())
    rows = [inventoried(spark, str(p)).orderBy("path").collect() for p in (root, tmp_path / "in.zip")]
    assert [(r["path"], r["document_id"], r["reason"]) for r in rows[0]] == [(r["path"], r["document_id"], r["reason"]) for r in rows[1]]
    by = {r["path"]: r for r in rows[0]}
    assert by["a.txt"]["document_id"] == by["sub/copy.html"]["document_id"]
    assert by["empty.txt"]["reason"] == "empty_text" and unicodedata.normalize("NFC", "żółw.txt") in by
    big = inventoried(spark, str(root), ceiling=5).where("path = 'a.txt'").first()
    assert big["reason"] == "corrupt_file" and big["format"] == "unknown"
    with pytest.raises(Exception, match="directory or a zip"):
        archive.entries(spark, str(root / "a.txt")).collect()


def test_budget_prefix_is_the_running_sum(spark):
    rng = random.Random(5)
    rows = [(f"{rng.getrandbits(64):016x}", rng.randrange(1, 50)) for _ in range(500)]
    got = ledger.budget_prefix(spark.createDataFrame(rows, "id string, cost int"), "cost", 4000, 17).orderBy("id").collect()
    total, want = 0, []
    for k, c in sorted(rows):
        total += c
        if total <= 3983:
            want.append((k, total))
    assert [(r["id"], r["running"]) for r in got] == want


def test_budget_prefix_with_more_columns(spark):
    """Ranges don't depend on which columns a branch of the plan keeps."""
    rows = spark.range(600_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit(1).alias("cost"), F.col("id").alias("_range"), F.lit("x").alias("_sum")).repartition(7)
    got = ledger.budget_prefix(rows, "cost", 200_000, 0)
    place = rows.select("id", F.row_number().over(Window.orderBy("id")).alias("place"))
    both = got.join(place, "id")
    assert got.columns == ["id", "cost", "_range", "_sum", "running"] and got.count() == 200_000
    assert both.where("running <> place").count() == 0


def state_of(spark, tmp_path, name):
    return runs.State(spark, f"file://{tmp_path}/{name}")


def test_run_report_resume_and_eval(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    corpus(root)
    good = json.dumps(ANSWER | {"counterparty_name": None, "counterparty_tax_id": None, "gross_amount": "100.00"})
    state = state_of(spark, tmp_path, "state")
    make = lambda: inference.Resilient(inference.Fake((good,)))
    assert runs.run(state, str(root), Config(limit=1, workers=2), make=make) == (1, "limit_reached")
    assert runs.run(state, str(root), Config(budget=1, workers=2), make=make)[1] == "budget_exhausted"
    assert runs.run(state, str(root), Config(workers=2), make=make) == (3, "completed")
    assert state.read("usages").count() == 3  # no call was made twice
    row = ledger.report(state.read("files"), state.documents(), state.runs(), state.ledger()).first()
    assert (row["input_files"], row["unique_documents"], row["duplicate_files"]) == (5, 4, 1)
    assert (row["processed_ok"], row["quarantined"], row["not_started"]) == (3, 1, 0)
    assert row["quarantine_by_reason"] == {"empty_text": 1} and row["stop_reason"] == "completed"
    (tmp_path / "g.jsonl").write_text(json.dumps({"files": ["a.txt", "sub/copy.html"], "doc_type": "invoice", "gross_amount": "100.00", "currency": "PLN", "issue_date": "2024-03-12", "summary": ""}) + "\n\n")
    pairs = evaluation.matched(golden(spark, str(tmp_path / "g.jsonl")), state.read("files"), state.documents())
    assert all(r["correct"] == 1 for r in evaluation.scored(pairs).collect())
    assert evaluation.summary(pairs).first()["not_found"] == 0


def test_copies_are_extracted_once_and_known_bytes_never_again(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    corpus(root)
    for i in range(6):
        (root / f"copy{i}.txt").write_bytes((root / "b.txt").read_bytes())
    found = archive.entries(spark, str(root))
    taken = archive.texts(found, str(root))
    assert taken.count() == len({p.read_bytes() for p in root.rglob("*.*")}) == 5
    state = state_of(spark, tmp_path, "copies")
    runs.take_inventory(state, str(root))
    assert (state.read("files").count(), state.documents().count()) == (11, 4)
    (root / "late.txt").write_bytes((root / "b.txt").read_bytes())
    (root / "a.txt").write_text("changed")  # the first mapping of a path stays
    runs.take_inventory(state, str(root))
    files = {r["path"]: r["document_id"] for r in state.read("files").collect()}
    assert len(files) == 12 and files["late.txt"] == files["b.txt"] and state.documents().count() == 4


def test_stream_of_files_equals_a_scan(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    corpus(root)
    state, whole = state_of(spark, tmp_path, "stream"), state_of(spark, tmp_path, "scan")
    go = lambda: arrivals.ingest(state, str(root), f"file://{tmp_path}/checkpoint", files_a_batch=2).awaitTermination()
    go()
    (root / "new one.txt").write_text("Another letter")
    go()
    go()
    runs.take_inventory(whole, str(root))
    rows = lambda s: sorted(tuple(r) for r in s.read("files").select("path", "document_id", "byte_sha256", "format").collect())
    assert rows(state) == [r for r in rows(whole) if r[0] != "empty.txt"] and len(rows(whole)) == 6
    runs.take_inventory(state, str(root))
    assert rows(state) == rows(whole)
    ids = lambda s: sorted((r["id"], r["status"]) for r in s.documents().collect())
    assert ids(state) == ids(whole)


def test_invalid_answers_are_repaired_once_then_quarantined(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("some words")
    state = state_of(spark, tmp_path, "bad")
    assert runs.run(state, str(root), Config(workers=1))[1] == "completed"
    assert state.documents().first()["quarantine_reason"] == "llm_invalid_output" and state.read("usages").count() == 2
    other = state_of(spark, tmp_path, "down")
    down = lambda: inference.Resilient(inference.Fake(always_fail=True), wait=0)
    assert runs.run(other, str(root), Config(workers=1), make=down)[1] == "backend_unavailable"
    assert other.documents().first()["status"] == "pending"


def test_breaker_and_retries():
    waits = []
    c = inference.Resilient(inference.Fake(("ok",), fail_first=2), sleep=waits.append)
    assert c.complete("p", 5).text == "ok" and waits == [1.0, 2.0]
    c = inference.Resilient(inference.Fake(always_fail=True), threshold=2, sleep=waits.append)
    with pytest.raises(inference.Unavailable):
        c.complete("p", 5)
    assert c.open and c.inner.calls == 2


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[run]\nworkers = 2\nlimit = 0\n[backend]\nname = "ollama"\n[backend.ollama]\nmodel_tag = "m"\n[pricing.ollama]\ninput_per_million = 1.5\n')
    c = load(str(p))
    assert (c.workers, c.limit, c.backend, c.model, c.prices) == (2, None, "ollama", "m", (1.5, 0.0))
    with pytest.raises(NotImplementedError):
        inference.client_of("nope", {})
