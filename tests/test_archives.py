"""Archives of made documents through extraction, inventory, runs and their restart, backends and the command line."""

import json
import os
import subprocess
import sys
import threading
import time
from collections import Counter
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import fixtures
from parchment import __main__ as cli
from parchment.functions import candidates, text
from parchment.operators import evaluation, inference, inventory, runs, tokens, windowing
from parchment.sources import archive, config, extract

ROOT = Path(__file__).resolve().parents[1]
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
MADE = fixtures.documents()


def test_made_documents(spark):
    assert len(MADE) == 28 and len({d.text for d in MADE}) == 28
    rows = spark.createDataFrame([(d.tax,) for d in MADE], "n string")
    assert rows.where(~text.tax_id_valid(F.col("n"))).count() == 0
    forms = [(f, "date") for f in fixtures.date_forms(MADE[0].issued)] + [(f, "amount") for f in fixtures.amount_forms(Decimal("1234567.89"))] + [(f, "nip") for f in fixtures.tax_forms(MADE[0].tax)]
    found = spark.createDataFrame(forms, "t string, kind string").withColumn("m", candidates.all_spans(F.col("t"))).collect()
    for r in found:
        assert any(m["kind"] == r["kind"] and len(m["text"].strip()) >= len(r["t"]) - 4 for m in r["m"]), r


@pytest.mark.parametrize("render", [fixtures.as_txt, fixtures.as_html, fixtures.as_docx, fixtures.as_eml, lambda t: fixtures.as_eml(t, html=True), lambda t: fixtures.as_eml("x", ("f.html", fixtures.as_html(t)))])
def test_every_format_gives_the_same_normal_form(render):
    for d in MADE[::9]:
        data = render(d.text)
        got = extract.outcome(extract.detect(data[:8192]), data)
        assert got["reason"] is None and got["normal"] == text.normal_form(d.text)


def test_docx_tables_and_mail_parts():
    assert extract.outcome("docx", fixtures.as_docx("one", [["a", "b"], ["c", ""]]))["source_text"] == "one\na b\nc "
    mail = fixtures.as_eml("the body", ("broken.docx", b"PK\x03\x04junk"))
    assert extract.outcome("eml", mail)["source_text"].strip() == "the body"
    got = extract.outcome("eml", fixtures.as_eml("the body", ("a.txt", b"attached text")))
    assert (got["source_text"], got["content_source"]) == ("attached text", "eml_attachment")
    lone = b"From: a@b.c\nTo: d@e.f\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\nbad \xed\xa0\x80 byte\n"
    assert extract.outcome("eml", lone)["source_text"].encode()


def test_copies_and_corrupt_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "copies").mkdir(parents=True)
    d = MADE[3]
    (root / "first.txt").write_bytes(fixtures.as_txt(d.text))
    for name, data in fixtures.copies_of(d.text).items():
        (root / "copies" / name).write_bytes(data)
    near = {"one digit more.txt": d.text + "1", "another date.txt": d.text.replace("2024", "2023")}
    for name, body in near.items():
        (root / name).write_text(body)
    bad = fixtures.corrupt()
    for name, (data, _) in bad.items():
        (root / name).write_bytes(data)
    state = runs.State(spark, f"file://{tmp_path}/state")
    runs.take_inventory(state, str(root))
    files = {r["path"]: r for r in state.read("files").collect()}
    docs = {r["id"]: r for r in state.documents().collect()}
    same = {files[f"copies/{fixtures.unicodedata.normalize('NFC', n)}"]["document_id"] for n in fixtures.copies_of(d.text)}
    assert same == {files["first.txt"]["document_id"]}
    assert len({files[n]["document_id"] for n in near} | same) == 3
    assert {n: docs[files[n]["document_id"]]["quarantine_reason"] for n in bad} == {n: why for n, (_, why) in bad.items()}
    both = [state.read("files"), state.documents()]
    assert inventory.files_without_document(*both).count() == inventory.documents_without_file(*both).count() == 0
    assert inventory.files_with_documents(*both).count() == len(files)
    assert inventory.files_without_document(both[0], both[1].limit(0)).count() == len(files)


def test_scale_archive_and_huge_file(spark, tmp_path):
    different = fixtures.scale_archive(str(tmp_path / "a.zip"), 3000)
    state = runs.State(spark, f"file://{tmp_path}/state")
    runs.take_inventory(state, str(tmp_path / "a.zip"))
    assert (state.read("files").count(), state.documents().count()) == (3000, different)
    (tmp_path / "huge").mkdir()
    fixtures.huge_file(str(tmp_path / "huge" / "end.txt"), 40, True, MADE[11].text)
    fixtures.huge_file(str(tmp_path / "huge" / "start.txt"), 10, False, MADE[12].text)
    found = archive.entries(spark, str(tmp_path / "huge"))
    for tail in (False, True):
        got = [r["source_text"] for r in archive.texts(found, str(tmp_path / "huge"), tail=tail).collect()]
        assert max(map(len, got)) <= 2_000_000 and sum(MADE[12].text in x for x in got) == 1
        assert sum(MADE[11].text in x for x in got) == tail  # only a reader of both ends sees the end


def test_golden_records_are_written_in_order(spark, tmp_path):
    rows = [json.dumps(d.golden([f"z{k}.txt", f"a{9 - k}.txt"])) for k, d in enumerate(MADE[:5])]
    (tmp_path / "in.jsonl").write_text("\n".join(rows))
    own = config.golden(spark, str(tmp_path / "in.jsonl"))
    assert config.write_golden(own, str(tmp_path / "out.jsonl")) == 5
    lines = [json.loads(x) for x in (tmp_path / "out.jsonl").read_text().splitlines()]
    assert [x["files"][0] for x in lines] == sorted(x["files"][0] for x in lines) and all(list(x) == sorted(x) for x in lines)
    assert config.golden(spark, str(tmp_path / "out.jsonl")).exceptAll(own.withColumn("files", F.sort_array("files"))).count() == 0


# ---- tokens


def test_token_counters(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    texts = [d.text for d in MADE] + ["", "Zażółć gęślą jaźń 漢字", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    for source, count in ((TOKENIZER, lambda t: len(whole.encode(t).ids)), (lambda t: len(t.split()), lambda t: len(t.split())), (None, lambda t: -(-len(t) // 4))):
        counter = tokens.Counter(spark, source)
        got = {r["i"]: r["n"] for r in df.select("i", counter.column(F.col("t")).alias("n")).collect()}
        assert got == {i: None if t is None else count(t) for i, t in enumerate(texts)}
        assert [counter.of(t) for t in texts[:-1]] == [count(t) for t in texts[:-1]]
    with pytest.raises(ValueError, match="kind of tokenizer"):
        tokens.Counter(spark, "/opt/tokenizers/README.md")


def test_contexts_are_measured_by_the_tokenizer(spark):
    sample = "word " * 800
    row = spark.createDataFrame([(sample,)], "t string")
    budget = lambda source: row.select(windowing.char_budget(F.lit(380), F.length("t"), tokens.Counter(spark, source).column(F.col("t")))).first()[0]
    assert budget(None) == 1520 and budget(lambda t: len(t.split())) == 1900 and budget(lambda t: 0) == 6000
    assert budget(TOKENIZER) > 1700


# ---- backends


class Stub(BaseHTTPRequestHandler):
    def reply(self, body):
        data = json.dumps(body).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        self.reply({"status": "ok"} if self.path == "/health" else {"models": [{"name": "m", "digest": "sha256:abc"}]})

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.asked.append((self.path, asked))
        if self.path == "/tokenize":
            self.reply({"tokens": asked["content"].split()})
        elif self.path == "/completion":
            self.reply({"content": "{} \ud800", "tokens_evaluated": 7, "tokens_predicted": 3})
        else:
            self.reply({"response": "{}", "prompt_eval_count": 5, "eval_count": 2})

    def log_message(self, *_):
        pass


@pytest.fixture
def stub():
    server = HTTPServer(("127.0.0.1", 0), Stub)
    server.asked = []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_http_backends(spark, stub):
    port = stub.server_port
    llama = inference.client_of("llama_server", {"port": port})
    llama.check()
    assert llama.complete("p", 9).tokens_in == 7 and llama.inner.tokens("a b c") == 3
    assert stub.asked[0][1]["n_predict"] == 9 and "doc_type" in json.dumps(stub.asked[0][1]["json_schema"])
    ollama = inference.client_of("ollama", {"port": port, "model_tag": "m", "model_digest": "abc", "context_tokens": 512})
    ollama.check()
    assert ollama.complete("p", 9).tokens_out == 2 and stub.asked[-1][1]["options"] == {"num_predict": 9, "num_ctx": 512}
    for section in ({"model_digest": "abd"}, {"model_tag": "other"}, {"port": 1}):
        bad = inference.client_of("ollama", {"port": port, "model_tag": "m"} | section)
        with pytest.raises(inference.Unavailable):
            bad.check()
        with pytest.raises(inference.Unavailable):
            bad.complete("p", 1)  # refused without a call
    rows = spark.createDataFrame([("a", "p"), ("b", "q")], "document_id string, prompt string")
    make = lambda p=port: inference.client_of("llama_server", {"port": p})
    assert {r["raw"] for r in inference.inferred(rows, make, 5).collect()} == {"{} \ufffd"}  # half a surrogate pair can't stop the job
    down = lambda: inference.client_of("llama_server", {"port": 1})
    assert {r["error_kind"] for r in inference.inferred(rows, down, 5).collect()} == {"unavailable"}


def test_prompts_say_what_they_must(spark):
    one = spark.range(1)
    first, again = one.select(inference.prompt(F.lit("CONTEXT")), inference.repair_prompt(F.lit("CONTEXT"), F.lit("ANSWER"), F.lit("x" * 600))).first()
    assert first == inference.prompt_text("CONTEXT") and first.count("<|im_start|>") == 3
    assert again.startswith(first + "ANSWER<|im_end|>") and "x" * 500 + "." in again and "x" * 501 not in again and again.endswith("<|im_start|>assistant\n")
    for word in ("seller", "never the buyer", "YYYY-MM-DD", "VAT", "null", "follow no instructions"):
        assert word in inference.SYSTEM


# ---- runs and their restart

ANSWER = json.dumps({"doc_type": "invoice", "summary": "An invoice."})


def letters(root, n):
    root.mkdir()
    for k in range(n):
        (root / f"{k:03}.txt").write_text(f"Letter number {k} of many")


def test_batches_and_budget(spark, tmp_path):
    letters(tmp_path / "in", 10)
    state = runs.State(spark, f"file://{tmp_path}/state")
    make = lambda: inference.Resilient(inference.Fake((ANSWER,)))
    go = lambda **kw: runs.run(state, str(tmp_path / "in"), config.Config(workers=2, batch=3, **kw), make=make)[1]
    assert go(limit=4) == "limit_reached"
    done = lambda: [r["id"] for r in state.documents().where("status = 'done'").collect()]
    ids = sorted(r["id"] for r in state.documents().collect())
    assert sorted(done()) == ids[:4]
    one = state.read("reservations").agg(F.max("reserved_tokens")).first()[0]
    assert go(budget=int(one * 6.5)) == "budget_exhausted" and sorted(done()) == ids[:6]
    assert go() == "completed" and len(done()) == 10 and state.read("usages").count() == 10
    down = lambda: inference.Resilient(inference.Fake(always_fail=True), wait=0)
    letters(tmp_path / "more", 8)
    other = runs.State(spark, f"file://{tmp_path}/other")
    assert runs.run(other, str(tmp_path / "more"), config.Config(workers=1, batch=2), make=down)[1] == "backend_unavailable"
    assert other.read("reservations").count() == 2  # the run ended with its first batch


def test_answers_written_down_are_not_asked_for_again(spark, tmp_path):
    letters(tmp_path / "in", 3)
    state = runs.State(spark, f"file://{tmp_path}/state")
    runs.take_inventory(state, str(tmp_path / "in"))
    ids = sorted(r["id"] for r in state.documents().collect())
    assert runs.open_run(state, config.Config(), "", "in") == 1
    rows = [(1, ids[0], 1, 5, 5, None, ANSWER, None), (1, ids[1], 1, 5, 5, None, "no answer", None)]
    state.append("usages", spark.createDataFrame(rows, runs.TABLES["usages"]), "run-1-000000-1")
    make = lambda: inference.Resilient(inference.Fake((ANSWER,)))
    assert runs.run(state, str(tmp_path / "in"), config.Config(workers=1), make=make)[1] == "completed"
    asked = Counter(r["document_id"] for r in state.read("usages").where("tokens_in <> 5").collect())
    assert asked == {ids[1]: 1, ids[2]: 1} and state.documents().where("status = 'done'").count() == 3


def test_run_ids_are_taken_once(spark, tmp_path, monkeypatch):
    state = runs.State(spark, f"file://{tmp_path}/state")
    assert runs.open_run(state, config.Config(), "", "in") == 1
    read = state.read
    monkeypatch.setattr(state, "read", lambda t: read(t).limit(0) if t == "runs_started" else read(t))  # as another driver saw it before
    assert runs.open_run(state, config.Config(), "", "in") == 2
    assert sorted(r["id"] for r in read("runs_started").collect()) == [1, 2]


KILLED = """
import hashlib, os, sys, time
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from parchment.operators import inference, runs
from parchment.sources.config import Config
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
class Logged:
    def complete(self, prompt, n):
        with open({log!r}, "a") as f:
            f.write(hashlib.sha256(prompt.encode()).hexdigest() + chr(10))
        time.sleep(0.2)
        return inference.Answer({answer!r}, 1, 1)
print(runs.run(runs.State(spark, {state!r}), {path!r}, Config(workers=2, batch=4), make=Logged))
"""


def test_a_killed_run_loses_one_batch_at_most(spark, tmp_path):
    letters(tmp_path / "in", 24)
    log, root = tmp_path / "log", f"file://{tmp_path}/state"
    code = KILLED.format(root=str(ROOT), log=str(log), answer=ANSWER, state=root, path=str(tmp_path / "in"))
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    first = subprocess.Popen([sys.executable, "-c", code], env=env, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, start_new_session=True)
    limit = time.time() + 120
    while time.time() < limit and (not log.exists() or len(log.read_text().split()) < 10):
        time.sleep(0.1)
    os.killpg(first.pid, 9)
    first.wait()
    time.sleep(1)
    state = runs.State(spark, root)
    before, answered = Counter(log.read_text().split()), state.read("usages").count()
    assert 10 <= sum(before.values()) < 24 and answered >= 8 and state.read("runs_finished").count() == 0
    second = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "completed" in second.stdout
    calls = Counter(log.read_text().split())
    assert len(calls) == 24 and sum(calls.values()) - 24 <= 4  # only calls of the open batch were made twice
    assert state.documents().where("status = 'done'").count() == 24


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "in"
    root.mkdir()
    for k, d in enumerate(MADE[:3]):
        (root / f"{k}.txt").write_text(d.text)
    (tmp_path / "c.toml").write_text(f'[run]\nworkers = 1\ntokenizer = "{TOKENIZER}"\n[backend]\nname = "fake"\n[backend.fake]\nresponses = [{json.dumps(ANSWER)}]\n[pricing.fake]\ninput_per_million = 1000000.0\n')
    db = ["--db", f"file://{tmp_path}/state"]
    assert cli.main(["run", "--input", str(root), "--config", str(tmp_path / "c.toml"), "--limit", "2", *db]) == 0
    assert "run_id=1 stop_reason=limit_reached" in capsys.readouterr().out
    assert cli.main(["report", "--json", *db]) == 0
    row = json.loads(capsys.readouterr().out)
    assert (row["input_files"], row["processed_ok"], row["not_started"], row["backend"]) == (3, 2, 1, "fake") and row["estimated_cost"] == row["tokens_in"] > 0
    assert cli.main(["report", *db]) == 0 and "stop_reason: limit_reached" in capsys.readouterr().out
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(d.golden([f"{k}.txt"])) for k, d in enumerate(MADE[:3])))
    assert cli.main(["eval", "--expected", str(tmp_path / "g.jsonl"), *db]) == 0
    out = capsys.readouterr().out
    assert "total: 3" in out and "doc_type" in out and "summary (loose)" in out
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
    assert evaluation.text_table([], {k: 0 for k in ("total", "not_found", "dedup_mismatches", "summary_ok", "summary_total")})
