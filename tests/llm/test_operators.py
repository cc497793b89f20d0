"""Every operator against brute force, and its defined results for nulls, empties, long texts, ties and clashing names."""

import base64
import collections
import gzip
import hashlib
import logging
import math
import random
import re
import zipfile
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from parchment.llm import (
    components, graphs, labels, minhash, mixing, quality, queries, rollups, rules, sentencepiece_sampling as sampling, simhash, store, substrings, toxicity, warc,
)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, sig int, component string, failed int, anchor string, weight string, rank int, key string, node string, salt int, _n int"


def sentences(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    passage = sentences(rng, 60)
    base = [sentences(rng, rng.randrange(1, 90)) for _ in range(40)]
    out = dict(enumerate(base))
    out |= {40: base[3], 41: base[3] + "  extra\n", 42: passage, 43: f"x {passage} y", 44: sentences(rng, 20) + " " + passage, 45: "", 46: None}
    out |= {47: " \n\t ", 48: "one two", 49: " é漢字 \U0001f600 naïve", 50: sentences(rng, 30_000), 51: "w" * 20_000, 52: "a b " * 400, 53: "line one here\nline one here\n" * 9}
    out |= {54: "### $$$ %%% ||| " * 20, 55: "   leading and  double  spaces "}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs = ["en", "de", None]
    rows = [(i, t, langs[i % 3], f"s{i % 4}" if i % 5 else None, len(t or "")) + ("clash", 1, "c", 7, "a", "w", 3, "k", "n", 5, 9) for i, t in texts.items()]
    rows += [rows[3], rows[3], (3, "another text of document three", "en", "s1", 30) + rows[0][5:], (None, texts[42], "en", "s1", 5) + rows[0][5:], (None, None, None, None, None) + rows[0][5:]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def toks(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


# ---- 5


def rule_truth(x):
    w = toks(x)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = collections.Counter(grams)
    covered = {p for k, g in enumerate(grams) if n[g] > 1 for p in range(k, k + 8)}
    lines = [y for y in (x or "").split("\n") if toks(y)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(covered)


def test_rules(docs, empty):
    rows = rules.judged(rules.ledger(docs.select("doc_id", "text", "failed"))).collect()
    assert len(rows) == docs.count()
    of = {(r["doc_id"], r["text"]): r for r in docs.collect()}
    truth = collections.Counter((r["doc_id"], *rule_truth(r["text"])) for r in docs.collect())
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert truth == collections.Counter((r["id"], *(r[c] for c in names)) for r in rows) and of
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert rules.judged(rules.ledger(empty)).count() == 0 and rules.accepted(empty).columns == empty.columns
    kept = rules.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    led = rules.ledger(docs.select("doc_id", "text"))
    for a in rules.ablations(led).collect():
        bit, every = rules.mask([a["rule"]]), rules.mask(list(rules.POLICIES[a["policy"]]))
        failed = [r["failed"] for r in led.collect()]
        assert (a["n_failed"], a["n_only"]) == (sum(bool(f & bit) for f in failed), sum(f & every == bit for f in failed))


# ---- 9 and components


def joined(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    df = spark.createDataFrame(pairs + [(None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    want = joined(pairs, {x for p in pairs if p[0] != p[1] for x in p})
    assert got == want
    assert components.components(df.limit(0)).count() == 0


def test_simhash(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    fps = collections.defaultdict(set)
    for r in docs.where("doc_id is not null").collect():
        fps[r["doc_id"]].add(simhash.fingerprint((r["text"] or "").encode(), 3))
    pairs = [(a, b) for a in fps for b in fps if a < b and any((x ^ y).bit_count() <= 2 for x in fps[a] for y in fps[b])]
    want = joined(pairs, fps)
    for r in rows:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert len(r["fingerprint"]) == 16
    assert want[40] == want[3] and {r["fingerprint"] for r in rows if r["doc_id"] in (45, 46, 47)} == {"0" * 16}
    assert simhash.near_duplicates(empty).count() == 0
    once = simhash.deduplicated(docs)
    assert once.columns == docs.columns
    ids = [r["doc_id"] for r in once.collect()]
    assert collections.Counter(x for x in ids if x is not None) == dict.fromkeys((k for k, v in want.items() if k == v), 1) and ids.count(None) == 2


def test_fingerprints_are_those_of_spark_hashes(docs):
    """Shingles and majorities by native expressions, hashes by Spark's own XXH64 with seed 42."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    rows = docs.where("length(coalesce(text, '')) < 20000").select("doc_id", "text", words.alias("w"))
    whole = F.when(F.size("w") > 0, F.array(F.array_join("w", " "))).otherwise(F.array().cast("array<string>"))
    grams = F.when(F.size("w") < 3, whole).otherwise(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda k: F.array_join(F.slice("w", k, 3), " ")))
    hashed = rows.select("doc_id", "text", F.transform(grams, lambda g: F.xxhash64(g)).alias("h"))
    got = simhash.fingerprints(docs).select(F.col("id"), F.hex("fp").alias("fp"))
    have = collections.defaultdict(set)
    for r in got.collect():
        have[r["id"]].add(int(r["fp"], 16))
    n = 0
    for r in hashed.collect():
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r["h"]) > len(r["h"]))
        assert want in have[r["doc_id"]], r["doc_id"]
        n += want != 0
    assert n > 40


def test_repeated_ids_with_maps_are_put_in_order(spark):
    rows = [(1, "a b c d e f g", {"k": 2}), (1, "a b c d e f g", {"k": 1}), (2, "other words in this one here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    for once in (simhash.deduplicated(df), minhash.deduplicated(df)):
        assert sorted((r["doc_id"], (r["m"] or {}).get("k")) for r in once.collect()) == [(1, 1), (2, None)]


def test_ball_links_planted_fingerprints(spark):
    rng = random.Random(3)
    for radius in range(5):
        fps = [rng.getrandbits(64) for _ in range(25)]
        for f in list(fps):
            for _ in range(3):
                g = f
                for b in rng.sample(range(64), rng.randrange(1, 6)):
                    g ^= 1 << b
                fps.append(g)
        signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
        found = components.components(simhash.links(spark.createDataFrame(signed, "id long, fp long"), radius)).collect()
        want = joined([(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius], range(len(fps)))
        got = {r["node"]: r["component"] for r in found}
        assert all(got.get(n, n) == c for n, c in want.items()), radius


# ---- 7


def test_substrings(docs, empty, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    first = {}
    for i, x in rows:
        w = toks(x)
        for k in range(len(w) - 12):
            if i is not None:
                g = tuple(w[k : k + 13])
                first[g] = min(first.get(g, i), i)
    want = collections.Counter()
    for i, x in rows:
        w = toks(x)
        gone = {p for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        left = " ".join(y for k, y in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()] += 1
    for crowd, shard in ((substrings.CROWD, substrings.SHARD), (1, 2)):  # the second deals all passages by whole windows, to many automata
        monkeypatch.setattr(substrings, "CROWD", crowd)
        monkeypatch.setattr(substrings, "SHARD", shard)
        got = substrings.without_repeats(docs).collect()
        assert collections.Counter((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert sum(r["n_removed"] for r in got) > 150
    assert substrings.without_repeats(empty).count() == 0
    clean = substrings.cleaned(docs)
    assert clean.schema == docs.schema and clean.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect() if r["text"] is not None)


def test_automata_are_what_locates(docs):
    texts, copies = substrings.split_copies(docs)
    assert {r["id"] for r in copies.collect()} == {40}
    found = substrings.passages(texts)
    known = substrings.phrases(found)
    rows = known.collect()
    assert rows and all(len(r["firsts"]) == len(r["text"].split(b" ")) - 12 and any(x is not None for x in r["firsts"]) for r in rows)
    assert substrings.located(found, known).count() > 0 and substrings.located(found, known.limit(0)).count() == 0
    line = "a b c d e f g h i j k l m n"
    assert list(substrings.confirmed([(line.encode(), 1, 1), (line.replace("a", "x").encode(), 2, 3)])) == [[None, 1], [2, None]]
    assert list(substrings.confirmed([(line.encode()[:25], 4, 4)])) == [[None]]


# ---- 10


def page_rows():
    out = [(i, f"http://x/{i}", f"<p>{i % 7}é</p>" * 50) for i in range(40)]
    return out + [(100, None, None), (101, "u", ""), (102, "u\r\nX-Page-ID: 9", "a\r\n\r\nWARC/1.1"), (None, "n", out[3][2]), (5, "again", "other")]


def test_warc(spark):
    pages = spark.createDataFrame([(*r, 1, "x") for r in page_rows()], "page_id long, url string, html string, salt int, sha string")
    got = warc.archived(spark, pages).collect()
    groups = collections.defaultdict(list)
    for i, _, h in page_rows():
        if i is not None:
            groups[h or ""].append(i)
    want = collections.Counter()
    for i, _, h in page_rows():
        data = (h or "").encode()
        last = None if i is None or max(groups[h or ""]) == i else max(groups[h or ""])
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[i, len(data), sha, "response" if last is None else "revisit", last] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert warc.archived(spark, pages.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.archived(spark, pages, min_payload=10**6).collect()} == {"response"}


def foreign(path, index="indexes/index.cdx", lines=None):
    """An archive of two members with records, made by the standard library, and what it holds."""
    records, found, z = {}, [], zipfile.ZipFile(path, "w")
    for name in ("archive/one.warc.gz", "archive/two.warc"):
        data, at = b"", []
        for k in range(40):
            body = f"<p>{name} {k}</p>".encode() * 30
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
            kind = "warcinfo" if k == 0 else "response"
            head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://{name}/{k}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
            own = head.encode() + block + b"\r\n\r\n"
            own = gzip.compress(own) if name.endswith("gz") else own
            at.append((len(data), len(own)))
            data += own
            if k:
                records[f"http://{name}/{k}"] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        z.writestr(name, data)
        found += [(name.rpartition("/")[2], *x) for x in reversed(at)]
    cdx = " CDX N b a m s k r M S V g\n" + "".join(f"k 2020 u text/html 200 d - - {n} {o} {f}\n" for f, o, n in found)
    cdxj = '!meta 0 {"software": "x"}\n' + "".join(f'k 2020 {{"offset": "{o}", "length": "{n}", "filename": "{f}"}}\n' for f, o, n in found)
    if index:
        z.writestr(index, gzip.compress((cdxj if "cdxj" in index else cdx).encode()) if index.endswith("gz") else cdxj if "cdxj" in index else cdx)
    z.close()
    return records


def test_foreign_archives(spark, tmp_path):
    want = {}
    for k, index in enumerate(["indexes/index.cdx", "indexes/index.cdxj", "indexes/index.cdx.gz"]):
        want[k] = foreign(str(tmp_path / f"{k}.zip"), index)
    rows = [(str(tmp_path / f"{k}.zip"), (tmp_path / f"{k}.zip").stat().st_size) for k in want]
    manifest = spark.createDataFrame(rows, "path string, bytes long")
    for most in (warc.TASK_BYTES, 3000):
        plan = warc.planned(manifest, most)
        assert plan.rdd.getNumPartitions() >= len(want) and (most > 3000 or plan.count() > 20)
        got = warc.read_archives(manifest, most).collect()
        assert collections.Counter((r["url"], r["payload_bytes"], r["payload_digest"]) for r in got) == collections.Counter((u, *x) for own in want.values() for u, x in own.items())
    foreign(str(tmp_path / "bare.zip"), "")
    with pytest.raises(ValueError, match="no index for archive/one.warc.gz"):
        warc.places(warc.Range(str(tmp_path / "bare.zip")))
    with zipfile.ZipFile(tmp_path / "off.zip", "w") as z:
        z.writestr("a.warc", b"x")
        z.writestr("a.cdxj", 'k 1 {"offset": 0, "length": 9}')
    with pytest.raises(ValueError, match="outside"):
        warc.places(warc.Range(str(tmp_path / "off.zip")))


def test_zip_directory_with_zip64_and_faults(tmp_path, monkeypatch):
    path = str(tmp_path / "a.zip")
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    with zipfile.ZipFile(path, "w") as z:
        for k in range(5):
            z.writestr(f"m{k}é", bytes([k]) * (50 + k))
        z.comment = b"note PK\x05\x06 inside"
    source = warc.Range(path)
    found = warc.directory(source)
    for k in range(5):
        at, n = warc.member_range(source, found[f"m{k}é"])
        assert source.read(at, n) == bytes([k]) * (50 + k)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", b"x" * 100)
    source = warc.Range(path)
    with pytest.raises(ValueError, match="stored"):
        warc.member_range(source, warc.directory(source)["m"])
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    with pytest.raises(ValueError, match="central directory"):
        warc.directory(warc.Range(str(tmp_path / "b.zip")))


# ---- 8


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in range(3):
        for _ in range(40):
            rows.append((label, rng.normal(size=16)))
        for _ in range(6):
            c = rng.normal(size=16)
            rows += [(label, c + rng.normal(size=16) * 0.08) for _ in range(15)]
    rows += [rows[0], (0, rows[0][1] * 3), (None, rows[0][1]), (1, rows[0][1])]
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, (lab, v) in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [None] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [], 0), (None, rows[0][1], 0), (n + 5, [1e300] * 3, 0), (n + 6, [1e300] * 3, 0), rows[1]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, key string, n int")
    x = np.array([r[1] for r in rows[:n]], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    lab = [r[2] for r in rows[:n]]
    near = u @ u.T >= 0.93
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b and lab[a] is not None and lab[a] == lab[b] and near[a, b]]
    links = collections.Counter(a for a, _ in pairs)
    root = joined(pairs, range(n))
    for shard in (None, 40):
        got = graphs.near_duplicates(df, shard=shard).collect()
        assert len(got) == len(rows)
        for r in got:
            i = r["vec_id"]
            if i is None or i >= n:
                assert r["n_links"] == (1 if i in (n + 5, n + 6) else 0)
            else:
                assert (r["n_links"], r["component_id"], r["kept"]) == (links[i], root[i], root[i] == i)
    assert graphs.near_duplicates(df.limit(0)).count() == 0


def found_by(g, q, keys, audit=None):
    return sum(len(r) for r, _ in graphs.looked_up(g, q, keys, 0.93, audit))


def test_graph_recall_and_fallback():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    x = np.concatenate([c + 0.06 * rng.normal(size=(25, 32)) for c in centres])
    ids = np.arange(len(x))
    g = graphs.build(ids, ids, np.ones(len(x), int), x, 0.93)
    again = graphs.Graph.load(g.dump())
    assert again.beam == g.beam > 0 and all(np.array_equal(a, b) for p, q in zip(g.levels, again.levels, strict=True) for a, b in zip(p, q, strict=True))
    want = (g.exact @ g.exact.T >= 0.93).sum() - len(x)
    assert found_by(again, g.exact, g.ids) >= 0.99 * want
    g.beam = 0
    assert found_by(g, g.exact, g.ids) == want
    g.beam, g.levels[0][1][:], g.ends[:] = 24, -1, 0  # a graph without links: the audit of real queries sends it to the scan
    audit = {}
    assert found_by(g, g.exact, g.ids, audit) == want and audit["beam"] == 0 and audit["links"] > 200


@pytest.mark.parametrize("dims", [64, 384, 768])
def test_sparse_links_between_shards_are_found(dims):
    """80 links planted between a shard of 8000 and 4096 queries; an audit of the block's own links would see next to none."""
    rng = np.random.default_rng(dims)
    x, q, ids = rng.normal(size=(8000, dims)), rng.normal(size=(4096, dims)), np.arange(8000)
    node, at = rng.choice(8000, 80, replace=False), rng.choice(4096, 80, replace=False)
    u = graphs.unit_rows(x)[node]
    aside = rng.normal(size=u.shape)
    aside = graphs.unit_rows(aside - (aside * u).sum(1, keepdims=True) * u)
    cosine = rng.uniform(0.931, 0.99, (80, 1))
    q[at] = cosine * u + np.sqrt(1 - cosine * cosine) * aside
    g = graphs.build(ids, ids, np.ones(8000, int), x, 0.93)
    assert g.probes > 400 and g.found >= graphs.RECALL * g.probes
    assert found_by(g, graphs.unit_rows(q), np.arange(8000, 12096)) >= 79


def test_cells_compare_few_pairs_and_find_the_links(spark, monkeypatch, caplog):
    """The work of a label is a part of all its pairs, in one shard or several, and its links are those of a scan."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(4000, 64)), np.repeat(rng.normal(size=(40, 64)), 20, 0) + 0.18 * rng.normal(size=(800, 64))])
    x = x[rng.permutation(len(x))].astype(np.float32)
    n, u = len(x), graphs.unit_rows(x.astype(float))
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    g = graphs.build(np.arange(300), np.arange(300), np.ones(300, int), u[:300], None)
    visits, probes, found = graphs.visits_for(g, u[300:1000], 0.93)
    assert 0 < visits < 40 and found >= graphs.RECALL * probes
    at = graphs.nearest(g, u.astype(np.float32), visits)
    assert (at[:, 0] == (u @ g.exact.T).argmax(1)).mean() > 0.999
    order = np.argsort(at[:, 0], kind="stable")
    one, a, b = (graphs.Shard(k, k, np.ones(len(k), int), x[k], at[k, 0], at[k]) for k in (order, order[:2500], order[2500:]))
    compared, plain = [], graphs.linked
    monkeypatch.setattr(graphs, "linked", lambda p, i, q, j, least: compared.append(len(p.ids[i]) * len(q.ids[j])) or plain(p, i, q, j, least))
    links = graphs.paired(one, one, 0.93)[0]
    assert sum(compared) < n * n / 4
    assert (links <= near[order].sum(1)).all() and links.sum() >= 0.99 * near.sum()
    left, right, both = (graphs.paired(*p, 0.93) for p in ((a, a), (b, b), (a, b)))
    assert np.array_equal(np.concatenate([left[0] + both[0], right[0] + both[1]]), links)
    monkeypatch.undo()
    monkeypatch.setattr(graphs, "CELL", 16)
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(n + i, v.tolist(), "b") for i, v in enumerate(x[:50])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    with caplog.at_level(logging.INFO, logger="parchment.llm.graphs"):
        got = {r["vec_id"]: r["n_links"] for r in graphs.near_duplicates(df, shard=1500).collect()}
    assert "2 graphs, 1 without use" in caplog.text
    assert all(got[i] <= near[i].sum() for i in range(n)) and sum(got[i] for i in range(n)) >= 0.99 * near.sum()
    assert all(got[n + i] == near[i, :50].sum() for i in range(50))


# ---- 3


def test_sampling_without_replacement():
    voc = sampling.Vocabulary.load(sampling.default_model_path())
    index = {n: i for i, n in enumerate(voc.names) if np.isfinite(voc.weight[i])}

    def every(s, ids=(), w=0.0):
        if not s:
            yield ids, w
        for m in range(1, len(s) + 1):
            if s[:m] in index:
                yield from every(s[m:], (*ids, index[s[:m]]), w + voc.weight[index[s[:m]]])

    text, n = "an it", 20_000
    paths = dict(every("▁an▁it"))
    z = np.logaddexp.reduce(list(paths.values()))
    p = {k: float(np.exp(v - z)) for k, v in paths.items()}
    t, found, count, threshold = sampling.sample(pa.array([text] * n), sampling.mix(np.arange(n, dtype=np.uint64)), 3, voc)
    picks, total = [], np.zeros(n)
    for path in found:
        ids, first = sampling.path_ids(t, path, voc)
        picks.append([tuple(ids[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)])
        lp = np.array([np.log(p[x]) for x in picks[-1]])
        total += np.exp(lp) / -np.expm1(-np.exp(lp - threshold))
    assert (count == 3).all() and all(len({a, b, c}) == 3 for a, b, c in zip(*picks, strict=True))
    assert abs(total.mean() - 1) < 0.01  # inclusion scores weight the samples without bias
    best = max(p, key=p.get)
    assert abs(np.mean([x == best for x in picks[0]]) - p[best]) < 0.01
    second = [b for a, b in zip(picks[0], picks[1], strict=True) if a == best]
    for k in sorted(p, key=p.get)[-4:-1]:
        assert abs(np.mean([x == k for x in second]) - p[k] / (1 - p[best])) < 0.03


def test_encoding_round_trip(docs, empty, texts):
    enc = sampling.encoded(docs, k=2)
    rows = sampling.decoded(enc).collect()
    assert all(r["decoded_ok"] for r in rows)
    want = collections.defaultdict(set)
    for r in docs.collect():
        want[r["doc_id"]].add(r["text"] or "")
    assert all(r["decoded"] in want[r["doc_id"]] for r in rows)
    by = collections.defaultdict(set)
    for r in rows:
        if r["doc_id"] not in (3, None):
            by[r["doc_id"]].add(tuple(r["ids"]))
    assert len(by[45]) == len(by[46]) == 1 and by[45] == {()} and len(by[0]) == 2
    again = sampling.encoded(docs.repartition(1), k=2).collect()
    key = lambda rs: collections.Counter((r["doc_id"], r["rank"], r["ids_hash"], tuple(r["ids"]), r["log_prob"]) for r in rs)
    assert {k[:4] for k in key(again)} == {k[:4] for k in key(rows)}  # neither batches nor partitions matter
    assert sampling.encoded(empty).count() == 0 and sampling.decoded(sampling.encoded(empty)).count() == 0


def test_sentencepiece_query_returns_ids_and_texts(spark, tmp_path):
    texts = {0: "some plain words, twice: some plain words", 1: "", 2: None, 3: "zażółć \U0001f600 gęślą\n\ttab  two spaces "}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = queries.op3_sentencepiece(spark, f"file://{tmp_path}").collect()
    assert collections.Counter(r["doc_id"] for r in rows) == {0: 2, 1: 1, 2: 1, 3: 2}
    for r in rows:
        assert r["decoded"] == (texts[r["doc_id"]] or "") and len(r["ids"]) == r["n_pieces"] and r["decoded_ok"]


# ---- 2


CHANGES = "doc_id long, op string, source string, lang string, version string, tokens long, seq int, note string"


def change_batches(rng, n):
    out = []
    for _ in range(n):
        rows = []
        for doc in rng.sample(range(30), 15):
            op = rng.choice(["upsert", "upsert", "delete"])
            rows.append((doc, op, rng.choice(["a", "b", None]), "en", rng.choice(["v1", "v2"]), rng.randrange(100), rng.randrange(3), "extra"))
        out.append([*rows, (None, "upsert", "a", "en", "v1", 5, 0, "x")])
    return out


def totals_after(batches):
    truth: dict = {}
    for batch in sorted(batches):
        for doc, op, source, lang, version, n, _, _ in batches[batch][:-1]:
            if op == "delete":
                truth.pop((doc, version), None)
            else:
                truth[doc, version] = (source, lang, n)
    sums = collections.defaultdict(lambda: [0, 0])
    for (_, v), (s, lang, n) in truth.items():
        sums[s, lang, v][0] += 1
        sums[s, lang, v][1] += n
    return dict(sums)


def totals_of(rollup):
    return {(x["source"], x["lang"], x["version"]): [x["n_docs"], x["n_tokens"]] for x in rollup.totals().collect()}


@pytest.mark.parametrize("order", [[1, 2, 3, 4, 5], [3, 1, 5, 2, 4], [5, 4, 3, 2, 1]])
def test_rollups(spark, order):
    """Totals are those of the batches in the order of their ids, in whatever order they are committed."""
    batches = dict(zip(range(1, 6), change_batches(random.Random(6), 5), strict=True))
    r = rollups.Rollup(spark, store.new_path(spark, "rollup-test"))
    done = {}
    for k, batch in enumerate(order):
        df = spark.createDataFrame(batches[batch], CHANGES)
        assert r.apply(batch, df) and not r.apply(batch, df)
        done[batch] = batches[batch]
        assert totals_of(r) == totals_after(done)
        if k == 2:
            assert r.compact() and totals_of(r) == totals_after(done)
    assert r.committed() == [1, 2, 3, 4, 5]
    assert r.apply(6, df.limit(0)) and totals_of(r) == totals_after(done)  # no changes
    live = {(x["doc_id"], x["version"]): x["tokens"] for x in r.current().collect()}
    assert sum(live.values()) == sum(n for _, n in totals_of(r).values())
    # what failed before its commit leaves no trace
    df.write.parquet(f"{r.root}/aside/9-x/deltas")
    assert totals_of(r) == totals_after(done)
    with pytest.raises(ValueError, match="start at 0"):
        r.apply(-1, df)


def test_rollups_of_two_writers(spark, monkeypatch):
    """A batch that another writer commits between the reading of the state and the commit counts in the totals."""
    one, two, three = change_batches(random.Random(7), 3)
    frame = lambda rows: spark.createDataFrame(rows, CHANGES)
    root = store.new_path(spark, "rollup-race")
    a, b = rollups.Rollup(spark, root), rollups.Rollup(spark, root)
    a.apply(1, frame(one))
    deltas, calls = a._deltas, []

    def late(*args):
        if not calls:
            calls.append(b.apply(2, frame(two)))
        return deltas(*args)

    monkeypatch.setattr(a, "_deltas", late)
    assert a.apply(3, frame(three)) and calls == [True]
    assert totals_of(a) == totals_after({1: one, 2: two, 3: three})
    again = []
    monkeypatch.setattr(a, "_deltas", lambda *args: again or again.append(b.apply(4, frame(one))) or deltas(*args))
    assert not a.apply(4, frame(one))  # the other writer was first
    assert totals_of(a) == totals_after({1: one, 2: two, 3: three, 4: one})


def test_token_count_query(spark, tmp_path):
    rng = random.Random(12)
    texts = {i: sentences(rng, rng.randrange(1, 40)) + rng.choice(["", " zażółć", " \n"]) for i in range(40)} | {40: "", 41: None, 42: " \t"}
    texts |= {50 + i: texts[i] for i in (3, 3, 7, 40)} | {60: texts[3]}
    rows = [(i, t, ["en", None][i % 2], f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    least = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        least.setdefault(t, i)
    want = collections.defaultdict(lambda: [0, 0])
    for version in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        enc = rollups._encoder(open(rollups.default_ranks_path(version), "rb").read())
        for i, t, lang, source, _ in rows:
            if t is not None and least[t] != i:
                continue
            n = len(enc.encode_ordinary(t or ""))
            if version == "byte_bpe_50k":
                source, n = (source, n + 1) if n else ("empty", 0)
            want[source, lang, version][0] += 1
            want[source, lang, version][1] += n
    got = {(r["source"], r["lang"], r["version"]): [r["n_docs"], r["n_tokens"]] for r in queries.op2_token_counts(spark, f"file://{tmp_path}").collect()}
    assert got == dict(want) and ("empty", "en", "byte_bpe_50k") in got


def test_token_counts(docs, empty):
    got = rollups.counted(docs, "v").collect()
    enc = rollups._encoder(open(rollups.default_ranks_path(), "rb").read())
    want = collections.Counter((r["doc_id"], len(enc.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    assert collections.Counter((r["doc_id"], r["tokens"]) for r in got) == want
    assert {r["doc_id"] for r in rollups.copies(docs, "v").collect()} == {40} and rollups.counted(empty, "v").count() == 0


# ---- 4


def skewed(rng, n=90):
    """Cells of a hot source, with goals that fit the tokens there are: sums over a part of them."""
    tokens = rng.integers(1, 1000, n).astype(float)
    codes = [rng.integers(0, 6, n), rng.integers(0, 4, n), rng.integers(0, 3, n)]
    tokens[codes[0] == 0] *= 40
    return tokens, codes


@pytest.mark.parametrize("share", [0.5, 0.9])
def test_raking_meets_marginals_under_the_bound(share):
    rng = np.random.default_rng(7)
    for _ in range(20):
        tokens, codes = skewed(rng)
        part = tokens * np.clip(rng.beta(4 * share, 4 * (1 - share), len(tokens)) * 1.3, 0, 1)  # some cells are wanted whole
        goals = [np.bincount(c, part, minlength=c.max() + 1) for c in codes]
        fit, gap = mixing.rake(tokens, codes, goals, 3000)
        assert gap < 1e-6 and fit.min() >= 0 and (fit <= tokens).all()
        for c, g in zip(codes, goals, strict=True):
            assert np.abs(np.bincount(c, fit, minlength=len(g)) - g).max() / part.sum() < 1e-6
    even = [np.bincount(c, tokens) * share for c in codes]
    assert np.allclose(mixing.rake(tokens, codes, even)[0], tokens * share)  # nothing to change


def test_goals():
    own = {"a": 900.0, "b": 60.0, "c": 40.0, "d": 0.0}
    t = mixing.shares(own, 0.5, None)
    assert abs(sum(t.values()) - 1) < 1e-12 and "d" not in t and abs(t["a"] / t["b"] - 15**0.5) < 1e-9
    t = mixing.shares(own, 1.0, {"a": 0.5, mixing.OTHERS: 0.5})
    assert t == {"a": 0.5, "b": 0.3, "c": 0.2}
    assert mixing.goals_of(own, t, 100) == {"a": 50, "b": 30, "c": 20}
    got = mixing.goals_of(own, t, 400)  # b and c are taken whole, a takes over what they lack
    assert got == {"b": 60, "c": 40, "a": 300}
    assert mixing.wanted_tokens([own], [{"a": 0, "b": 1, "c": 0}], 900.0) == 60


@pytest.mark.parametrize("share", [0.3, 0.5, 0.9])
def test_mixing_meets_targets(spark, caplog, share):
    rng = random.Random(11)
    rows = []
    for d in range(3000):
        source = "hot" if d % 3 == 0 else f"s{rng.randrange(6)}"
        body = sentences(rng, rng.randrange(20, 80))
        rows.append((d, body + (" | x" if d % 7 == 0 else " 12345" if d % 5 == 0 else ""), rng.choice(["en"] * 6 + ["de", "de", "fr"]), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    own = collections.Counter()
    for _, t, lang, _s in rows:
        own[lang] += len(toks(t))
    total = sum(own.values())
    targets = {"lang": {"en": own["en"] / total - 0.03, "de": own["de"] / total + 0.03, "fr": own["fr"] / total}}
    got = mixing.mixed(docs, share=share, power=1.0, targets=targets).select("lang", "mix.*").collect()
    sums, whole = collections.Counter(), sum(r["tokens"] * r["probability"] for r in got)
    for r in got:
        sums[r["lang"]] += r["tokens"] * r["probability"] / whole
    assert abs(whole / total - share) < 1e-6
    assert all(abs(sums[k] - v) < 1e-6 for k, v in targets["lang"].items() if share < 0.9)
    if share == 0.9:  # all of de is taken, which is less than its share, and the log says so
        assert all(r["probability"] > 1 - 1e-9 for r in got if r["lang"] == "de")
        assert any("too few tokens" in r.message for r in caplog.records)
    drawn = sum(r["tokens"] for r in got if r["sampled"])
    assert abs(drawn / total - share) < 0.05


def test_mixing(docs, empty, spark):
    rows = mixing.mixed(docs, share=0.6).select("doc_id", "text", "mix.*").collect()
    assert len(rows) == docs.count()
    assert {r["tokens"] == len(toks(r["text"])) for r in rows} == {True}
    assert all(r["sampled"] for r in rows if r["tokens"] == 0)
    assert len({r["sampled"] for r in rows if r["doc_id"] == 40}) == 1
    given = {"lang": {"en": 0.5, "de": 0.5}}
    got = mixing.mixed(docs, share=0.01, targets=given).select("source", "lang", "mix.topic", "mix.weight").distinct().collect()
    sums = collections.Counter()
    for r in got:
        sums[r["lang"]] += r["weight"]
    assert abs(sums["en"] - 0.5) < 1e-6 and sums[None] == 0
    assert mixing.mixed(empty).count() == 0 and mixing.sampled(empty).columns == empty.columns


def test_mixing_keeps_clashing_columns(spark):
    names = ["doc_id", "text", "lang", "source", "mix", "weight", "probability", "sampled", "_tokens", "_topic", "_source", "_lang", "_weight", "tokens", "topic", "_source_", "a.b"]
    rows = [(k, "some words here", "en", f"s{k % 2}", *[-7.0] * (len(names) - 4)) for k in range(20)]
    docs = spark.createDataFrame(rows, names)
    got = corpus_pipeline.mixing_weights(spark, docs, "")
    assert got.columns == names and 0 < got.count() <= 20 and all(set(r[4:]) == {-7.0} for r in got.collect())
    assert mixing.mixed(docs).columns == [*names, "_mix"]


def test_both_ways_of_raking_agree(spark, monkeypatch, caplog):
    rng = random.Random(4)
    rows = [(d, sentences(rng, rng.randrange(5, 60)), rng.choice(["en", "de"]), rng.choice([None, "", "", "", "web"])) for d in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cells = mixing.written(mixing.cells_of(docs), "cells")
    assert cells.count() >= 6
    for share, targets, rounds in ((0.5, {"lang": {"en": 0.9, "de": 0.1}}, 2), (0.8, {"source": {"web": 0.5, mixing.OTHERS: 0.5}}, 2)):
        monkeypatch.setattr(mixing, "ROUNDS", rounds)  # stops short, on both
        a, b = (mixing.probabilities(cells, share, 0.3, targets, most=m).orderBy(*mixing.DIMENSIONS).toPandas() for m in (10**6, 0))
        assert np.allclose(a["weight"], b["weight"], atol=1e-9) and np.allclose(a["probability"], b["probability"], atol=1e-9)
    none = spark.createDataFrame([], cells.schema)
    assert mixing.probabilities(none, 0.5, 0.7, None).count() == mixing.probabilities(none, 0.5, 0.7, None, most=-1).count() == 0


# ---- 1 and 6


def labelled(n=900):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(n):
        toxic, low = i % 5 == 0, i % 4 == 1
        words = [rng.choice(WORDS) for _ in range(rng.randrange(10, 60))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Idiot,", "moron"]))
        if low:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words), ["en", "de"][i % 2], "s"))
        marks.append((i, int(not low), int(toxic)))
    return rows, marks


@pytest.mark.parametrize(("module", "target", "folds", "held"), [(toxicity, 2, 5, 0), (quality, 1, 3, 1)])
def test_classifiers(spark, docs, empty, module, target, folds, held):
    rows, marks = labelled()
    d = spark.createDataFrame(rows + [(None, "x", None, None), (9000, None, None, "s"), (9001, "", "en", "s"), rows[0]], "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(marks + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.classified(d, lab, folds, held).collect()
    assert len(got) == len(rows) + 4
    truth = {m[0]: m[target] for m in marks}
    out = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 100 and np.mean([a == b for a, b in out]) > 0.95
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
    used = labels.training_rows(d, lab, ("quality", "toxic")[target - 1], folds, held, 10**6).select("id").collect()
    assert all(zlib.crc32(str(r["id"]).encode()) % folds != held for r in used)
    assert module.classified(docs, lab.limit(0), folds, held).count() == docs.count() and module.classified(empty, lab, folds, held).count() == 0


def naive_pooled(model, text):
    """A text's features word by word: each filter's greatest product with a window of embeddings, zeros after the end."""
    ids, _ = toxicity.hashed(pa.array([text]), model.bits)
    vectors = [model.embedding[model.rows[i]] for i in ids] + [np.zeros(model.embedding.shape[1])] * 3
    out = []
    for m in toxicity.WIDTHS:
        for f in range(model.filters[m].shape[2]):
            sums = [sum(float(vectors[t + j] @ model.filters[m][j, :, f]) for j in range(m)) for t in range(len(vectors) - m + 1)]
            out.append(max(max(sums) + float(model.biases[m][f]), 0.0))
    return out


def test_convolution_is_the_plain_one(texts):
    rows, marks = labelled(300)
    model = toxicity.fit(pa.array([r[1] for r in rows]), np.array([m[2] for m in marks]), [r[2] for r in rows], epochs=3)
    some = [r[1] for r in rows[:20]] + ["", "idiot", "new unknown words", texts[49], texts[52]]
    ids, first = toxicity.hashed(pa.array(some), model.bits)
    got = model.pooled(model.rows[ids], first, model.tables())
    assert np.allclose(got, [naive_pooled(model, t) for t in some], atol=1e-4)
    alone = [model.score(pa.array([t]), model.tables())[0] for t in some]
    assert np.allclose(model.score(pa.array(some), model.tables()), alone)  # whatever text comes next
    assert set(model.thresholds) == {"de", "en"} and all(0 < x < 1 for x in model.thresholds.values())


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    dims, n_filters, pad = 4, 3, max(toxicity.WIDTHS)
    emb = rng.normal(size=(9, dims))
    emb[0] = 0
    filters = {m: rng.normal(size=(m, dims, n_filters)) for m in toxicity.WIDTHS}
    biases = {m: rng.normal(size=n_filters) for m in toxicity.WIDTHS}
    out, bias = rng.normal(size=n_filters * len(toxicity.WIDTHS)), 0.3
    x, start = toxicity.padded(rng.integers(1, 9, 30), np.array([0, 7, 7, 18, 30]), pad)
    y, weight = np.array([1, 0, 1, 0]), np.array([0.2, 0.3, 0.1, 0.4])
    loss = lambda: toxicity.loss_and_gradients(emb, filters, biases, out, bias, x, start, pad, y, weight)
    _, grads = loss()
    for name, value in [("emb", emb), ("out", out)] + [(f"f{m}", filters[m]) for m in filters] + [(f"b{m}", biases[m]) for m in biases]:
        for at in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(12)]:
            if name == "emb" and at[0] == 0:
                continue
            own = value[at]
            value[at] = own + 1e-5
            up = loss()[0]
            value[at] = own - 1e-5
            down = loss()[0]
            value[at] = own
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6, (name, at)


def test_cuts_are_drawn_to_the_common_one():
    assert toxicity.best_cut(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)
    assert toxicity.best_cut(np.array([0.9, 0.8]), np.array([0, 0])) is None
    rng = np.random.default_rng(1)
    margin = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-2.5 * margin))).astype(int)
    assert abs(toxicity.fitted_slope(margin, y, 0.1) - 2.5) < 0.2


def test_ftrl_is_the_plain_one():
    """Weights against a dictionary of coordinates, updated one by one."""
    rows, marks = labelled(60)
    texts, y = [r[1] for r in rows], np.array([m[1] for m in marks])
    bits, alpha, beta, l1, l2 = 16, 0.15, 1.0, 0.02, 0.5
    model = quality.fit(pa.array(texts), y, bits=bits, epochs=2)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        own = 0.0 if k == "bias" else l1
        return 0.0 if abs(z[k]) <= own else -(z[k] - (1 if z[k] > 0 else -1) * own) / ((beta + n[k] ** 0.5) / alpha + l2)

    xs = []
    for text in texts:
        keys, _ = quality.features(pa.array([text]), bits, 2)
        xs.append({k: c * 40 / len(keys) for k, c in collections.Counter(keys.tolist()).items()} | {"bias": 1.0})
    rng = np.random.default_rng(7)
    for _ in range(2):
        for i in rng.permutation(60):
            w = {k: weight(k) for k in xs[i]}
            p = 1 / (1 + np.exp(-sum(w[k] * v for k, v in xs[i].items())))
            slope = (p - y[i]) * (0.5 / y.mean() if y[i] else 0.5 / (1 - y.mean()))
            for k, v in xs[i].items():
                g = slope * v
                sigma = ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / alpha
                z[k] += g - sigma * w[k]
                n[k] += g * g
    assert abs(model.bias - weight("bias")) < 1e-9
    want = {k: weight(k) for k in z if k != "bias"}
    assert all(abs(model.weights[k] - w) < 1e-6 for k, w in want.items()) and np.count_nonzero(model.weights) == sum(w != 0 for w in want.values())


# ---- pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    texts = {i: sentences(rng, 150) for i in range(30)}
    passage = sentences(rng, 60)
    texts |= {30: texts[4], 31: texts[5] + " " + passage, 32: passage + " " + sentences(rng, 200), 33: "short", 34: "", 35: None}
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "SimHash near-dedup", "substring dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, f in list(stages.items())[:4]:
        docs = store.written(f(spark, docs, f"file://{tmp_path}"), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not {30, 33, 34, 35} & set(left)
    if 32 in left and 31 in texts:
        assert passage not in left[32]
    out = sampling.decoded(corpus_pipeline.run(spark, f"file://{tmp_path}")).collect()
    assert {(r["doc_id"], r["decoded"]) for r in out} == set(left.items()) and {r["rank"] for r in out} == {1, 2}


def brute_pipeline(rows):
    """The first four stages, document by document: rows (doc_id, text, lang, source) to what is left, as id -> text."""
    # quality rules: the measurements by plain Python, the conditions as they are written down
    con = duckdb.connect()
    con.execute("CREATE TABLE m (id BIGINT, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_lines BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT)")
    for i, x, *_ in rows:
        w, c, s, dup, rep = rule_truth(x)
        con.execute("INSERT INTO m VALUES (?, ?, ?, ?, ?, ?, ?)", [i, w, c, s, sum(bool(toks(y)) for y in (x or "").split("\n")), dup, rep])
    enforced = set(rules.BASE) | set(rules.POLICIES[rules.CURRENT])
    bad = " OR ".join(f"({cond})" for name, cond in rules.RULES.items() if name in enforced)
    kept = {r[0] for r in con.execute(f"SELECT id FROM m WHERE NOT coalesce({bad}, false)").fetchall()}
    rows = [r for r in rows if r[0] in kept]
    # near copies: the least id of each component by Jaccard similarity of five-word shingles
    of = near_truth([r[:2] for r in rows])
    rows = [r for r in rows if of[r[0]] == r[0]]
    # passages of 13 words that a smaller id has
    first = {}
    for i, x, *_ in rows:
        w = toks(x)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, x, lang, source in rows:
        w = toks(x)
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        out.append((i, " ".join(y for k, y in enumerate(w) if k not in gone) if gone else x, lang, source))
    # mixing: factors found group by group by bisection, until all sums are met
    share, power = corpus_pipeline.MIX_SHARE, corpus_pipeline.MIX_POWER
    form = lambda x: "empty" if not toks(x) else "tabular" if re.search(r"\S \| \S", x) else "numeric" if re.search(r"\d{4,}", x) else "prose"
    cell = {i: (source, lang, form(x)) for i, x, lang, source in out}
    tokens = collections.Counter()
    for i, x, *_ in out:
        tokens[cell[i]] += len(toks(x))
    total, keys = sum(tokens.values()), list(tokens)
    goals = []
    for d in range(3):
        own = collections.Counter()
        for k in keys:
            own[k[d]] += tokens[k]
        raised = {g: v**power for g, v in own.items() if v}
        goal, left, room = {g: 0.0 for g in own}, dict(raised), share * total
        while left:
            part = {g: room * v / sum(left.values()) for g, v in left.items()}
            full = [g for g in left if part[g] >= own[g]]
            if not full:
                goal |= part
                break
            for g in full:
                goal[g] = own[g]
                room -= own[g]
                del left[g]
        goals.append(goal)
    log_f = [{g: 0.0 for g in goal} for goal in goals]
    weight = lambda k: tokens[k] * min(1.0, math.exp(min(50, sum(log_f[d][k[d]] for d in range(3)))))
    for _ in range(400):
        for d in range(3):
            for g in goals[d]:
                low, high = -30.0, 30.0
                for _ in range(80):
                    log_f[d][g] = (low + high) / 2
                    if sum(weight(k) for k in keys if k[d] == g) < goals[d][g]:
                        low = log_f[d][g]
                    else:
                        high = log_f[d][g]
    drawn = lambda i: (xxhash.xxh64_intdigest(i.to_bytes(8, "little"), xxhash.xxh64_intdigest((42).to_bytes(4, "little"), 42)) >> 11) * 2.0**-53
    p = {k: weight(k) / tokens[k] if tokens[k] else 1.0 for k in keys}
    assert all(abs(drawn(i) - p[cell[i]]) > 1e-4 for i, *_ in out if p[cell[i]] < 0.999), "a draw too near its probability"
    return {i: x for i, x, *_ in out if drawn(i) < p[cell[i]]}


def test_pipeline_is_the_brute_force_one(spark, tmp_path):
    rng = random.Random(14)
    rows, passage = [], sentences(rng, 60)
    for i in range(150):
        w = sentences(rng, rng.randrange(15, 120))
        w += rng.choice(["", "", "", " a | b", " 123456"]) + (" " + passage if i % 9 == 4 else "")
        rows.append([i, w, rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "hot", "s1", "s2", None])])
    for i in range(150, 200):  # edited near copies: some alike, some not
        w = rows[rng.randrange(150)][1].split(" ")
        for at in rng.sample(range(len(w)), min(len(w), rng.randrange(0, 7))):
            w[at] = f"edit{at}"
        rows.append([i, " ".join(w), "en", "s1"])
    rows += [[200, "", "en", "hot"], [201, None, None, None], [202, "### " * 60, "en", "s2"], [203, "same words " * 90, "de", "s2"], [204, "line of some words here\n" * 12, "de", "s1"]]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    want = brute_pipeline(rows)
    out = sampling.decoded(corpus_pipeline.run(spark, f"file://{tmp_path}")).collect()
    assert {(r["doc_id"], r["decoded"]) for r in out} == set(want.items()) and 60 < len(want) < 190
    assert all(len({r["ids_hash"] for r in out if r["doc_id"] == i}) == 2 for i in list(want)[:20])


def shingles_of(x):
    w = [t.lower() for t in toks(x)]
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def near_truth(rows):
    """Components of rows whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = collections.defaultdict(list)
    for i, x in rows:
        if i is not None:
            sets[i].append(shingles_of(x))
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    return joined([(a, b) for a in sets for b in sets if a < b and any(near(x, y) for x in sets[a] for y in sets[b])], sets)


def test_near_dedup_finds_candidates_by_simhash(spark, monkeypatch):
    rng = random.Random(21)
    rows = []
    for k in range(8):
        w = sentences(rng, 400).split()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:-1], "edited"]))]
    bits = {i: simhash.fingerprint(x.encode(), 5) for i, x in rows}
    want = {(i, i + 1) for i in range(0, 16, 2) if (bits[i] ^ bits[i + 1]).bit_count() <= 2}
    assert want
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shingles = store.written(minhash.shingled(df, "doc_id", "text"), "shingles")
    of = {r["fp"]: r["id"] for r in shingles.collect()}
    bare = shingles.withColumn("keys", F.array().cast("array<long>"))  # no minimum hashes
    found = minhash.links(bare, df.select(F.col("doc_id").alias("id"), "text"), minhash.simhash_buckets(df, shingles)).collect()
    assert {tuple(sorted((of[r["fp"]], of[r["fp2"]]))) for r in found} >= want
    called, plain = [], simhash.fingerprints
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: called.append(a[3]) or plain(*a))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == list(range(0, 16, 2))
    assert called == [minhash.SHINGLE]


@pytest.mark.parametrize("block", [minhash.BLOCK, 5])  # the second verifies large buckets block by block
def test_pipeline_drops_edited_near_copies(docs, empty, spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for k in range(12):
        w = sentences(rng, 200).split()
        rows.append((100 + 20 * k, " ".join(w)))
        for j in range(1, 14):  # up to seven words changed, so some are alike, some only through others, some not
            e = list(w)
            for at in rng.sample(range(200), (j + 1) // 2):
                e[at] = f"edit{j}x{at}"
            rows.append((100 + 20 * k + j, " ".join(e)))
    want = near_truth(rows)
    assert sum(i != c for i, c in want.items()) > 60 and sum(i == c for i, c in want.items() if i >= 100) > 12
    planted = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, planted, "").collect()]
    assert sorted(x for x in got if x is not None) == sorted(i for i, c in want.items() if i == c)
    assert got.count(None) == sum(i is None for i, _ in rows)
    assert corpus_pipeline.near_dedup(spark, empty, "").count() == 0
