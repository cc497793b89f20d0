"""Substring dedup with repeated-phrase automata.

A window is 13 consecutive words. Of texts that are equal as a whole only the one with the least id is looked at: the windows of
the others all start in it. Every window is represented by its minimiser, the word k-gram in it with the least hash; equal
windows have equal minimisers. So:

1. count minimisers over the corpus (partial aggregates) and keep those of two documents or more;
2. cut every document, around its kept minimisers, into passages of at most 21 words, which hold all windows that may recur;
3. collapse equal passages, deal them by minimiser, and confirm on the words themselves which windows recur, and where first;
4. compile the confirmed windows into Aho-Corasick automata, a shard of minimisers each, and stream the passages of all
   documents through the automaton of their shard, which locates every occurrence. Documents travel as these passages because a
   whole text would have to go to nearly every shard.

A minimiser with more than CROWD occurrences is dealt by whole windows, and the passages of such windows are dealt over a task for
each CROWD of them, with a copy of the window each, so neither a very frequent phrase nor a large group of near copies meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.store import dropped, fresh, written
from parchment.llm.text import buffers, mix, pieces, whitespace_classes, words

WINDOW = 13
GRAM = 5
#: Occurrences from which a minimiser's windows are dealt one by one, and of such a minimiser for each copy of its windows.
CROWD = 1024
#: Distinct passages that are confirmed at once, at least, and passages with confirmed windows in the automaton of a shard.
CONFIRMED, SHARD = 256, 256

CLASSES = whitespace_classes()


def minimisers(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: (hash, text, first window within the text, number of windows)."""
    n, reach = len(hashes), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none.astype(np.uint64), none, none, none
    gram_hash = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        gram_hash += hashes[j : n - gram + 1 + j] * np.uint64(2 * (j + 1) * 0x51ED27 + 1)
    gram_hash = mix(gram_hash)
    m = n - window + 1
    best, place = gram_hash[:m].copy(), np.arange(m)
    for j in range(1, reach):
        less = gram_hash[j : m + j] < best
        best[less] = gram_hash[j : m + j][less]
        place[less] = np.flatnonzero(less) + j
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = np.flatnonzero(row[:m] == row[window - 1 :])
    new = np.ones(len(whole), bool)
    new[1:] = (place[whole[1:]] != place[whole[:-1]]) | (row[whole[1:]] != row[whole[:-1]])
    starts = np.flatnonzero(new)
    at = whole[starts]
    return best[at], row[at], at - first[row[at]], np.diff(np.append(starts, len(whole)))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for part in pieces(batch, "text"):
        found = words(*buffers(part.column("text")), CLASSES)
        yield part, *minimisers(found.hashes, found.first, WINDOW, GRAM)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row is known by its id and a hash of its text, so that rows that repeat an id stay apart."""
    return docs.select(
        F.col(id_col).alias("id"), F.hash(F.coalesce(F.col(text_col), F.lit(""))).alias("sig"), F.col(text_col).alias("text")
    )


def split_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(id, sig, text)`` of the rows that have the least id of their whole text, and ``(id, sig)`` of all others. Rows with a null id
    or text are in neither. That is asked by id and text, never by text alone, so copies of one text don't meet."""
    keyed = _keyed(docs, id_col, text_col).where("id is not null and text is not null").withColumn("sha", F.unhex(F.sha2("text", 256)))
    first = keyed.groupBy("sha").agg(F.min("id").alias("id"))
    copies = keyed.select("id", "sig", "sha").join(first, ["sha", "id"], "left_anti").select("id", "sig").distinct()
    return keyed.join(first, ["sha", "id"], "left_semi").select("id", "sig", "text"), copies


def passages(texts: DataFrame) -> DataFrame:
    """``(bucket, crowd, id, sig, at, text)``: passages (UTF-8) of ``texts(id, sig, text)`` around the minimisers that two documents or more
    have; crowd is over 1 where they are single windows, and says over how many tasks they are dealt."""
    kind = texts.schema["id"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, row, _, _ in _runs(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), part.column("id").take(pa.array(row))], names=["anchor", "id"]
                )

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, row, at, n in _runs(batch):
                sig = np.asarray(part.column("sig"), np.int64)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), part.column("id").take(pa.array(row)), pa.array((sig << 32) | (at << 4) | n)],
                    names=["anchor", "id", "packed"],
                )

    recurring = (
        texts.select("id", "text")
        .mapInArrow(anchors, f"anchor long, id {kind}")
        .groupBy("anchor")
        .agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("n"))
        .where("x < y")
        .select("anchor", F.ceil(F.col("n") / CROWD).cast("int").alias("crowd"))
    )
    recurring = written(recurring, "anchors")
    kept = texts.mapInArrow(places, f"anchor long, id {kind}, packed long").join(recurring, "anchor")
    per_doc = (
        kept.select("id", F.shiftright("packed", 32).cast("int").alias("sig"), F.struct("anchor", "packed", "crowd").alias("p"))
        .groupBy("id", "sig")
        .agg(F.collect_list("p").alias("p"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                out: list[tuple] = []
                runs = part.column("p")
                for k in range(part.num_rows):
                    toks = part.column("text")[k].as_buffer().to_pybytes().split()
                    own = runs[k].values
                    anchor, crowd = own.field(0).to_pylist(), own.field(2).to_pylist()
                    packed = own.field(1).to_numpy(zero_copy_only=False)
                    for a, p, many in zip(anchor, (packed & 0xFFFFFFFF).tolist(), crowd, strict=True):
                        i, n = p >> 4, p & 15
                        if many > 1:
                            out += [(None, many, k, t, b" ".join(toks[t : t + WINDOW])) for t in range(i, i + n)]
                        else:
                            out.append((a, 1, k, i, b" ".join(toks[i : i + n + WINDOW - 1])))
                if out:
                    a, many, k, i, text = zip(*out, strict=True)
                    k = pa.array(k, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(many, pa.int32()), part.column("id").take(k), part.column("sig").take(k)]
                        + [pa.array(i, pa.int32()), pa.array(text, pa.binary())],
                        names=["bucket", "crowd", "id", "sig", "at", "text"],
                    )

    found = texts.join(per_doc, ["id", "sig"]).select("id", "sig", "text", "p")
    found = found.mapInArrow(cut, f"bucket long, crowd int, id {kind}, sig int, at int, text binary")
    return found.select(F.coalesce("bucket", F.xxhash64("text")).alias("bucket"), "crowd", "id", "sig", "at", "text")


class Letters:
    """Words as single characters, so that an automaton has a node a word; each shard has an alphabet of its own."""

    OTHER = "\U0010ffff"

    def __init__(self) -> None:
        self.of: dict[bytes, str] = {}

    def learn(self, text: bytes) -> str:
        # from U+10000 on, so no surrogate is made
        of = self.of
        return "".join([of.setdefault(w, chr(0x10000 + len(of))) for w in text.split(b" ")])

    def spell(self, text: bytes) -> str:
        """The same for words that may not have been learnt."""
        get, other = self.of.get, self.OTHER
        return "".join([get(w, other) for w in text.split(b" ")])


def confirmed(rows: Iterable[tuple[bytes, object, object]]) -> Iterator[list]:
    """For each distinct passage (text, least and greatest document): the first document of each of its windows that recurs; None
    for the others, and for those that an earlier passage named."""
    letters, seen, coded = Letters(), {}, []
    for text, least, most in rows:
        s = letters.learn(text)
        coded.append(s)
        for t in range(len(s) - WINDOW + 1):
            w = s[t : t + WINDOW]
            old = seen.get(w)
            seen[w] = (least, most) if old is None else (min(old[0], least), max(old[1], most))
    for s in coded:
        out = []
        for t in range(len(s) - WINDOW + 1):
            least, most = seen.pop(s[t : t + WINDOW], (None, None))
            out.append(None if least == most else least)
        yield out


def phrases(found: DataFrame) -> DataFrame:
    """``(bucket, crowd, text, firsts)``: passages with windows that recur in documents with different ids."""
    kind = found.schema["id"].dataType.simpleString()
    distinct = found.groupBy("bucket", "crowd", "text").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    dealt = distinct.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "crowd", "text", "least", "most")

    def shard(rows: list[tuple]) -> pa.RecordBatch | None:
        firsts = confirmed((r[2], r[3], r[4]) for r in rows)
        hits = [(*r[:3], x) for r, x in zip(rows, firsts, strict=True) if any(y is not None for y in x)]
        if not hits:
            return None
        a, b, c, d = zip(*hits, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary()), pa.array(d)], names=["bucket", "crowd", "text", "firsts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= CONFIRMED and row[0] != rows[-1][0]:
                    if out := shard(rows):
                        yield out
                    rows = []
                rows.append(row)
        if rows and (out := shard(rows)):
            yield out

    return dealt.mapInArrow(run, f"bucket long, crowd int, text binary, firsts array<{kind}>")


def located(found: DataFrame, known: DataFrame) -> DataFrame:
    """``(id, sig, starts)`` of each passage in which the automaton of its shard finds windows that a smaller id has, too."""
    kind = found.schema["id"].dataType.simpleString()
    shards = F.lit(max(1, known.count() // SHARD))
    shard = F.pmod(F.xxhash64("bucket"), shards).alias("shard")
    salts = F.sequence(F.lit(0), F.col("crowd") - 1)
    salt = F.pmod(F.xxhash64("id"), F.col("crowd")).cast("int").alias("salt")
    blank = lambda name, t: F.lit(None).cast(t).alias(name)
    of_automata = known.select(shard, F.explode(salts).alias("salt"), "text", "firsts", blank("id", kind), blank("sig", "int"), blank("at", "int"))
    of_texts = found.select(shard, salt, "text", blank("firsts", f"array<{kind}>"), "id", "sig", "at")
    names = ["shard", "salt", "firsts", "text", "id", "sig", "at"]
    both = of_automata.select(names).unionByName(of_texts.select(names))
    # the windows of a shard come before the passages that are streamed through its automaton
    dealt = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("id").isNotNull()).select(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, automaton = None, Automaton()
        for batch in batches:
            shard, salt = (batch.column(c).to_numpy() for c in (0, 1))
            streamed = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | np.diff(streamed)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if not part.num_rows:
                    continue
                if (key := (shard[a], salt[a])) != own:
                    own, automaton = key, Automaton()
                if not streamed[a]:
                    automaton.learn(part.column("text").to_pylist(), part.column("firsts"))
                elif (out := automaton.streamed(part)) is not None:
                    yield out

    return dealt.mapInArrow(run, f"id {kind}, sig int, starts array<int>")


class Automaton:
    """The automaton of a shard's confirmed windows, each with the first document that has it."""

    def __init__(self) -> None:
        self.letters, self.machine, self.ready = Letters(), ahocorasick.Automaton(), False

    def learn(self, texts: list[bytes], firsts: pa.ListArray) -> None:
        begin = firsts.offsets.to_numpy()
        begin, values = begin - begin[0], firsts.flatten().to_pylist()
        for text, at in zip(texts, begin.tolist(), strict=False):
            s = self.letters.learn(text)
            for t in range(len(s) - WINDOW + 1):
                if values[at + t] is not None:
                    self.machine.add_word(s[t : t + WINDOW], values[at + t])

    def streamed(self, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        """``(id, sig, starts)`` of the passages with a window that a smaller id has, too; passages that are equal pass once."""
        if not len(self.machine):
            return None
        if not self.ready:
            self.machine.make_automaton()
            self.ready = True
        coded = rows.column("text").dictionary_encode()
        places, firsts, count = [], [], []
        for text in coded.dictionary.to_pylist():
            before = len(places)
            for end, first in self.machine.iter(self.letters.spell(text)):
                places.append(end - WINDOW + 1)
                firsts.append(first)
            count.append(len(places) - before)
        if not places:
            return None
        which, count = coded.indices.to_numpy(), np.array(count)
        n, begin = count[which], (np.cumsum(count) - count)[which]
        row = np.repeat(np.arange(len(which)), n)
        hit = np.arange(len(row)) + np.repeat(begin - (np.cumsum(n) - n), n)
        ids = rows.column("id")
        earlier = pc.less(pa.array(firsts, ids.type).take(pa.array(hit)), ids.take(pa.array(row))).to_numpy(zero_copy_only=False)
        row, hit = row[earlier], hit[earlier]
        if not len(row):
            return None
        starts = rows.column("at").to_numpy(zero_copy_only=False).astype(np.int32)[row] + np.array(places, np.int32)[hit]
        some, sizes = np.unique(row, return_counts=True)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(starts, pa.int32()))
        some = pa.array(some)
        return pa.RecordBatch.from_arrays([ids.take(some), rows.column("sig").take(some), lists], names=["id", "sig", "starts"])


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, sig, starts)``: for each row that has any, the word places where a window starts whose words also start
    in a document with a smaller id; null for a row whose whole text a smaller id has, which loses every window."""
    texts, copies = split_copies(docs, id_col, text_col)
    texts = written(texts, "contents")
    found = written(passages(texts), "passages")
    known = written(phrases(found), "phrases")
    starts = located(found, known).groupBy("id", "sig").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    out = written(starts.unionByName(copies.select("id", "sig", F.lit(None).cast("array<int>").alias("starts"))), "starts")
    dropped(texts, found, known)
    return out


def kept_words(text: bytes, starts: np.ndarray | None) -> tuple[int, list[bytes]]:
    """Number of words, and those not covered by a window that starts at one of ``starts``; None: at every place."""
    toks = text.split()
    if starts is None:
        return len(toks), [] if len(toks) >= WINDOW else toks
    if not len(starts):
        return len(toks), toks
    step = np.zeros(len(toks) + WINDOW + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    covered = np.cumsum(step)[: len(toks)] > 0
    return len(toks), [toks[k] for k in np.flatnonzero(~covered)]


def _own_starts(marked: pa.Scalar, starts: pa.Scalar) -> np.ndarray | None:
    if not marked.as_py():
        return np.zeros(0, np.int64)
    return starts.values.to_numpy() if starts.is_valid else None


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False
) -> DataFrame:
    """Remove every word in a window of 13 words that also starts in a document with a smaller id.

    Returns ``(id, sig, n_words, n_removed, kept_sha256)``, and ``kept`` (the words left, with single spaces) unless
    ``digest_only``. Windows are judged on the input, not on what is left. Null and empty texts have no words. A
    null id is never smaller than another: such rows lose nothing and take nothing from others. Rows that repeat
    an id are each judged, and don't count against each other. Ids may be of any ordered type.
    """
    keyed = _keyed(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    starts = repeated_starts(docs, id_col, text_col)
    names = ["id", "sig", "n_words", "n_removed", "kept_sha256"] + ["kept"] * (not digest_only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                n_words, n_kept, shas, kepts = [], [], [], []
                for text, marked, own in zip(part.column("text"), part.column("marked"), part.column("starts"), strict=True):
                    n, kept = kept_words(text.as_buffer().to_pybytes() if text.is_valid else b"", _own_starts(marked, own))
                    joined = b" ".join(kept)
                    n_words.append(n)
                    n_kept.append(len(kept))
                    shas.append(hashlib.sha256(joined).hexdigest())
                    if not digest_only:
                        kepts.append(joined)
                n_words, n_kept = np.array(n_words, np.int64), np.array(n_kept, np.int64)
                columns = [part.column("id"), part.column("sig"), pa.array(n_words), pa.array(n_words - n_kept), pa.array(shas)]
                if not digest_only:
                    columns.append(pa.array(kepts, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    marks = starts.withColumn("marked", F.lit(True))
    marked = keyed.join(marks, ["id", "sig"], "left").select("id", "sig", "text", "starts", F.coalesce("marked", F.lit(False)).alias("marked"))
    schema = f"id {kind}, sig int, n_words long, n_removed long, kept_sha256 string" + ", kept string" * (not digest_only)
    return marked.mapInArrow(run, schema)


def shortened(text: bytes, starts: np.ndarray | None) -> bytes:
    """The text as it is if it loses nothing, or else the words left, with single spaces."""
    n, kept = kept_words(text, starts)
    return text if len(kept) == n else b" ".join(kept)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated windows removed from the text; all columns and rows stay.

    A text that loses nothing stays as it is; of another, the words left are joined by single spaces, and a column
    n_chars, if there is one, becomes the length of the new text. Null texts stay null.
    """
    names = docs.columns
    own_id, own_sig, marks = (fresh(docs, x) for x in ("_id", "_sig", "_starts"))
    starts = repeated_starts(docs, id_col, text_col).withColumnsRenamed({"id": own_id, "sig": own_sig, "starts": marks})
    sig = F.hash(F.coalesce(F.col(text_col), F.lit("")))
    own = [F.col(f"`{c}`") for c in names]
    marked = docs.join(starts, (F.col(id_col) == F.col(own_id)) & (sig == F.col(own_sig)), "left").select(*own, F.col(marks), F.col(own_id).isNotNull().alias(own_id))
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                texts = [
                    shortened(text.as_buffer().to_pybytes(), _own_starts(mark, own)) if text.is_valid else None
                    for text, own, mark in zip(part.column(at), part.column(len(names)), part.column(len(names) + 1), strict=True)
                ]
                columns = list(part.columns)[: len(names)]
                columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = marked.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col))
        out = out.withColumn("n_chars", length.cast(kind))
    return out
