"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

The segmentations of a text are the paths of its piece lattice, each with the product of its pieces' weights as
probability. Adding a Gumbel variable to every path's log-probability and taking the k greatest samples k paths without
replacement. The paths are far too many to list, so a perturbed A-star search visits regions of the lattice, best first:
the greatest perturbed value of a region is drawn from its total probability, the best path of the best region is found
by sampling its edges forward, and the region is split at each edge of that path into one region per edge left out,
whose values are drawn below the region's own. Every text needs k forward samples and no more, whatever its length.

All texts of a batch move at once in numpy. Pieces never cross a word start, so lattices are built once for each
different word of a batch. Random numbers come from a counter over (row key, place, sample): a row's samples
depend neither on its batch nor on the run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.text import buffers, mix, pieces, uniform

SPACE = 0x2581
MULT = np.uint64(0x9E3779B97F4A7C15)
#: In place of a piece: characters that some piece begins with, but that aren't one; a character's bytes.
PREFIX, BYTES = -3, -2
#: Texts worked on at once: little enough for a core's cache.
PIECE_BYTES = 1 << 17


def default_model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@dataclass
class Vocabulary:
    """Pieces of a model as arrays.

    A merge-rank model holds ranks, not probabilities; a piece of rank r weighs (r + 2) ** -sharpness, the Zipf
    prior that its ranks imply. A model of unigram scores keeps its log-probabilities, times ``sharpness``.
    """

    names: list[str]
    weight: np.ndarray  # log weight by id
    byte_id: np.ndarray  # id of each byte's fallback piece
    unknown: int
    byte_weight: float
    longest: int
    slots: np.ndarray  # hash table: keys and ids, by the top bits of the key
    slot_ids: np.ndarray
    slot_bits: int
    joins: np.ndarray  # by code point: whether a piece of several characters holds it

    @classmethod
    def load(cls, path: str, sharpness: float = 1.0) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        piece = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        # a score of -1e9 marks what merging never makes; of that, single characters remain, as the last rank
        scores[(scores <= -1e8) & np.array([len(x) == 1 for x in names])] = scores[scores > -1e8].min() - 1
        usable = [i for i in piece if scores[i] > -1e8]
        if any(chr(SPACE) in names[i].lstrip(chr(SPACE)) for i in usable):
            raise ValueError("a piece crosses a word start")
        own = scores[usable]
        ranked = len(own) > 0 and bool(np.all(own == np.round(own)))
        weight = np.full(n, -np.inf)
        weight[usable] = -sharpness * np.log(2 - own) if ranked else sharpness * own
        byte_id = np.full(256, -1, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                byte_id[int(names[i][3:5], 16)] = i
        held = {names[i][:m]: PREFIX for i in usable for m in range(1, len(names[i]))} | {names[i]: i for i in usable}
        keys = {x: cls.key(x) for x in held}
        bits = 20
        while True:  # four entries a slot at most
            slot = {x: cls.slot(k, bits) for x, k in keys.items()}
            if np.bincount(list(slot.values()) or [0]).max() <= 4:
                break
            bits += 1
        slots, slot_ids = np.zeros((4, 1 << bits), np.uint64), np.full((4, 1 << bits), -1, np.int32)
        taken = np.zeros(1 << bits, np.int64)
        for x, i in held.items():
            s = slot[x]
            slots[taken[s], s], slot_ids[taken[s], s] = keys[x], i
            taken[s] += 1
        joins = np.zeros(0x110000, bool)
        joins[[ord(c) for i in usable if len(names[i]) > 1 for c in names[i]]] = True
        least = float(weight[usable].min()) if usable else 0.0
        longest = max((len(names[i]) for i in usable), default=1)
        return cls(names, weight, byte_id, sp.unk_id(), least - np.log(256), longest, slots, slot_ids, bits, joins)

    @staticmethod
    def key(name: str) -> int:
        h = 0
        for c in name:
            h = (h * int(MULT) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def slot(key: int, bits: int) -> int:
        return (key * int(MULT) & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each key; PREFIX where longer pieces begin so; -1 where none does."""
        slot = ((keys * MULT) >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        out = np.where(self.slots[0][slot] == keys, self.slot_ids[0][slot], -1)
        for k in range(1, 4):
            rest = np.flatnonzero((out == -1) & (self.slot_ids[k][slot] != -1))
            if not len(rest):
                break
            hit = self.slots[k][slot[rest]] == keys[rest]
            out[rest[hit]] = self.slot_ids[k][slot[rest[hit]]]
        return out


@dataclass
class Lattice:
    """Lattices of different words, end to end; a word of m characters has m + 1 nodes.

    A node's edges lie together, longest first: ``begin[node]`` and ``degree[node]`` tell where.
    """

    begin: np.ndarray
    degree: np.ndarray
    length: np.ndarray
    piece: np.ndarray  # BYTES: those of the character
    log_prob: np.ndarray  # of the edge at its node
    cum: np.ndarray  # running sum over the node's edges, 2 at its last

    def edges(self, nodes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edge, length as a bit, probability) in a row for each node; probability 0 where there is no edge."""
        step = np.arange(width)[None, :]
        valid = step < self.degree[nodes][:, None]
        edge = np.where(valid, self.begin[nodes][:, None] + step, 0)
        return edge, 1 << (self.length[edge].astype(np.int64) - 1), np.where(valid, np.exp(self.log_prob[edge]), 0.0)


def lattice(chars: np.ndarray, starts: np.ndarray, lens: np.ndarray, voc: Vocabulary) -> tuple[Lattice, np.ndarray]:
    """Lattices of the words ``chars[starts : starts + lens]`` and the first node of each."""
    base = np.cumsum(lens + 1) - (lens + 1)
    nodes = int((lens + 1).sum())
    char = np.zeros(nodes, np.uint64)
    place = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    at = np.repeat(base, lens) + place
    char[at] = chars[np.repeat(starts, lens) + place]
    left = np.zeros(nodes, np.int64)
    left[at] = np.repeat(lens, lens) - place
    degree = np.zeros(nodes, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live, key = at, np.zeros(len(at), np.uint64)
    for m in range(1, voc.longest + 1):
        key = key * MULT + char[live + m - 1] + np.uint64(1)
        ids = voc.lookup(key)
        begun = ids != -1
        if m == 1:
            ids = np.where(ids < 0, BYTES, ids)
        hit = ids > PREFIX if m == 1 else ids >= 0
        own, ids = live[hit], ids[hit]
        shorter = degree[own]
        found.append((own, ids, shorter))
        degree[own] = shorter + 1
        more = begun & (left[live] > m)
        live, key = live[more], key[more]
        if not len(live):
            break
    order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
    begin = np.empty(nodes, np.int64)
    begin[order] = np.cumsum(degree[order]) - degree[order]
    total = int(degree.sum())
    length, piece, weight, to = np.empty(total, np.int8), np.empty(total, np.int32), np.empty(total), np.empty(total, np.int64)
    last = begin + degree - 1
    for m, (own, ids, shorter) in enumerate(found, 1):
        e = last[own] - shorter
        length[e], piece[e], to[e], weight[e] = m, ids, own + m, voc.weight[ids]
        if m == 1 and len(odd := np.flatnonzero(ids == BYTES)):
            c = char[own[odd]]
            weight[e[odd]] = voc.byte_weight * (1 + (c >= 0x80).astype(int) + (c >= 0x800) + (c >= 0x10000))
    beta = np.zeros(nodes)
    ends = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = order[a:b]
        e, n = begin[own], degree[own]
        span = slice(e[0], e[-1] + n[-1])
        score = weight[span] + beta[to[span]]
        top = np.maximum.reduceat(score, e - e[0])
        beta[own] = top + np.log(np.add.reduceat(np.exp(score - np.repeat(top, n)), e - e[0]))
        weight[span] = score - np.repeat(beta[own], n)
    cum = np.cumsum(np.exp(weight))
    own = order[ends[0] :]  # the nodes with edges, in the order of their edges
    cum -= np.repeat(np.concatenate([[0.0], cum])[begin[own]], degree[own])
    cum[begin[own] + degree[own] - 1] = 2.0  # whatever is drawn, an edge that exists is taken
    return Lattice(begin, degree, length, piece, weight, cum), base


@dataclass
class Texts:
    """Characters of a batch with the word starts of each text."""

    chars: np.ndarray
    first: np.ndarray  # first character of each text
    word_at: np.ndarray  # first character of each word
    word_first: np.ndarray  # first word of each text


def prepared(texts: pa.Array, voc: Vocabulary) -> Texts:
    """Spaces become SPACE, and each text but an empty one gets one before it, as the model's own encoder does."""
    data, offsets = buffers(texts)
    raw = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    n = np.diff(begins)
    some = (n > 0).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n + some)])
    chars = np.full(first[-1], SPACE, np.uint32)
    row = np.repeat(np.arange(len(n)), n)
    chars[np.arange(len(raw)) - begins[row] + first[row] + 1] = np.where(raw == 0x20, SPACE, raw)
    space = chars == SPACE
    alone = ~voc.joins[chars]
    start = alone.copy()
    start[1:] |= alone[:-1] | (space[1:] & ~space[:-1])
    start[first[:-1][n > 0]] = True
    word_at = np.flatnonzero(start)
    return Texts(chars, first, word_at, np.searchsorted(word_at, first))


def different(chars: np.ndarray, at: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one word of each spelling, and each word's spelling; compared on the characters themselves."""
    place = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    powers = np.cumprod(np.full(int(lens.max(initial=1)), MULT, np.uint64))
    values = (chars.astype(np.uint64) + np.uint64(1)) * powers[place]
    keys = mix(np.add.reduceat(values, at)) if len(at) else np.zeros(0, np.uint64)
    _, one, which = np.unique(keys, return_index=True, return_inverse=True)
    same = np.array_equal(lens, lens[one][which]) and np.array_equal(chars, chars[np.repeat(at[one][which], lens) + place])
    return (one, which) if same else (np.arange(len(at)), np.arange(len(at)))


@dataclass
class Path:
    """One sample of every text: by character, the piece that starts there (length 0: none)."""

    length: np.ndarray
    log_prob: np.ndarray
    piece: np.ndarray
    split: np.ndarray  # by text: where it left its parent
    left_out: np.ndarray  # by text: lengths that its region excluded there, as bits
    value: np.ndarray  # by text: perturbed log-probability


def sample(texts: pa.Array, seeds: np.ndarray, k: int, voc: Vocabulary) -> tuple[Texts, list[Path], np.ndarray, np.ndarray]:
    """Up to k distinct segmentations of each text, best perturbed value first.

    Returns the texts, a Path for each rank, how many ranks each text has, and each text's threshold: the
    perturbed value of the next segmentation, minus infinity if there is none.
    """
    t = prepared(texts, voc)
    n_chars, n_texts = len(t.chars), len(texts)
    lens = np.diff(np.append(t.word_at, n_chars))
    one, which = different(t.chars, t.word_at, lens)
    lat, base = lattice(t.chars, t.word_at[one], lens[one], voc)
    node_of_word = base[which]
    text_of_char = np.repeat(np.arange(n_texts), np.diff(t.first))
    place = np.arange(n_chars) - t.first[text_of_char]
    word_of_char = np.repeat(np.arange(len(lens)), lens)
    end_of_word = t.word_at + lens
    counter = (seeds[text_of_char] + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) if n_chars else np.zeros(0, np.uint64)
    salt = lambda s, kind: np.uint64((s * 4 + kind + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)

    def walk(path: Path, at: np.ndarray, s: int) -> None:
        """Sample on from the characters ``at``, each to the end of its word."""
        end = end_of_word[word_of_char[at]]
        node = node_of_word[word_of_char[at]] + at - t.word_at[word_of_char[at]]
        while len(at):
            u = uniform(counter[at] ^ salt(s, 0))
            edge = lat.begin[node]
            todo = np.flatnonzero(lat.cum[edge] < u)
            while len(todo):
                edge[todo] += 1
                todo = todo[lat.cum[edge[todo]] < u[todo]]
            step = lat.length[edge]
            path.length[at], path.log_prob[at], path.piece[at] = step, lat.log_prob[edge], lat.piece[edge]
            at, node = at + step, node + step
            more = at < end
            at, node, end = at[more], node[more], end[more]

    def regions(path: Path, live: np.ndarray, s: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` best regions that the path of each text splits off: their values and characters."""
        values, places = np.full((n_texts, most), -np.inf), np.full((n_texts, most), -1)
        on = np.flatnonzero((path.length > 0) & live[text_of_char]) if n_chars else np.zeros(0, np.int64)
        if not len(on) or not most:
            return values, places
        row = text_of_char[on]
        lp = path.log_prob[on].astype(np.float64)
        total = np.cumsum(lp)
        begin = np.searchsorted(row, np.arange(n_texts))
        before = total - lp - (total - lp)[begin[row]]
        with np.errstate(divide="ignore", over="ignore"):
            phi = before + np.log(-np.expm1(lp))
            at_split = on == path.split[row]
            if at_split.any():
                own = np.flatnonzero(at_split)
                c, r = on[own], row[own]
                node = node_of_word[word_of_char[c]] + c - t.word_at[word_of_char[c]]
                mask = path.left_out[r] | (1 << (path.length[c].astype(np.int64) - 1))
                _, bit, prob = lat.edges(node, voc.longest)
                rest = np.where(bit & mask[:, None], 0.0, prob).sum(1)
                phi[own] = before[own] + np.log(rest)
            phi[on < path.split[row]] = -np.inf
            wait = -np.log(uniform(counter[on] ^ salt(s, 1)))
            value = phi - np.log(wait + np.exp(phi - path.value[row]))
        value[np.isneginf(phi)] = -np.inf
        has = np.flatnonzero(np.bincount(row, minlength=n_texts))
        for j in range(most):
            top = np.full(n_texts, -np.inf)
            top[has] = np.maximum.reduceat(value, begin[has])
            hit = np.flatnonzero((value == top[row]) & np.isfinite(value))
            if not len(hit):
                break
            rows, index = np.unique(row[hit], return_index=True)
            values[rows, j], places[rows, j] = top[rows], on[hit[index]]
            value[hit[index]] = -np.inf
        return values, places

    def empty() -> Path:
        return Path(
            np.zeros(n_chars, np.int8), np.zeros(n_chars, np.float32), np.full(n_chars, -1, np.int32),
            np.full(n_texts, -1), np.zeros(n_texts, np.int64), np.full(n_texts, -np.inf),
        )

    seeded = mix(seeds) if n_texts else seeds
    first = empty()
    first.value = -np.log(-np.log(uniform(seeded)))  # all probability together is 1
    walk(first, t.word_at, 0)
    paths, count, live = [first], np.ones(n_texts, np.int64), np.ones(n_texts, bool)
    values, places = regions(first, live, 0, k)
    source = np.zeros(values.shape, np.int64)
    for s in range(1, k):
        best = values.argmax(1) if values.shape[1] else np.zeros(n_texts, np.int64)
        rows = np.arange(n_texts)
        live = np.isfinite(values[rows, best])
        path = empty()
        path.value = np.where(live, values[rows, best], -np.inf)
        path.split = np.where(live, places[rows, best], -1)
        parent = source[rows, best]
        values[rows, best] = -np.inf
        for p in range(s):
            use = live & (parent == p)
            if not use.any():
                continue
            old = paths[p]
            copy = use[text_of_char] & (np.arange(n_chars) < path.split[text_of_char])
            for x, y in ((path.length, old.length), (path.log_prob, old.log_prob), (path.piece, old.piece)):
                x[copy] = y[copy]
            inherited = np.where(old.split == path.split, old.left_out, 0)
            own = np.flatnonzero(use)
            path.left_out[own] = inherited[own] | (1 << (old.length[path.split[own]].astype(np.int64) - 1))
        own = np.flatnonzero(live)
        c = path.split[own]
        word = word_of_char[c]
        node = node_of_word[word] + c - t.word_at[word]
        edges, bit, prob = lat.edges(node, voc.longest)
        share = np.cumsum(np.where(bit & path.left_out[own][:, None], 0.0, prob), 1)
        u = uniform(counter[c] ^ salt(s, 2)) * share[:, -1]
        edge = edges[np.arange(len(c)), np.minimum((share <= u[:, None]).sum(1), voc.longest - 1)]
        path.length[c], path.piece[c], path.log_prob[c] = lat.length[edge], lat.piece[edge], lat.log_prob[edge]
        on = c + lat.length[edge]
        later = live[text_of_char[t.word_at]] & (t.word_at > path.split[text_of_char[t.word_at]])
        walk(path, np.concatenate([on[on < end_of_word[word]], t.word_at[later]]), s)
        paths.append(path)
        count += live
        more_values, more_places = regions(path, live, s, k - s)
        values, places = np.concatenate([values, more_values], 1), np.concatenate([places, more_places], 1)
        source = np.concatenate([source, np.full(more_values.shape, s)], 1)
    threshold = values.max(1) if values.shape[1] else np.full(n_texts, -np.inf)
    return t, paths, count, threshold


def path_ids(t: Texts, path: Path, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of every text and where each text's begin; a character without a piece becomes its bytes."""
    on = np.flatnonzero(path.length)
    ids = path.piece[on].astype(np.int64)
    first = np.searchsorted(on, t.first)
    odd = np.flatnonzero(ids == BYTES)
    if len(odd):
        code = [chr(c).encode("utf-8", "surrogatepass") for c in t.chars[on[odd]]]
        if (voc.byte_id < 0).any():
            ids[odd] = voc.unknown
        else:
            counts = np.ones(len(ids), np.int64)
            counts[odd] = [len(c) for c in code]
            ids = np.repeat(ids, counts)
            ids[ids == BYTES] = voc.byte_id[np.frombuffer(b"".join(code), np.uint8)]
            first = np.concatenate([[0], np.cumsum(counts)])[first]
    return ids.astype(np.int32), first


class Decoder:
    """Texts from piece ids, many at once."""

    def __init__(self, voc: Vocabulary) -> None:
        byte_of = {int(i): b for b, i in enumerate(voc.byte_id) if i >= 0}
        parts = [
            bytes([byte_of[i]]) if i in byte_of else x.replace(chr(SPACE), " ").encode() if np.isfinite(voc.weight[i]) else b""
            for i, x in enumerate(voc.names)
        ]
        self.lens = np.array([len(x) for x in parts])
        self.starts = np.cumsum(self.lens) - self.lens
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """UTF-8 of each text, without the space that encoding put before it; ids of no text give nothing."""
        n = self.lens[ids]
        end = np.cumsum(n)
        take = np.arange(int(n.sum())) + np.repeat(self.starts[ids] - (end - n), n)
        data = self.data[take].tobytes()
        at = np.concatenate([[0], end])[first]
        out = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return [x[1:] if x[:1] == b" " else x for x in out]


def _offsets(first: np.ndarray) -> pa.Array:
    return pa.array(first, pa.int32())


def encoded(
    docs: DataFrame,
    k: int = 2,
    key_cols: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    model_path: str | None = None,
    sharpness: float = 1.0,
    seed: int = 42,
    with_ids: bool = True,
    with_texts: bool = False,
) -> DataFrame:
    """Up to k distinct segmentations of each row's text.

    Returns the key columns and: rank (1 is best), n_pieces, ids (unless ``with_ids`` is false), ids_hash, log_prob
    (of the segmentation), perturbed (with its Gumbel variable), inclusion (probability that its perturbed value
    passes the threshold, the value of the next segmentation: the weight 1 / inclusion makes sums over samples
    unbiased) and decoded_ok (decoding the ids gives the text back; false where the text itself holds U+2581, which
    stands for a space); with ``with_texts`` also decoded, that text. A text with fewer segmentations gives them all, with inclusion 1. A null or empty text has one,
    without pieces. Samples are seeded by the key columns: rows that repeat a key and text get equal samples; null keys
    are one more value. One pass, no shuffle.
    """
    voc = Vocabulary.load(model_path or default_model_path(), sharpness)
    sent = docs.sparkSession.sparkContext.broadcast(voc)
    keys = [f"k{i}" for i in range(len(key_cols))]
    kinds = [docs.schema[c].dataType.simpleString() for c in key_cols]
    fields = [f"{a} {b}" for a, b in zip(keys, kinds, strict=True)]
    tail = [("rank", pa.int32()), ("n_pieces", pa.int32()), ("ids_hash", pa.int64()), ("log_prob", pa.float64())]
    tail += [("perturbed", pa.float64()), ("inclusion", pa.float64()), ("decoded_ok", pa.bool_())]
    schema = ", ".join([*fields, "rank int, n_pieces int, ids_hash long, log_prob double, perturbed double, inclusion double, decoded_ok boolean"])
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = sent.value
        decoder = Decoder(voc)
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                texts = part.column("text")
                seeds = part.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)
                t, paths, count, threshold = sample(texts, seeds, k, voc)
                data, offsets = buffers(texts)
                data = data.tobytes()
                for s, path in enumerate(paths):
                    has = np.flatnonzero(count > s)
                    if not len(has):
                        break
                    ids, first = path_ids(t, path, voc)
                    lp = np.concatenate([[0.0], np.cumsum(path.log_prob, dtype=np.float64)])
                    lp = lp[t.first[1:]] - lp[t.first[:-1]]
                    with np.errstate(over="ignore"):
                        inclusion = -np.expm1(-np.exp(lp - threshold))
                    back = decoder.decode(ids, first)
                    ok = [x == data[a:b] for x, a, b in zip(back, offsets[:-1], offsets[1:], strict=True)]
                    spread = mix(ids.astype(np.uint64) + (np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64) * MULT)
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread)])
                    h = (sums[first[1:]] - sums[first[:-1]]).view(np.int64)
                    rows = pa.array(has)
                    columns = [part.column(c).take(rows) for c in keys]
                    values = [np.full(len(has), s + 1), np.diff(first)[has], h[has], lp[has], path.value[has], inclusion[has], np.array(ok)[has]]
                    columns += [pa.array(v, kind) for v, (_, kind) in zip(values, tail, strict=True)]
                    names = [*keys, *(x for x, _ in tail)]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(_offsets(first), pa.array(ids)).take(rows))
                        names.append("ids")
                    if with_texts:
                        columns.append(pa.array([back[i].decode("utf-8", "replace") for i in has], pa.string()))
                        names.append("decoded")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(
        *[F.col(c).alias(x) for c, x in zip(key_cols, keys, strict=True)],
        F.xxhash64(F.lit(seed), *key_cols).alias("seed"),
        F.col(text_col).alias("text"),
    )
    out = rows.mapInArrow(run, schema)
    return out.withColumnsRenamed(dict(zip(keys, key_cols, strict=True)))


def decoded(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model_path: str | None = None) -> DataFrame:
    """``rows`` with the text of ``ids_col`` in ``out_col`` (bytes that aren't UTF-8 become U+FFFD; null stays null).

    ``out_col`` replaces a column of that name. Ids outside the vocabulary raise an error.
    """
    voc = Vocabulary.load(model_path or default_model_path())
    sent = rows.sparkSession.sparkContext.broadcast(voc)
    plain = rows.drop(out_col)
    names = plain.columns
    schema = T.StructType([*plain.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            column = batch.column(names.index(ids_col))
            lists = column.fill_null([]) if column.null_count else column
            ids = np.asarray(lists.flatten(), np.int64)
            first = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))])
            texts = decoder.decode(ids, first)
            valid = column.is_valid().to_pylist()
            out = [x.decode("utf-8", "replace") if v else None for x, v in zip(texts, valid, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, out_col])

    return plain.mapInArrow(run, schema)
