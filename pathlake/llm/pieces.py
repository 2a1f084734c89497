"""SentencePiece encoding and decoding, with distinct sampled segmentations.

All segmentations of a text into vocabulary pieces form a lattice. Gumbel top-k draws k of them without
replacement: the best perturbed path is an ordinary sample; what is left splits, at each step of that
path, into the paths that leave it there, each of which has a Gumbel bounded by that of the path it left; the
search (A* on perturbed log probabilities) always opens the set with the greatest one. Every random number
is a function of the row's key, the sample's number and the place in the text, so a row gives the same
samples on any executor.

No piece reaches over the start of a word, so the lattice falls into words; the table of a word (its
states, edges and their probabilities) is built once and drawn from by arrays.

The vocabulary is a file of merges without probabilities. A piece of rank r has probability
proportional to 1 / (r + SMOOTH), by Zipf's law of ranks.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field as dc_field
from hashlib import sha256
from itertools import chain, islice
from math import exp, expm1, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from pathlake.llm.common import field, give_back, spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SMOOTH, SEED = 3, 10.0, 20
SPACE = "▁"
#: Stands for a U+2581 of the text itself, which has no piece of its own but its bytes.
OWN_SPACE = "\ud800"
BYTE_LOGP = -12.0
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Characters of the words whose tables are built at once: bounds the memory that this takes.
BLOCK = 1 << 16
#: Steps of a path that are looked at together, and paths with which they are.
WIDTH, SLAB = 256, 512
MASK = (1 << 64) - 1
#: Uniform numbers have 53 bits, so no exponential is under 2^-54 and no Gumbel this far above its location.
FARTHEST = 38.0


@dataclass
class Vocabulary:
    """Pieces by their surface, their log probabilities, and the ids of single bytes."""

    ids: dict[str, int]
    logp: dict[str, float]
    byte_ids: list[int]
    longest: int
    surface: list[str | None] = dc_field(default_factory=list)  # None: a byte that is no character of its own


def bytes_of(char: str) -> bytes:
    return SPACE.encode() if char == OWN_SPACE else char.encode()


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, rank, byte_ids = {}, {}, [0] * 256
    surface: list[str | None] = [None] * sp.get_piece_size()
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte = int(piece[3:5], 16)
            byte_ids[byte] = i
            surface[i] = chr(byte) if byte < 128 else None
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            ids[piece], rank[piece] = i, -sp.get_score(i)
            surface[i] = piece
    inside = [p for p in ids if SPACE in p.lstrip(SPACE)]
    if inside:
        raise ValueError(f"pieces reach over word starts: {inside[:3]}")
    z = log(sum(1 / (r + SMOOTH) for r in rank.values()))
    return Vocabulary(ids, {p: -log(r + SMOOTH) - z for p, r in rank.items()}, byte_ids, max(map(len, ids)), surface)


def prepare(text: str) -> str:
    """Spaces as U+2581, one more before the text; an empty text stays empty."""
    return SPACE + text.replace(SPACE, OWN_SPACE).replace(" ", SPACE) if text else ""


def words(prepared: str) -> list[str]:
    """The parts that no piece reaches over. Runs of spaces go with the word after them."""
    return WORD.findall(prepared)


def cut(text: str) -> list[str]:
    """words(prepare(text)), each without its first U+2581, with which every word begins."""
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in words(prepare(text))]
    return text.split(" ")


class Trie:
    """The vocabulary as arrays: children of a node by character class (dense for the commonest classes), which nodes are pieces, and the bytes of pieces."""

    DENSE = 96

    def __init__(self, v: Vocabulary):
        use: dict[str, int] = {}
        for piece in v.ids:
            for c in piece:
                use[c] = use.get(c, 0) + 1
        chars = sorted(use, key=lambda c: (-use[c], c))
        number = {c: i + 1 for i, c in enumerate(chars)}  # 0: in no piece
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in chars]] = range(1, len(chars) + 1)
        self.n_classes = len(chars) + 1
        # nodes are prefixes of pieces; those with children have the lower numbers, as they alone need a row
        inner = {piece[:n] for piece in v.ids for n in range(len(piece))}
        node = {p: i for i, p in enumerate(["", *sorted(inner - {""}), *sorted(set(v.ids) - inner)])}
        self.n_inner = len(inner)
        self.piece, self.logp = np.full(len(node), -1, np.int32), np.full(len(node), -np.inf)
        for p, i in v.ids.items():
            self.piece[node[p]], self.logp[node[p]] = i, v.logp[p]
        self.dense = np.zeros((self.n_inner + 1) * self.DENSE, np.int32)
        rare = []
        for p, i in node.items():
            if p:
                at, k = node[p[:-1]], number[p[-1]]
                if k < self.DENSE:
                    self.dense[at * self.DENSE + k] = i
                else:
                    rare.append((at * self.n_classes + k, i))
        rare.sort()
        self.keys = np.array([k for k, _ in rare] or [-1], np.int64)
        self.to = np.array([t for _, t in rare] or [0], np.int32)
        self.longest, self.byte_ids = v.longest, np.array(v.byte_ids, np.int32)
        said = [(x or "").replace(SPACE, " ").encode() for x in v.surface]
        for b, i in enumerate(v.byte_ids):
            said[i] = bytes([b])
        self.length = np.fromiter(map(len, said), np.int32, len(said))
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.bytes = np.frombuffer(b"".join(said), np.uint8)

    def step(self, node: np.ndarray, k: np.ndarray, common: bool) -> np.ndarray:
        """The children of nodes for classes k, 0 where there is none; `common`: all classes are dense ones."""
        row = np.minimum(node, self.n_inner) * self.DENSE  # the last row is that of all leaves
        if common:
            return self.dense[row + k]
        near = k < self.DENSE
        out = self.dense[row + np.where(near, k, 0)]
        far = np.flatnonzero(~near)
        if len(far):
            key = node[far].astype(np.int64) * self.n_classes + k[far]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[far] = np.where(self.keys[at] == key, self.to[at], 0)
        return out


def tables(keys: list[str], trie: Trie) -> dict[str, np.ndarray]:
    """The lattices of some words (without their first U+2581) as flat arrays.

    States are numbered by how far into its word they are: first the starts of all words, then what is reached after one
    character, and so on. first and count say which edges end in a state, the longest piece first. Of an edge: prev, the
    state that it comes from (-1: a start); its piece's id and log probability; q, its probability given the state that it ends in, and rest,
    that of the other edges there. last are the states in which the words end. A character without a piece is its byte,
    or, if it has several, minus its code point, to be written as bytes later.
    """
    mark = f"\n{SPACE}"  # a line feed stands for each word's start
    text = mark + mark.join(keys)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, wide = len(points), trie.longest
    lengths = np.fromiter(map(len, keys), np.int64, len(keys)) + 2
    ends = np.cumsum(lengths)
    begin = ends - lengths
    k = np.concatenate([trie.classes[points], np.zeros(wide, np.int32)])
    k[begin] = 0  # no piece reaches over a start or over the end
    common = bool(k.max() < trie.DENSE)
    local = np.arange(n) - np.repeat(begin, lengths)
    deepest = int(lengths.max())
    order = np.argsort(local.astype(np.int16) if deepest < 1 << 15 else local, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    at = np.flatnonzero(k)
    node, found = np.zeros(len(at), np.int32), []
    single = np.zeros(n, bool)
    single[begin] = True
    for size in range(1, wide + 1):
        node = trie.step(node, k[at + (size - 1)], common)
        on = np.flatnonzero(node)
        if not len(on):
            break
        at, node = at[on], node[on]
        piece = trie.piece[node]
        ok = np.flatnonzero(piece >= 0)
        found.append((size, at[ok], piece[ok], trie.logp[node[ok]]))
        if size == 1:
            single[at[ok]] = True
    bare = np.flatnonzero(~single)
    if len(bare):
        low = points[bare] < 128
        ids = np.where(low, trie.byte_ids[np.minimum(points[bare], 127)], -points[bare].astype(np.int64)).astype(np.int32)
        n_bytes = np.ones(len(bare))
        for i in np.flatnonzero(~low).tolist():
            n_bytes[i] = len(bytes_of(chr(points[bare[i]])))
        found.append((1, bare, ids, BYTE_LOGP * n_bytes))
    size = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
    start = np.concatenate([f[1] for f in found])
    state = rank[start + size - 1]
    key = (state * (wide + 1) + (wide - size)) << 32 | np.arange(len(start))
    key.sort()
    pick = key & 0xFFFFFFFF
    state, prev = state[pick], rank[start[pick] - 1]
    ids = np.concatenate([f[2] for f in found])[pick]
    lp = np.concatenate([f[3] for f in found])[pick]
    count = np.bincount(state, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    q = np.empty(len(lp))
    level = np.cumsum(np.bincount(local)).tolist()
    # a state is at least as probable as its characters one by one: where that is no denormal number, logarithms are not needed
    plain = deepest * -lp[size[pick] == 1].min() < 700
    total = np.ones(n) if plain else np.zeros(n)
    p = np.exp(lp) if plain else lp
    for lo, hi in zip(level, level[1:]):
        a, b = int(first[lo]), int(first[hi])
        head, own = first[lo:hi] - a, state[a:b] - lo
        if plain:
            e = p[a:b] * total[prev[a:b]]
            total[lo:hi] = z = np.add.reduceat(e, head)
        else:
            e = p[a:b] + total[prev[a:b]]
            m = np.maximum.reduceat(e, head)
            e = np.exp(e - m[own])
            z = np.add.reduceat(e, head)
            total[lo:hi] = m + np.log(z)
        q[a:b] = e / z[own]
    # what is near 1 is not subtracted from it: the others are summed
    most = np.flatnonzero(q > 0.5)
    others = q.copy()
    others[most] = 0.0
    rest = 1.0 - q
    rest[most] = np.add.reduceat(others, first[len(keys) : n])[state[most] - len(keys)]
    return {"first": first[:-1], "count": count, "prev": np.where(prev < len(keys), -1, prev), "ids": ids, "logp": lp, "q": q, "rest": rest, "last": rank[ends - 1]}


class Numbers(dict):
    """Words by number, in order of their first sight."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class Lattice:
    """The tables of all words met so far, as flat arrays that grow in place until they hold MOST edges and are then begun anew. MORE: room for one chunk's."""

    MOST, MORE = 700_000, 200_000
    EDGE = {"prev": np.int32, "ids": np.int32, "logp": np.float32, "q": np.float64, "rest": np.float64}

    def __init__(self, trie: Trie):
        self.trie = trie
        self.edge = {k: np.empty(self.MOST + self.MORE, t) for k, t in self.EDGE.items()}  # memory is taken as it is filled
        self.node = {k: np.empty((self.MOST + self.MORE) // 2, np.int32) for k in ("first", "count")}
        self.clear()

    def clear(self):
        self.number = Numbers()
        self.last = np.empty(0, np.int64)
        self.n_states = self.n_edges = 0

    @staticmethod
    def _put(arrays: dict, at: int, new: dict) -> int:
        size = len(next(iter(new.values())))
        for k, x in new.items():
            if at + size > len(arrays[k]):
                arrays[k] = np.concatenate([arrays[k][:at], np.empty(max(at, size), arrays[k].dtype)])
            arrays[k][at : at + size] = x
        return at + size

    def add(self, parts: list[list[str]]) -> np.ndarray:
        """Numbers of the words of all texts, in order; their tables are there afterwards."""
        if self.n_edges > self.MOST:
            self.clear()
        had = len(self.number)
        codes = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        fresh = list(islice(self.number, had, None))
        lasts = [self.last]
        for lo, hi in chunks(list(map(len, fresh)), BLOCK):
            t = tables(fresh[lo:hi], self.trie)
            t["prev"] += np.where(t["prev"] < 0, 0, self.n_states)
            t["first"] += self.n_edges
            lasts.append(t["last"] + self.n_states)
            self.n_states = self._put(self.node, self.n_states, {k: t[k] for k in self.node})
            self.n_edges = self._put(self.edge, self.n_edges, {k: t[k] for k in self.edge})
        self.last = np.concatenate(lasts)
        self.first, self.count = self.node["first"], self.node["count"]
        self.prev, self.ids, self.logp, self.q, self.rest = (self.edge[k] for k in self.EDGE)
        return codes

    def choose(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge into each state, by its probability."""
        e = self.first[state]
        left = u - self.q[e]
        on = np.flatnonzero(left >= 0)
        last = e[on] + self.count[state[on]] - 1
        more = np.flatnonzero(e[on] < last)
        on, last, left = on[more], last[more], left[on[more]]
        while len(on):
            x = e[on] + 1
            e[on] = x
            left = left - self.q[x]
            more = np.flatnonzero((left >= 0) & (x < last))
            on, last, left = on[more], last[more], left[more]
        return e

    def finish(self, state: np.ndarray, base: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """(edges, token) of paths from each token's state back to its word's start, in order of tokens and then of steps; state -1: none."""
        found = []
        token, step = np.flatnonzero(state >= 0), 0
        count = np.zeros(len(state), np.int64)
        state, base = state[token], base[token]
        while len(token):
            e = self.choose(state, uniform(base, sample, step))
            found.append((token, e))
            state = self.prev[e]
            on = np.flatnonzero(state >= 0)
            step += 1
            count[token] = step
            token, state, base = token[on], state[on], base[on]
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for step, (token, e) in enumerate(found):
            out[first[token] + step] = e
        return out, np.repeat(np.arange(len(count)), count)

    def others(self, state: int, taken: frozenset) -> tuple[np.ndarray, np.ndarray]:
        """The edges into a state that are not taken, and their probabilities."""
        lo = int(self.first[state])
        e = np.array([x for x in range(lo, lo + int(self.count[state])) if x not in taken], np.int64)
        return e, self.q[e]


def place_of(seed: np.ndarray, place) -> np.ndarray:
    """What the random numbers of a place in a row begin with."""
    with np.errstate(over="ignore"):
        return seed + np.asarray(place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def uniform(base: np.ndarray, sample: int, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on row, place, sample and step alone (splitmix64)."""
    with np.errstate(over="ignore"):
        x = base + np.uint64((sample * 0xD1342543DE82EF95 + step * 0x2545F4914F6CDD1D + 0x632BE59BD9B4E019) & MASK)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) * 2.0**-53


@dataclass
class Sample:
    ids: np.ndarray
    logp: float  # log probability of the segmentation
    score: float  # perturbed log probability: samples come in falling order of it
    inclusion: float  # probability that the segmentation's score passes the threshold, the greatest score left
    mass: float = 0.0  # log probability among all segmentations of the text
    round_trip: bool = True  # whether the ids decode to the text


@dataclass
class Open:
    """A set of paths: those that share `path` up to a step and take none of the `taken` edges into `state` there. before: log mass of what they share."""

    path: np.ndarray
    tokens: np.ndarray
    step: int
    state: int
    taken: frozenset
    before: float


class Sampler:
    """Draws from a vocabulary; keeps the tables of the words met so far."""

    def __init__(self, vocabulary: Vocabulary | Trie, samples: int = SAMPLES):
        self.k, self.trie = samples, vocabulary if isinstance(vocabulary, Trie) else Trie(vocabulary)
        self.lattice = Lattice(self.trie)

    def draw(self, keys: list[str], texts: list[str]) -> list[list[Sample]]:
        """Up to k distinct segmentations of each text; fewer only where the text has fewer. An empty text has one, without pieces."""
        lat = self.lattice
        parts = [cut(t) for t in texts]
        codes, lengths = lat.add(parts), np.array([len(x) for x in parts], np.int64)
        ends = np.cumsum(lengths)
        begin = ends - lengths
        row = np.repeat(np.arange(len(texts)), lengths)
        seeds = np.array([xxh64_intdigest(k.encode(), SEED) for k in keys], np.uint64)
        base = place_of(seeds[row], np.arange(len(codes)) - begin[row])
        last = lat.last[codes]
        said = [b" " + t.encode() if t else b"" for t in texts]
        out: list[list[Sample]] = [[] for _ in texts]
        heaps: list[list] = [[] for _ in texts]
        for i in np.flatnonzero(lengths == 0):
            out[i].append(Sample(np.zeros(0, np.int32), 0.0, 0.0, 1.0))
        # the first sample of every row is drawn freely; its Gumbel is that of the whole space, log mass 0
        live = np.flatnonzero(lengths > 0)
        top = uniform(place_of(seeds[live], np.full(len(live), 1 << 40)), 0, 0)
        top = -np.log(-np.log(np.clip(top, 1e-300, 1 - 1e-16)))
        pending: list[tuple[int, Open | None, float]] = [(i, None, g) for i, g in zip(live.tolist(), top.tolist())]
        for m in range(1, self.k + 1):
            if not pending:
                break
            state = last.copy() if m == 1 else np.full(len(codes), -1, np.int64)
            firsts = []
            rows = np.array([i for i, *_ in pending])
            steps = np.array([(1 << 41) + (node.step if node else 0) for _, node, _ in pending])
            own = uniform(place_of(seeds[rows], steps), m, 0).tolist()
            for (i, node, _), u in zip(pending, own) if m > 1 else ():
                token = int(node.tokens[node.step])
                options, w = lat.others(node.state, node.taken)
                w = np.cumsum(w)
                e = options[min(int(np.searchsorted(w, u * w[-1], "right")), len(options) - 1)]
                firsts.append(e)
                state[token] = lat.prev[e]
                state[token + 1 : ends[i]] = last[token + 1 : ends[i]]
            edges, tokens = lat.finish(state, base, m)
            if m == 1:
                size = np.searchsorted(tokens, ends[live]) - np.searchsorted(tokens, begin[live])
            else:
                lo, hi = np.searchsorted(tokens, begin[rows]).tolist(), np.searchsorted(tokens, ends[rows]).tolist()
                put, got = [], []
                for (_, node, _), e, a, b in zip(pending, firsts, lo, hi):
                    put += [node.path[: node.step], [e], edges[a:b]]
                    got += [node.tokens[: node.step + 1], tokens[a:b]]
                size = np.array([node.step + 1 + b - a for (_, node, _), a, b in zip(pending, lo, hi)])
                edges, tokens = np.concatenate(put), np.concatenate(got)
            at = np.cumsum(size) - size
            self._emit(out, pending, edges, tokens, at, said)
            kappa = self._split(heaps, pending, edges, tokens, at, size, last, seeds, m)
            if m == self.k:
                # the greatest score left is the threshold of Gumbel top-k
                for (i, *_), left in zip(pending, kappa.tolist()):
                    left = max(left, -heaps[i][0][0]) if heaps[i] else left
                    if left > -np.inf:
                        for s in out[i]:
                            s.inclusion = -expm1(-exp(min(max(s.mass - left, -700.0), 700.0)))
                break
            after = []
            for i, *_ in pending:
                if heaps[i]:
                    g, _, _, node = heapq.heappop(heaps[i])
                    after.append((i, node, -g))
            pending = after
        return out

    def _emit(self, out, pending, edges, tokens, at, said) -> None:
        """A sample a row of the paths that lie one after the other, each from `at`."""
        lat = self.lattice
        logp = np.add.reduceat(lat.logp[edges].astype(float), at)
        mass = np.add.reduceat(np.log(lat.q[edges]), at)
        # steps run from a word's end to its start: words in order, each word's steps reversed
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        size = np.diff(np.append(first, len(edges)))
        ids = lat.ids[edges[np.repeat(2 * first + size - 1, size) - np.arange(len(edges))]]
        ids, start = self._bytes_for_points(ids, at)
        length = self.trie.length[ids]
        end = np.cumsum(length, dtype=np.int32)
        where = np.repeat(self.trie.start[ids] - (end - length), length)
        where += np.arange(len(where), dtype=np.int32)
        got = self.trie.bytes[where]
        bounds = [*start.tolist(), len(ids)]
        cuts = [0, *(int(end[b - 1]) for b in bounds[1:])]
        whole = memoryview(got.tobytes())
        for n, (i, _, g) in enumerate(pending):
            same = whole[cuts[n] : cuts[n + 1]] == said[i]
            out[i].append(Sample(ids[bounds[n] : bounds[n + 1]], float(logp[n]), g, 1.0, float(mass[n]), same))

    def _bytes_for_points(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with the byte pieces of characters in place of minus their code points; and where each row now begins."""
        far = np.flatnonzero(ids < 0)
        if not len(far):
            return ids, at
        points, which = np.unique(-ids[far], return_inverse=True)
        forms = [[int(self.trie.byte_ids[b]) for b in bytes_of(chr(p))] for p in points.tolist()]
        n_bytes = np.array([len(f) for f in forms])
        count = np.ones(len(ids), np.int64)
        count[far] = n_bytes[which]
        start = np.cumsum(count) - count
        out = np.repeat(ids, count)
        for b in range(int(n_bytes.max())):
            on = np.flatnonzero(n_bytes[which] > b)
            out[start[far[on]] + b] = np.array([f[min(b, len(f) - 1)] for f in forms], np.int32)[which[on]]
        return out, start[at]

    def _split(self, heaps, pending, edges, tokens, at, size, last, seeds, m) -> np.ndarray:
        """Puts the sets of paths that leave each row's path at each step on its heap, as many of them as can ever be opened; returns the greatest Gumbels.

        Masses fall along a path and no Gumbel lies FARTHEST above its location, so once the mass is that far below the last of the
        sets wanted so far, later steps cannot matter: nothing is lost by stopping there.
        """
        lat, need = self.lattice, self.k - m + 1
        best = np.full(len(pending), -np.inf)
        for lo in range(0, len(pending), SLAB):
            rows = pending[lo : lo + SLAB]
            step0 = np.array([0 if node is None else node.step for _, node, _ in rows])
            before = np.array([0.0 if node is None else node.before for _, node, _ in rows])
            bound = np.array([g for *_, g in rows])
            own = seeds[[i for i, *_ in rows]]
            here, n = at[lo : lo + SLAB], size[lo : lo + SLAB]
            top, step, pre = np.full((len(rows), need), -np.inf), np.zeros((len(rows), need), np.int64), np.zeros((len(rows), need))
            on, begun = np.arange(len(rows)), step0.copy()
            while len(on):
                width = int(min(WIDTH, (n[on] - begun[on]).max()))
                s = begun[on][:, None] + np.arange(width)
                inside = s < n[on][:, None]
                e = edges[here[on][:, None] + np.minimum(s, n[on][:, None] - 1)]
                q = np.where(inside, lat.q[e], 1.0)
                rest = np.where(inside, lat.rest[e], 0.0)
                for j in np.flatnonzero(begun[on] == step0[on]).tolist() if m > 1 else ():
                    node = rows[on[j]][1]
                    rest[j, 0] = lat.others(node.state, node.taken | {int(e[j, 0])})[1].sum()
                run = np.cumprod(q, axis=1)
                shared = np.concatenate([np.ones((len(on), 1)), run[:, :-1]], 1)
                # of exponentials over masses the least are the greatest Gumbels: only of these the logarithms are needed
                with np.errstate(divide="ignore"):
                    late = -np.log1p(-np.maximum(uniform(place_of(own[on][:, None], s), m + 64, 1), 2.0**-54)) / (shared * rest)
                    w = min(need, width)
                    pick = np.argpartition(late, w - 1, axis=1)[:, :w] if w < width else np.arange(width)[None].repeat(len(on), 0)
                    late, s, shared = (np.take_along_axis(x, pick, 1) for x in (late, s, shared))
                    gum = -np.logaddexp(-bound[on][:, None], np.log(late) - before[on][:, None])
                    masses = np.log(shared) + before[on][:, None]
                gum, s, masses = np.concatenate([top[on], gum], 1), np.concatenate([step[on], s], 1), np.concatenate([pre[on], masses], 1)
                pick = np.argsort(-gum, axis=1, kind="stable")[:, :need]
                top[on], step[on], pre[on] = (np.take_along_axis(x, pick, 1) for x in (gum, s, masses))
                with np.errstate(divide="ignore"):
                    before[on] += np.log(run[:, -1])
                begun[on] += width
                on = on[(begun[on] < n[on]) & (before[on] + FARTHEST >= top[on, -1])]
            best[lo : lo + SLAB] = top[:, 0]
            if need == 1:
                continue
            for j, (i, node, _) in enumerate(rows):
                path, toks = edges[here[j] : here[j] + n[j]], tokens[here[j] : here[j] + n[j]]
                for g, s, b in zip(top[j].tolist(), step[j].tolist(), pre[j].tolist()):
                    if g > -np.inf:
                        state = int(lat.prev[path[s - 1]]) if s and toks[s - 1] == toks[s] else int(last[toks[s]])
                        taken = frozenset([int(path[s]), *(node.taken if node and s == node.step else ())])
                        heapq.heappush(heaps[i], (-g, m, s, Open(path, toks, s, state, taken, b)))
        return best


def encode(text: str, v: Vocabulary) -> list[int]:
    """The most probable segmentation."""
    best: list[int] = []
    for w in words(prepare(text)):
        n = len(w)
        score, back = [0.0] + [-1e300] * n, [(0, 0)] * (n + 1)
        for t in range(1, n + 1):
            for s in range(t - 1, max(-1, t - v.longest - 1), -1):
                lp = v.logp.get(w[s:t])
                if lp is not None and score[s] + lp > score[t]:
                    score[t], back[t] = score[s] + lp, (s, v.ids[w[s:t]])
            if w[t - 1] not in v.ids and score[t - 1] + BYTE_LOGP > score[t]:
                point = ord(w[t - 1])
                score[t], back[t] = score[t - 1] + BYTE_LOGP, (t - 1, v.byte_ids[point] if point < 128 else -point)
        t, part = n, []
        while t:
            t, i = back[t]
            part.append(i)
        for i in reversed(part):
            best += [i] if i >= 0 else [v.byte_ids[b] for b in bytes_of(chr(-i))]
    return best


def decode(ids, v: Vocabulary) -> str:
    """The text of any segmentation of it."""
    said = [v.surface[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]
    if None not in said:
        return "".join(said).replace(SPACE, " ")[1:]
    byte = {i: b for b, i in enumerate(v.byte_ids)}
    out = b"".join(bytes([byte[i]]) if x is None else x.replace(SPACE, " ").encode() for i, x in zip(ids, said))
    return out.decode(errors="replace")[1:]


def chunks(lengths: list[int], most: int = 1 << 17):
    """Runs of rows with about `most` characters."""
    lo = size = 0
    for i, n in enumerate(lengths):
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(lengths):
        yield lo, len(lengths)


def segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """(doc_id, samples array<struct<ids, n_pieces, ids_sha256, logp, mass, score, inclusion, round_trip>>) of every row; ids are null without with_ids.

    Whole texts are segmented; samples are distinct and in falling order of score; decoding each gives the text again
    (round_trip). Null texts count as empty and have one sample without pieces. Rows are seeded by their id as text: repeated rows
    get equal samples. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Trie(load(model)))  # some 15 MB, whatever the input
    item = pa.struct([("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("logp", pa.float64()), ("mass", pa.float64()), ("score", pa.float64()), ("inclusion", pa.float64()), ("round_trip", pa.bool_())])

    def run(batches):
        sampler = Sampler(shared.value, samples)
        for b in batches:
            # a chunk at a time: no second copy of a whole batch
            for lo, hi in chunks(pc.fill_null(pc.utf8_length(b.column(2)), 0).to_pylist()):
                keys = [k or "" for k in b.column(1).slice(lo, hi - lo).to_pylist()]
                got = sampler.draw(keys, [t or "" for t in b.column(2).slice(lo, hi - lo).to_pylist()])
                flat = [s for x in got for s in x]
                if with_ids and flat:
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s.ids) for s in flat])]), pa.int32()), pa.array(np.concatenate([s.ids for s in flat]).astype(np.int32)))
                else:
                    ids = pa.nulls(len(flat), pa.list_(pa.int32()))
                cols = [ids, pa.array([len(s.ids) for s in flat], pa.int64()), pa.array([ids_digest(s.ids) for s in flat], pa.string())]
                cols += [*(pa.array([getattr(s, f) for s in flat], pa.float64()) for f in ("logp", "mass", "score", "inclusion")), pa.array([s.round_trip for s in flat], pa.bool_())]
                values = pa.StructArray.from_arrays(cols, fields=list(item))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in got])]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "samples"])
                del keys, got, flat, ids, cols, values, offsets
            del b  # not kept while the next one is read
        del sampler
        give_back()

    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()), *(T.StructField(f, T.DoubleType()) for f in ("logp", "mass", "score", "inclusion")), T.StructField("round_trip", T.BooleanType())])
    return spread(rows).mapInArrow(run, T.StructType([field(rows, "doc_id"), T.StructField("samples", T.ArrayType(kind))]))


def ids_digest(ids) -> str:
    """SHA-256 of the ids as little-endian 32-bit numbers."""
    return sha256(np.asarray(ids, "<i4").tobytes()).hexdigest()


def digest_rows(found: DataFrame) -> DataFrame:
    """One row a sample: doc_id, rank, n_pieces, logp, score, inclusion, round_trip, ids_sha256."""
    one = found.select("doc_id", F.posexplode("samples").alias("at", "s"))
    return one.select("doc_id", (F.col("at") + 1).alias("rank"), *[f"s.{c}" for c in ("n_pieces", "logp", "score", "inclusion", "round_trip", "ids_sha256")])
