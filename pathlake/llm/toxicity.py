"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Every word enters as a learned hashed embedding, the mean of its letters' trigram embeddings, and how
much oftener it and its trigrams stand in toxic training documents. Windows of WINDOW words that overlap by
half cover the whole text; a window's state is pooled by attention over both directions, and a document's
score is calibrated from its worst window.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlake.llm.common import byte_chunks, field, labelled_sample, padded, sigmoid, spread

#: Rows learned from, about so many of each label; longer texts (bytes) are left out of the sample.
PER_CLASS, MAX_BYTES = 1500, 1 << 15
WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 6
WORD_SLOTS, CHAR_SLOTS, ODDS_SLOTS = 1 << 14, 1 << 13, 1 << 18
THRESHOLD = 0.7
EDGE = b".,;:!?\"'()[]{}<>*#$%&|-_"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class Words:
    """Numbers for the distinct words of some texts, and what the network is told of each."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def codes(self, words: list[bytes]) -> list[int]:
        get = self.number.setdefault
        return [get(w, len(self.number)) for w in words]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each word; slots of all their trigrams; where each word's trigrams begin."""
        bare = [w.strip(EDGE) or w for w in self.number]
        hashes = np.fromiter(map(zlib.crc32, bare), np.int64, len(bare))
        data = np.frombuffer(b"".join(bare), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, bare), np.int64, len(bare)))])
        buf, starts, ends = padded(data, offsets)
        c = np.concatenate([buf, [32, 32]]).astype(np.uint32)
        h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA6B) + (c[2:] << np.uint32(9)))
        slots = ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(19)).astype(np.int32)
        keep = np.ones(len(slots), bool)
        keep[ends - 1] = keep[ends - 2] = False
        short = np.flatnonzero(ends - starts < 3)
        keep[starts[short]] = True  # cannot happen for words, which have a byte at least
        first = np.concatenate([[0], np.cumsum(keep)])[starts]
        return hashes, slots[keep], first


@dataclass
class Net:
    p: dict[str, np.ndarray]
    word_odds: np.ndarray
    char_odds: np.ndarray
    calibration: np.ndarray  # of the worst window, log of the number of windows, constant

    def inputs(self, w: Words) -> tuple[np.ndarray, tuple]:
        hashes, slots, first = w.tables()
        word = (hashes & (WORD_SLOTS - 1)).astype(np.int64)
        n = np.diff(np.append(first, len(slots)))
        chars = np.add.reduceat(self.p["C"][slots], first, axis=0) / n[:, None]
        odds = np.stack([self.word_odds[hashes & (ODDS_SLOTS - 1)], np.maximum.reduceat(self.char_odds[slots], first), np.add.reduceat(self.char_odds[slots], first) / n], 1)
        x = np.concatenate([self.p["E"][word], chars, odds], 1).astype(np.float32)
        return x, (word, slots, first, n)

    def forward(self, index: np.ndarray, x: np.ndarray, keep: bool = False):
        """Logits of windows; index: windows x WINDOW word numbers, -1 beyond a text's end."""
        p, size = self.p, len(index)
        proj = np.concatenate([x @ p["W"] + p["b"], np.zeros((1, 6 * HIDDEN), np.float32)])
        mask = (index >= 0).astype(np.float32)
        states = np.empty((WINDOW, size, 2 * HIDDEN), np.float32)
        trace = []
        for d in range(2):
            h = np.zeros((size, HIDDEN), np.float32)
            u, cols = p["U"][d], slice(3 * HIDDEN * d, 3 * HIDDEN * (d + 1))
            part = np.ascontiguousarray(proj[:, cols])
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                g = part[index[:, t]]
                a = h @ u
                zr = np.tanh(0.5 * (g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])) * np.float32(0.5) + np.float32(0.5)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                an = a[:, 2 * HIDDEN :]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * an)
                new = c + z * (h - c)
                m = mask[:, t : t + 1]
                if keep:
                    trace.append((d, t, h, z, r, c, an))
                h = h + m * (new - h)
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        att = states @ p["v"]  # WINDOW x windows
        att = np.where(mask.T > 0, att, np.float32(-1e9))
        e = np.exp(att - att.max(0))
        alpha = e / e.sum(0)
        pooled = (alpha[:, :, None] * states).sum(0)
        logit = pooled @ p["o"] + p["c"][0]
        return (logit, (proj, mask, states, trace, alpha, pooled)) if keep else logit

    def gradients(self, index, x, side, y, weight):
        p = self.p
        logit, (proj, mask, states, trace, alpha, pooled) = self.forward(index, x, True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dl = (weight * (sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["o"], g["c"][0] = pooled.T @ dl, dl.sum()
        dpool = dl[:, None] * p["o"]
        dalpha = (states * dpool).sum(2)
        datt = alpha * (dalpha - (alpha * dalpha).sum(0))
        g["v"] = np.einsum("tbh,tb->h", states, datt)
        dstates = alpha[:, :, None] * dpool + datt[:, :, None] * p["v"]
        dproj = np.zeros_like(proj)
        dh = None
        for d, t, h, z, r, c, an in reversed(trace):
            if dh is None or dh[0] != d:
                dh = (d, np.zeros_like(h))
            m = mask[:, t : t + 1]
            total = dh[1] + dstates[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            new = total * m
            dc = new * (1 - z) * (1 - c * c)
            dz = new * (h - c) * z * (1 - z)
            dr = dc * an * r * (1 - r)
            da = np.concatenate([dz, dr, dc * r], 1)
            g["U"][d] += h.T @ da
            np.add.at(dproj[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)], index[:, t], np.concatenate([dz, dr, dc], 1) * (index[:, t] >= 0)[:, None])
            dh = (d, total * (1 - m) + new * z + da @ p["U"][d].T)
        dproj = dproj[:-1]
        g["W"], g["b"] = x.T @ dproj, dproj.sum(0)
        dx = dproj @ p["W"].T
        word, slots, first, n = side
        np.add.at(g["E"], word, dx[:, :WORD_DIM])
        np.add.at(g["C"], slots, np.repeat(dx[:, WORD_DIM : WORD_DIM + CHAR_DIM] / n[:, None], n, axis=0))
        return g

    def document_scores(self, worst: np.ndarray, windows: np.ndarray) -> np.ndarray:
        a, b, c = self.calibration
        return np.clip(sigmoid(a * np.clip(worst, -15, 15) + b * np.log(windows) + c), 1e-4, 1 - 1e-4)


def window_index(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW numbers, windows of each text). Windows begin every STRIDE words until one reaches the end; a text without words has one empty window."""
    count = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(lengths)), count)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    offset = np.cumsum(lengths) - lengths
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < lengths[owner][:, None]
    flat = np.append(codes, -1)
    return np.where(inside, flat[np.where(inside, at + offset[owner][:, None], len(codes))], -1), count


def encode(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    w, codes, lengths = Words(), [], []
    for t in texts:
        c = w.codes(words_of(t))
        codes += c
        lengths.append(len(c))
    w.number.setdefault(b"\x00", len(w.number))  # no table is empty
    return w, np.array(codes, np.int64), np.array(lengths, np.int64)


def worst_windows(net: Net, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    w, codes, lengths = encode(texts)
    index, count = window_index(codes, lengths)
    x, _ = net.inputs(w)
    logits = np.concatenate([net.forward(index[lo : lo + 8192], x) for lo in range(0, len(index), 8192)])
    return np.maximum.reduceat(logits, np.cumsum(count) - count), count


def _odds(hits: np.ndarray, misses: np.ndarray, yes: int, no: int) -> np.ndarray:
    both = hits + misses
    return (np.log((hits + 0.5) / (yes + 1)) - np.log((misses + 0.5) / (no + 1))).astype(np.float32) * (both / (both + 4)).astype(np.float32)


def train(rows: list[tuple[str, int]], counts: dict, epochs: int = 10, seed: int = 11) -> Net | None:
    """A network of (text, label) rows, deterministic; None unless both labels are there.

    Labels are of documents: of a toxic one its worst window so far is learned as toxic, of another its worst window and a
    random one as clean. A fifth of the rows is kept from this and calibrates document scores, at the labels' own frequencies.
    """
    y = np.array([int(v > 0) for _, v in rows])
    if len(rows) < 10 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    texts = [t.encode() for t, _ in rows]
    w, codes, lengths = encode(texts)
    hashes, slots, first = w.tables()
    late = np.arange(len(rows)) % 5 == 4
    use = ~late
    owner = np.repeat(np.arange(len(rows)), lengths)
    pairs = np.unique(owner * len(hashes) + codes)
    pairs = pairs[use[pairs // len(hashes)]]
    doc, word = pairs // len(hashes), pairs % len(hashes)
    yes, no = int(y[use].sum()), int((1 - y[use]).sum())
    seen = np.unique(doc * ODDS_SLOTS + (hashes[word] & (ODDS_SLOTS - 1)))
    hit = np.bincount(seen % ODDS_SLOTS, y[seen // ODDS_SLOTS], ODDS_SLOTS)
    word_odds = _odds(hit, np.bincount(seen % ODDS_SLOTS, minlength=ODDS_SLOTS) - hit, yes, no)
    per_word = [slots[a:b] for a, b in zip(first, np.append(first[1:], len(slots)))]
    hit, all_ = np.zeros(CHAR_SLOTS), np.zeros(CHAR_SLOTS)
    bounds = np.searchsorted(doc, np.arange(len(rows) + 1))
    for i in np.flatnonzero(use):
        if bounds[i] < bounds[i + 1]:
            s = np.unique(np.concatenate([per_word[k] for k in word[bounds[i] : bounds[i + 1]]]))
            all_[s] += 1
            hit[s] += y[i]
    del per_word
    shape = {"E": (WORD_SLOTS, WORD_DIM), "C": (CHAR_SLOTS, CHAR_DIM), "W": (WORD_DIM + CHAR_DIM + 3, 6 * HIDDEN), "b": (6 * HIDDEN,), "U": (2, HIDDEN, 3 * HIDDEN), "v": (2 * HIDDEN,), "o": (2 * HIDDEN,), "c": (1,)}
    scale = {"E": 0.05, "C": 0.05, "W": 0.25, "b": 0.0, "U": 0.3, "v": 0.3, "o": 0.4, "c": 0.0}
    p = {k: (rng.standard_normal(s) * scale[k]).astype(np.float32) for k, s in shape.items()}
    net = Net(p, word_odds, _odds(hit, all_ - hit, yes, no), np.array([1.0, 0.0, 0.0]))
    index, count = window_index(codes, lengths)
    begin = np.cumsum(count) - count
    first_score = np.where(index >= 0, word_odds[hashes & (ODDS_SLOTS - 1)][index], -9).max(1)
    best = first_score
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, names = 0, list(w.number)
    docs = np.flatnonzero(use)
    balance = np.where(y > 0, 0.5 / max(yes, 1), 0.5 / max(no, 1)) * (yes + no)
    for epoch in range(epochs):
        if epoch in (2, 5):
            x, _ = net.inputs(w)
            best = np.concatenate([net.forward(index[lo : lo + 8192], x) for lo in range(0, len(index), 8192)])
        chosen, label, weight = [], [], []
        for i in docs:
            top = begin[i] + int(best[begin[i] : begin[i] + count[i]].argmax())
            chosen.append(top)
            label.append(y[i])
            weight.append(balance[i])
            if not y[i] and count[i] > 1:
                chosen.append(begin[i] + int(rng.integers(count[i])))
                label.append(0)
                weight.append(balance[i] * 0.5)
        order = rng.permutation(len(chosen))
        chosen, label, weight = np.array(chosen)[order], np.array(label, np.float32)[order], np.array(weight, np.float32)[order]
        for lo in range(0, len(order), 256):
            used, ix = np.unique(index[chosen[lo : lo + 256]], return_inverse=True)
            ix = ix.reshape(-1, WINDOW)
            if used[0] < 0:
                used, ix = used[1:], ix - 1
            sub = Words()
            sub.codes([names[k] for k in used] or [b"\x00"])
            x, side = net.inputs(sub)
            g = net.gradients(ix, x, side, label[lo : lo + 256], weight[lo : lo + 256])
            step += 1
            for k in p:
                a, b = m[k]
                a += 0.1 * (g[k] - a)
                b += 0.01 * (g[k] * g[k] - b)
                p[k] -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6) * (1 if epoch < epochs * 0.7 else 0.3)
    # calibration
    check = [t for t, k in zip(texts, late) if k]
    worst, windows = worst_windows(net, check)
    yc = y[late].astype(float)
    share = sum(v for k, v in counts.items() if k > 0) / max(1, sum(counts.values()))
    wt = np.where(yc > 0, share / max(yc.mean(), 1e-9), (1 - share) / max(1 - yc.mean(), 1e-9))
    z = np.stack([np.clip(worst, -15, 15), np.log(windows), np.ones(len(worst))], 1)
    v = np.array([1.0, 0.0, 0.0])
    for _ in range(25):
        q = sigmoid(z @ v)
        v += np.linalg.solve((z * (wt * q * (1 - q))[:, None]).T @ z + 0.5 * np.eye(3), z.T @ (wt * (yc - q)) - 0.5 * v)
    if v[0] > 0:
        net.calibration = v
    return net


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Net | None:
    return train(*labelled_sample(docs, labels, label, per_class, MAX_BYTES, learn, id_col, text_col))


def score(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row, from all windows of the whole text.

    Null and empty texts are scored as one window without words; without a network every score is 0. Repeated
    rows get equal scores; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 2 MB, whatever the input

    def run(batches):
        for b in batches:
            s = np.zeros(b.num_rows)
            if shared.value is not None:
                for lo, n, data, offsets in byte_chunks(b.column(1), 1 << 19):
                    raw = data.tobytes()
                    worst, windows = worst_windows(shared.value, [raw[offsets[i] : offsets[i + 1]] for i in range(n)])
                    s[lo : lo + n] = shared.value.document_scores(worst, windows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return spread(rows).mapInArrow(run, T.StructType([field(rows, "doc_id"), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
