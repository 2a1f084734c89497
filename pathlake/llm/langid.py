"""Language identification by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier a bit says on which side of that bit's split
of the languages a text is. Decoding is loss-weighted: a bit's loss counts for a language as much as that bit's
classifier was right about that language's texts in a part of the sample that it had not learned from. The codeword
with the least weighted loss is chosen; with two losses close to each other the answer is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlake.llm.common import bounded_sample, byte_chunks, field, padded, spread

#: Rows learned from, about so many a language; longer texts (bytes) are left out of the sample.
PER_LANGUAGE, MAX_BYTES = 300, 1 << 16
ORDERS = (3, 4)
SLOTS = 1 << 15
SPACE_ROW, DUMMY = SLOTS, SLOTS + 1
#: Training texts are cut to pieces of so many bytes, so that short texts are learned too.
PIECE = 240
UNKNOWN = "und"


def _fold() -> np.ndarray:
    """Bytes that count: letters in lower case and all of multi-byte characters; the others are spaces."""
    t = np.full(256, 32, np.uint32)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


FOLD = _fold()


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all n-grams of each text and where each text's begin; n-grams of spaces alone and those over a text's end have rows of their own."""
    buf, starts, ends = padded(data, offsets)
    c = FOLD[buf]
    n = len(c)
    tail = np.concatenate([c, np.full(max(ORDERS), 32, np.uint32)])
    out = np.empty((n, len(ORDERS)), np.int32)
    for k, order in enumerate(ORDERS):
        h = np.zeros(n, np.uint32)
        blank = np.ones(n, bool)
        for j in range(order):
            x = tail[j : j + n]
            h = h * np.uint32(0x01000193) ^ x * np.uint32(0x9E3779B1)
            blank &= x == 32
        slot = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(17)).astype(np.int32)
        slot[blank] = SPACE_ROW
        for j in range(1, order):  # windows that would reach into the next text
            at = ends - j
            slot[at[at >= starts]] = DUMMY
        out[:, k] = slot
    return out.reshape(-1), starts * len(ORDERS)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1. Up to 6 classes: all 2^(k-1) - 1 splits; more: random splits, the code with the largest least distance of 50."""
    if k == 1:
        return np.ones((1, 1), np.int8)
    if k <= 6:
        cols = [[1, *(1 if m >> i & 1 else -1 for i in range(k - 1))] for m in range(2 ** (k - 1) - 1)]
        return np.array(cols, np.int8).T
    rng, best, far = np.random.default_rng(7), None, -1
    length = int(10 * np.ceil(np.log2(k)))
    for _ in range(50):
        m = np.where(rng.random((k, length)) < 0.5, -1, 1).astype(np.int8)
        m = m[:, np.abs(m.sum(0)) < k]
        least = min(int((m[i] != m[j]).sum()) for i in range(k) for j in range(i))
        if least > far:
            best, far = m, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # slots x (bits + 1): log odds of each bit, and 1 where the n-gram counts
    scale: np.ndarray  # bits
    shift: np.ndarray
    trust: np.ndarray  # languages x bits: how much a bit's loss counts for a language; rows sum to the number of bits

    def odds(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's calibrated log odds for every bit, drawn to 0 where it has few n-grams."""
        m, n = self.margins(data, offsets)
        return (m * self.scale + self.shift) * (n / (n + 12.0))[:, None]

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's mean log odds for every bit, and how many n-grams it has."""
        slots, starts = grams(data, offsets)
        sums = np.add.reduceat(self.weights[slots], starts, axis=0)
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1), sums[:, -1]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (its number), score and whether a second language is nearly as close."""
        f = self.odds(data, offsets)
        # weighted logistic loss of each codeword, as products: an array of texts x languages x bits would grow with the square of the languages
        loss = np.logaddexp(0, -f) @ (self.trust * (self.code > 0)).T + np.logaddexp(0, f) @ (self.trust * (self.code < 0)).T
        e = np.exp(loss.min(1, keepdims=True) - loss)
        p = e / e.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, axis=1)
        second = top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, p[np.arange(len(p)), best], top[:, -1] < 3 * second


def _pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, owner = [], []
    for i, t in enumerate(texts):
        for lo in range(0, len(t), PIECE):
            parts.append(t[lo : lo + PIECE])
            owner.append(i)
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.array(owner)


def _log_odds(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Slots x (bits + 1): each n-gram's log odds for every bit, from its counts in each language; and 1 where it counts."""
    p = (counts[:, :SLOTS] + 0.5) / (counts[:, :SLOTS].sum(1, keepdims=True) + 0.5 * SLOTS)
    w = np.zeros((SLOTS + 2, code.shape[1] + 1), np.float32)
    w[:SLOTS, -1] = 1
    for b in range(code.shape[1]):
        yes, no = p[code[:, b] > 0], p[code[:, b] < 0]
        if len(yes) and len(no):
            w[:SLOTS, b] = np.log(yes.mean(0)) - np.log(no.mean(0))
    return w


def train(rows: list[tuple[str, str]]) -> Model | None:
    """A model of (text, language) rows; None if there are none.

    Every fifth text of a language is kept from a first set of classifiers. On these texts the bits are calibrated and their
    weights in decoding measured; the classifiers are then learned from all texts. A language with fewer than five texts is
    measured on what it was learned from.
    """
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    code = codewords(len(languages))
    bits = code.shape[1]
    first, all_ = np.zeros((2, len(languages), SLOTS + 2))
    checks = {}
    for i, lang in enumerate(languages):
        texts = [t.encode() for t, x in rows if x == lang]
        late = texts[4::5]
        for counts, some in ((first, [t for k, t in enumerate(texts) if k % 5 != 4]), (all_, texts)):
            data, offsets, _ = _pieces(some)
            if len(offsets) > 1:
                counts[i] = np.bincount(grams(data, offsets)[0], minlength=SLOTS + 2)
        data, offsets, _ = _pieces(late or texts)
        if len(offsets) > 1:
            checks[i] = (data, offsets)
    model = Model(languages, code, _log_odds(first, code), np.ones(bits), np.zeros(bits), np.ones(code.shape))
    x, y = [], []
    for i, (data, offsets) in checks.items():
        m, _ = model.margins(data, offsets)
        x.append(m)
        y.append(np.repeat(code[i][None] > 0, len(m), axis=0))
    if x and len(languages) > 1:
        x, y = np.concatenate(x), np.concatenate(y).astype(float)
        for b in range(bits):  # one logistic unit a bit, by Newton's method
            z = np.stack([x[:, b], np.ones(len(x))], 1)
            v = np.array([1.0, 0.0])
            for _ in range(12):
                q = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
                v += np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (y[:, b] - q) - 1e-2 * v)
            model.scale[b], model.shift[b] = v
        for i, (data, offsets) in checks.items():
            right = ((model.odds(data, offsets) > 0) == (code[i] > 0)).mean(0) + 1e-3  # no bit counts for nothing
            model.trust[i] = right * bits / right.sum()
    model.weights = _log_odds(all_, code)
    return model


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of about per_language rows of each language among those where `learn` holds."""
    rows = docs.filter(learn).select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    return train([(r["text"], r["label"]) for r in bounded_sample(rows, "t", "l", "k", per_language, MAX_BYTES)])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row, from the whole text alone.

    lang_pred is `und` with score 0 where the text is null or has no letter, or where there was nothing to learn
    from. Repeated rows get equal answers; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 1 MB, whatever the input

    def run(batches):
        m = shared.value
        names = np.array([*(m.languages if m else ()), UNKNOWN], dtype=object)
        for b in batches:
            lang = np.full(b.num_rows, len(names) - 1)
            score, unsure = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            for lo, n, data, offsets in byte_chunks(b.column(1)) if m else ():
                ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
                ends = np.concatenate([[0], np.cumsum(ascii_letter)])
                has = ends[offsets[1:]] > ends[offsets[:-1]]
                for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
                    has[i] = any(map(str.isalpha, bytes(data[offsets[i] : offsets[i + 1]]).decode()))
                best, p, close = m.predict(data, offsets)
                lang[lo : lo + n] = np.where(has, best, len(names) - 1)
                score[lo : lo + n] = np.where(has, p, 0)
                unsure[lo : lo + n] = has & close
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[lang], pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    schema = T.StructType([field(rows, "doc_id"), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return spread(rows).mapInArrow(run, schema)
