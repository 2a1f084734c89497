"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic unit over cheap text statistics gives each document's evidence. Grouped aggregation then gives
hosts and paths their posteriors: a host's mean is shrunk towards the global one, a path's towards its
host's, the more the fewer documents it has; how much is estimated from the spread between sites. The
document's own evidence and its path's posterior odds are added.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlake.llm.common import BROADCAST_ROWS, byte_chunks, checkpointed, fresh_name, labelled_sample, sigmoid, spread

#: Rows learned from, about so many of each label; longer texts (bytes) are left out of the sample.
PER_CLASS, MAX_BYTES = 1500, 1 << 16
#: Documents whose final probability of good quality is below this are rejected.
THRESHOLD = 0.5
P = "__quality_evidence"

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "high": range(128, 256), "digit": range(48, 58), "space": (32, 9, 11, 12, 13), "line": (10,), "stop": b".,;:?'\"-()", "bang": b"!", "bar": b"|"}
_BYTE_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _members in enumerate(_CLASSES.values()):
    _BYTE_CLASS[list(_members)] = _i
N_FEATURES = 12


def features(texts: pa.Array) -> np.ndarray:
    """One row of N_FEATURES numbers a text; whole texts are counted. Null counts as empty."""
    out = np.zeros((len(texts), N_FEATURES))
    k = len(_CLASSES) + 1
    for lo, n, data, offsets in byte_chunks(texts):
        owner = np.repeat(np.arange(n), np.diff(offsets))
        c = np.bincount(owner * k + _BYTE_CLASS[data], minlength=n * k).reshape(n, k).astype(float)
        raw = data.tobytes()
        w = np.zeros((n, 4))
        for i in range(n):
            words = raw[offsets[i] : offsets[i + 1]].split()
            if words:
                w[i] = len(words), len(set(words)), sum(map(eq, words, words[1:])), words[-1].endswith(b".")
        n_words, total = np.maximum(w[:, 0], 1), np.maximum(c.sum(1), 1)
        upper, lower, high, digit, _, line, stop, bang, bar, symbol = c.T
        letters = np.maximum(upper + lower + high, 1)
        out[lo : lo + n] = np.stack(
            [
                np.log1p(w[:, 0]),
                upper / letters,
                symbol / total,
                bar / n_words,
                bang / n_words,
                digit / total,
                w[:, 1] / n_words,
                w[:, 2] / n_words,
                np.minimum(letters / n_words, 40) / 10,
                line / n_words,
                stop / n_words,
                w[:, 3],
            ],
            1,
        )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, then the constant

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1])


def train(rows: list[tuple[str, int]], counts: dict) -> Model:
    """A logistic unit of (text, label) rows, weighted to the labels' own frequencies. Without two labels: the constant that they suggest."""
    y = np.array([float(v > 0) for _, v in rows])
    if not rows or y.min() == y.max():
        start = 3.0 if not rows or y[0] else -3.0
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.array([0.0] * N_FEATURES + [start]))
    x = features(pa.array([t for t, _ in rows], pa.string()))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], 1)
    share = sum(n for v, n in counts.items() if v > 0) / max(1, sum(counts.values()))
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w)) * 1.0
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    return train(*labelled_sample(docs, labels, label, per_class, MAX_BYTES, learn, id_col, text_col))


def evidence(docs: DataFrame, model: Model, text_col: str = "text", name: str = P) -> DataFrame:
    """docs with one more column, `name`: the document classifier's probability of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred bytes
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            p = shared.value.probability(features(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, name])

    return spread(docs).mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), T.StructField(name, T.DoubleType())]))


def _strength(groups: DataFrame, mean: Column, n: str = "n") -> Column:
    """How many documents the prior of a level counts for: variance within groups over variance between them, by moments.

    groups: n, s, ss (count, sum and sum of squares of evidence) of each group, and `mean`, what it is shrunk to.
    """
    m = F.col("s") / F.col(n)
    within = F.sum(F.col("ss") - F.col("s") * m) / F.greatest(F.sum(n) - F.count("*"), F.lit(1))
    spread = F.sum(F.col(n) * (m - mean) * (m - mean))
    between = (spread - (F.count("*") - 1) * within) / F.greatest(F.sum(n) - F.sum(F.col(n) * F.col(n)) / F.sum(n), F.lit(1e-9))
    return F.least(F.greatest((within + F.lit(1e-6)) / F.greatest(between, F.lit(1e-9)), F.lit(1.0)), F.lit(1e6))


def sites(scored: DataFrame) -> DataFrame:
    """(host, path, n, global_mean, host_post, path_post) of every site; scored has host, path and P.

    Groups are summed in each task before anything is shuffled, so a host with a third of all rows is one row a task.
    """
    paths = checkpointed(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(P).alias("s"), F.sum(F.col(P) * F.col(P)).alias("ss")))
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    mean = (paths.agg(F.sum("s") / F.sum("n")).first()[0]) or 0.5
    k_host = hosts.agg(_strength(hosts, F.lit(mean)).alias("k")).first()["k"] or 1.0
    hosts = hosts.select("host", ((F.col("s") + F.lit(k_host * mean)) / (F.col("n") + F.lit(k_host))).alias("host_post"))
    on = F.col("p.host").eqNullSafe(F.col("h.host"))
    small = hosts.count() <= BROADCAST_ROWS
    both = paths.alias("p").join((F.broadcast(hosts) if small else hosts).alias("h"), on).select("p.*", "h.host_post")
    k_path = both.agg(_strength(both, F.col("host_post")).alias("k")).first()["k"] or 1.0
    return both.select("host", "path", "n", F.lit(mean).alias("global_mean"), "host_post", ((F.col("s") + F.lit(k_path) * F.col("host_post")) / (F.col("n") + F.lit(k_path))).alias("path_post"))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def score(docs: DataFrame, model: Model, host: Column, path: Column, text_col: str = "text") -> DataFrame:
    """docs with quality_evidence, quality_host, quality_path, quality_score and quality_keep added.

    Texts are read twice (once for the sites, once for the result) and never shuffled; rows are not matched by id,
    so repeated rows, null ids and columns of any name are kept as they are (columns of these five names are replaced).
    Null and empty texts are scored as empty; null hosts and paths make a site of their own; an empty table gives no rows.
    """
    added = {"quality_evidence", "quality_host", "quality_path", "quality_score", "quality_keep"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    h, p, e = (fresh_name(docs, x) for x in ("host", "path", "evidence"))
    named = docs.select(*kept, host.alias(h), path.alias(p))
    slim = docs.select(F.col(f"`{text_col}`").alias("text"), host.alias("host"), path.alias("path"))
    found = checkpointed(sites(evidence(slim, model, "text", P).select("host", "path", P)))
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    d = evidence(named, model, text_col, e)
    out = d.join(found, d[h].eqNullSafe(found["host"]) & d[p].eqNullSafe(found["path"]), "left")
    final = 1 / (1 + F.exp(-(_logit(d[e]) + _logit(found["path_post"]) - _logit(found["global_mean"]))))
    return out.select(
        *[d[f"`{c}`"] for c in docs.columns if c not in added],
        d[e].alias("quality_evidence"),
        found["host_post"].alias("quality_host"),
        found["path_post"].alias("quality_path"),
        final.alias("quality_score"),
        (final >= THRESHOLD).alias("quality_keep"),
    )
