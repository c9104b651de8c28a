"""Linear-chain conditional random field: training on bounded samples, decoding in Arrow batches, models as Parquet.

Training is plain stochastic gradient descent with a decaying rate, L2 penalty, optional dropout and early stopping. A
larger corpus is trained in distributed mini-batches: partitions send gradient sums, the driver holds the weights only.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.features import Extractor

FORBIDDEN = -1e9


def log_sum_exp(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    out = top + np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True))
    return np.squeeze(out, axis=axis) if axis is not None else out.item()


@dataclass
class Model:
    """`weights`: feature to one weight a label; `transition[a, b]`: from label a to b."""

    labels: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    transition: np.ndarray | None = None
    config: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        n = len(self.labels)
        if self.transition is None:
            self.transition = np.zeros((n, n))
            for b, lb in enumerate(self.labels):
                if lb[:2] in ("I-", "E-"):
                    for a, la in enumerate(self.labels):
                        if la[2:] != lb[2:] or la[:2] in ("S-", "E-") or la == "O":
                            self.transition[a, b] = FORBIDDEN
        self.start = np.array([FORBIDDEN if x[:2] in ("I-", "E-") else 0.0 for x in self.labels])

    def emissions(self, feats: list[dict[str, float]]) -> np.ndarray:
        out = np.zeros((len(feats), len(self.labels)))
        for i, f in enumerate(feats):
            for name, value in f.items():
                w = self.weights.get(name)
                if w is not None and value:
                    out[i] += w * value
        return out

    def viterbi(self, em: np.ndarray) -> list[int]:
        score = em[0] + self.start
        back = []
        for row in em[1:]:
            through = score[:, None] + self.transition
            back.append(through.argmax(axis=0))
            score = through.max(axis=0) + row
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def forward_backward(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        n, m = em.shape
        alpha, beta = np.empty((n, m)), np.zeros((n, m))
        alpha[0] = em[0] + self.start
        for i in range(1, n):
            alpha[i] = log_sum_exp(alpha[i - 1][:, None] + self.transition, axis=0) + em[i]
        for i in range(n - 2, -1, -1):
            beta[i] = log_sum_exp(self.transition + (em[i + 1] + beta[i + 1])[None, :], axis=1)
        return alpha, beta, float(log_sum_exp(alpha[-1]))

    def marginals(self, em: np.ndarray) -> np.ndarray:
        alpha, beta, z = self.forward_backward(em)
        return np.exp(alpha + beta - z)

    def predict(self, feats: list[dict[str, float]], confidence: bool = True) -> tuple[list[str], list[float]]:
        """Labels and their marginal probabilities; emissions are computed once for both."""
        if not feats:
            return [], []
        em = self.emissions(feats)
        path = self.viterbi(em)
        p = self.marginals(em)[range(len(path)), path].tolist() if confidence else [1.0] * len(path)
        return [self.labels[k] for k in path], p

    def prune(self, least: float) -> Model:
        """Without weights of small magnitude; features left without any go."""
        kept = {k: np.where(np.abs(w) >= least, w, 0.0) for k, w in self.weights.items()}
        return Model(self.labels, {k: w for k, w in kept.items() if w.any()}, self.transition, self.config)


def gradient(model: Model, feats: list[dict[str, float]], gold: list[int]) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradient of a sentence's log-likelihood for weights and transitions, and the likelihood."""
    em = model.emissions(feats)
    alpha, beta, z = model.forward_backward(em)
    p = np.exp(alpha + beta - z)
    g: dict[str, np.ndarray] = {}
    for i, f in enumerate(feats):
        d = -p[i]
        d = d.copy()
        d[gold[i]] += 1
        for name, value in f.items():
            if value:
                g[name] = g[name] + d * value if name in g else d * value
    t = np.zeros_like(model.transition)
    score = em[0][gold[0]] + model.start[gold[0]]
    for i in range(1, len(feats)):
        t[gold[i - 1], gold[i]] += 1
        t -= np.exp(alpha[i - 1][:, None] + model.transition + (em[i] + beta[i])[None, :] - z)
        score += model.transition[gold[i - 1], gold[i]] + em[i][gold[i]]
    return g, np.where(model.transition <= FORBIDDEN / 2, 0.0, t), score - z


Sentence = tuple[list[str], list[str]]


def train(train_: list[Sentence], dev: list[Sentence], extractor: Extractor, epochs: int = 8, rate: float = 0.1, decay: float = 0.9, l2: float = 1e-4, dropout: float = 0.0, patience: int = 3, seed: int = 12345, min_count: int = 1) -> Model:
    """A model from (words, tags) sentences; the epoch with the best F1 on `dev` counts."""
    labels = sorted({t for _, ts in train_ for t in ts} | {"O"})
    number = {x: k for k, x in enumerate(labels)}
    data = [(extractor.sentence(ws), [number[t] for t in ts]) for ws, ts in train_ if ws]
    if min_count > 1:
        seen: dict[str, int] = defaultdict(int)
        for fs, _ in data:
            for f in fs:
                for name in f:
                    seen[name] += 1
        data = [([{k: v for k, v in f.items() if seen[k] >= min_count} for f in fs], ys) for fs, ys in data]
    model = Model(labels, config={"lang": extractor.lang, "window": extractor.window, "schema": extractor.schema, "gazetteers": sorted(extractor.gazetteers)})
    rng = np.random.default_rng(seed)
    best, best_f1, waited = model, -1.0, 0
    for epoch in range(epochs):
        step = rate * decay**epoch
        for k in rng.permutation(len(data)):
            fs, ys = data[k]
            if dropout:
                fs = [{n: v / (1 - dropout) for n, v in f.items() if rng.random() >= dropout} for f in fs]
            g, t, _ = gradient(model, fs, ys)
            for name, d in g.items():
                w = model.weights.get(name)
                model.weights[name] = step * d if w is None else w + step * (d - l2 * w)
            model.transition = model.transition + step * t
        f1 = token_f1(model, dev, extractor) if dev else float(epoch)
        if f1 > best_f1:
            best_f1, waited = f1, 0
            best = Model(labels, {n: w.copy() for n, w in model.weights.items()}, model.transition.copy(), model.config)
        else:
            waited += 1
            if waited >= patience:
                break
    best.config["dev_f1"] = round(best_f1, 4)
    return best


def train_distributed(sentences: DataFrame, extractor: Extractor, labels: list[str], epochs: int = 10, rate: float = 1.0, l2: float = 1e-4) -> Model:
    """Full-batch training over a DataFrame (words, tags): partitions sum gradients, the sums are added by feature.

    Only the summed gradient of each feature comes to the driver, whose size is the model's.
    """
    spark = sentences.sparkSession
    model = Model(labels)
    number = {x: k for k, x in enumerate(labels)}
    n = sentences.count()
    out_type = T.StructType([T.StructField("feature", T.StringType()), T.StructField("g", T.ArrayType(T.DoubleType()))])
    for _ in range(epochs if n else 0):
        shared = spark.sparkContext.broadcast(model)

        def sums(batches):
            m, total = shared.value, {}
            trans = np.zeros_like(m.transition)
            for batch in batches:
                for ws, ts in zip(batch["words"], batch["tags"]):
                    if len(ws):
                        g, t, _ = gradient(m, extractor.sentence(list(ws)), [number[x] for x in ts])
                        trans += t
                        for k, v in g.items():
                            total[k] = total[k] + v if k in total else v
            rows = [(k, v.tolist()) for k, v in total.items()] + [("\0transition", trans.ravel().tolist())]
            yield pd.DataFrame(rows, columns=["feature", "g"])

        parts = sentences.select("words", "tags").mapInPandas(sums, out_type)
        added = parts.select("feature", F.posexplode("g").alias("i", "v")).groupBy("feature", "i").agg(F.sum("v").alias("v")).groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("g"))
        weights, transition = dict(model.weights), model.transition
        for r in added.toLocalIterator():
            v = np.array([x["v"] for x in r["g"]]) / n
            if r["feature"] == "\0transition":
                transition = transition + rate * v.reshape(transition.shape)
            else:
                w = weights.get(r["feature"], np.zeros(len(labels)))
                weights[r["feature"]] = w + rate * (v - l2 * w)
        model = Model(labels, weights, transition)
        shared.unpersist()
    return model


def spans_of(tags: list[str]) -> set[tuple[str, int, int]]:
    out, start, kind = set(), None, ""
    for i, t in enumerate([*tags, "O"]):
        if start is not None and not (t[:2] in ("I-", "E-") and t[2:] == kind):
            out.add((kind, start, i))
            start = None
        if t[:2] in ("B-", "S-") or (t[:2] in ("I-", "E-") and start is None):
            start, kind = i, t[2:]
    return out


def token_f1(model: Model, data: list[Sentence], extractor: Extractor) -> float:
    tp = fp = fn = 0
    for ws, ts in data:
        if ws:
            got, gold = spans_of(model.predict(extractor.sentence(ws), False)[0]), spans_of(ts)
            tp, fp, fn = tp + len(got & gold), fp + len(got - gold), fn + len(gold - got)
    return 2 * tp / max(1, 2 * tp + fp + fn)


def config_warnings(model: Model, extractor: Extractor) -> list[str]:
    """What of an extractor's settings differs from those of the model's training."""
    now = {"lang": extractor.lang, "window": extractor.window, "schema": extractor.schema, "gazetteers": sorted(extractor.gazetteers)}
    if int(model.config.get("schema", 1)) > 1:
        raise ValueError("the model's feature schema is newer than this library's")
    return [f"{k}: trained with {model.config[k]!r}, now {v!r}" for k, v in now.items() if k in model.config and model.config[k] != v]


_LABELLED = T.StructType([T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("confidence", T.ArrayType(T.DoubleType()))])


def predict(sentences: DataFrame, model: Model, extractor: Extractor, words: str = "words", confidence: bool = True) -> DataFrame:
    """`sentences` with `tags` and `confidence` arrays; the model is broadcast once. Null and empty sentences give empty arrays."""
    shared = sentences.sparkSession.sparkContext.broadcast((model, extractor))

    @F.pandas_udf(_LABELLED)
    def label(ws: pd.Series) -> pd.DataFrame:
        m, ex = shared.value
        rows = [m.predict(ex.sentence([x or "" for x in w]), confidence) if w is not None and len(w) else ([], []) for w in ws]
        return pd.DataFrame({"tags": [t for t, _ in rows], "confidence": [c for _, c in rows]})

    return sentences.withColumn("__p", label(words)).withColumn("tags", F.col("__p.tags")).withColumn("confidence", F.col("__p.confidence")).drop("__p")


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Weights as Parquet (feature, w), labels, transitions and settings as one JSON row."""
    rows = [(k, [float(x) for x in w]) for k, w in model.weights.items()]
    spark.createDataFrame(rows, "feature string, w array<float>").write.mode("overwrite").parquet(f"{path}/weights")
    meta = json.dumps({"labels": model.labels, "transition": model.transition.tolist(), "config": model.config})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Model:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    weights = {r["feature"]: np.array(r["w"]) for r in spark.read.parquet(f"{path}/weights").toLocalIterator()}
    return Model(meta["labels"], weights, np.array(meta["transition"]), meta["config"])


def emission_scores(features: DataFrame, weights: DataFrame, token: list[str]) -> DataFrame:
    """(token, label, score): the relational form of emissions: features joined to weights and summed.

    `features`: token, feature, value. `weights`: feature, label, w. Spark chooses the join from the weights' size.
    """
    return features.join(weights, "feature").groupBy(*token, "label").agg(F.sum(F.col("w") * F.col("value")).alias("score"))


def perplexity(log_likelihood: float, tokens: int) -> float:
    return math.exp(-log_likelihood / max(1, tokens))
