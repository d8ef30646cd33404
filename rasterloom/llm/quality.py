"""Quality classifier as a sparse rule ensemble.

Statistics of each whole text come from one byte histogram and one pass over its words. Boosted shallow trees on a
bounded labelled sample give conjunctive rules (the path to every node); a lasso logistic regression keeps few of
them, and the kept rules are compiled into one Spark column expression, so scoring stays in generated code.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rasterloom.llm.common import column, held_out, small_batches, table

#: Labelled rows that a fit takes at most (those with the smallest hash of their id); 0.5 MB as statistics.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.3, 32, 20
FEATURES = ["log_words", "word_mean", "distinct", "top_share", "repeat_share", "line_distinct", "line_words", "upper", "digit", "space", "stop", "comma", "exclaim", "bar", "symbol", "other_punct", "non_ascii", "control", "title_share", "mark_words"]
SYMBOLS = b"#$%&*+=@^~<>{}[]\\_`"


def statistics(text: str | None) -> list[float]:
    """FEATURES of one whole text; all zero for null and empty texts."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, w = len(data), len(words)
    upper, lower = int(h[65:91].sum()), int(h[97:123].sum())
    digit, wide = int(h[48:58].sum()), int(h[192:].sum())
    stop, comma, exclaim, bar = int(h[46]), int(h[44] + h[59] + h[58]), int(h[33] + h[63]), int(h[124])
    symbol = int(h[list(SYMBOLS)].sum())
    punct = int(h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum())
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeat = sum(map(bytes.__eq__, words, words[1:]))
    marks = sum(x[-1] in b"!$%&#*|" for x in words)
    titles = sum(65 <= x[0] <= 90 for x in words)
    return [float(np.log1p(w)), (n - int(h[32] + h[9:14].sum())) / w, len(counts) / w, max(counts.values()) / w, repeat / w, len(set(lines)) / max(1, len(lines)), float(np.log1p(w / max(1, len(lines)))), upper / max(1, upper + lower), digit / n, int(h[32]) / n, stop / w, comma / w, exclaim / w, bar / w, symbol / w, (punct - stop - comma - exclaim - bar - symbol) / w, wide / n, int(h[:9].sum() + h[14:32].sum() + h[127]) / n, titles / w, marks / w]


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "q__") -> DataFrame:
    """docs' rows with one double column for each statistic; the text is read whole and kept."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column(at).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in x.T)], [*names, *(prefix + f for f in FEATURES)])

    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, StructType([*docs.schema, *(StructField(prefix + f, DoubleType()) for f in FEATURES)]))


def grow(x: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: list, step: np.ndarray) -> None:
    """One regression tree on gradients; every node but the root adds its path to rules."""
    if path:
        rules.append(path)
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * LEAST:
        base = g * g / (h + 1)
        for f in range(x.shape[1]):
            b = binned[rows, f]
            size = len(edges[f]) + 1
            if size < 2:
                continue
            cg, ch, cn = (np.cumsum(np.bincount(b, v, size))[:-1] for v in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = np.where((cn >= LEAST) & (len(rows) - cn >= LEAST), cg**2 / (ch + 1) + (g - cg) ** 2 / (h - ch + 1) - base, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
    if best[1] is None:
        step[rows] = g / (h + 1)
        return
    _, f, k = best
    low = binned[rows, f] <= k
    cut = float(edges[f][k])
    grow(x, edges, binned, grad, hess, rows[low], depth - 1, (*path, (f, "<=", cut)), rules, step)
    grow(x, edges, binned, grad, hess, rows[~low], depth - 1, (*path, (f, ">", cut)), rules, step)


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, op, cut in rule:
        out &= x[:, f] <= cut if op == "<=" else x[:, f] > cut
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic weights (first: intercept, unpenalised) by accelerated proximal gradient."""
    a = np.c_[np.ones(len(z)), z]
    rate = 4 * len(a) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w, v, t = start.copy(), start.copy(), 1.0
    for _ in range(rounds):
        g = a.T @ (sigmoid(a @ v) - y) / len(a)
        new = v - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-6:
            return new
        w, t = new, t2
    return w


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[tuple, float]]]:
    """(intercept, [(rule, weight)]). One class or no rows: an intercept alone."""
    base = float(np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5))) if len(y) else 0.0
    if len(y) < 4 * LEAST or y.min() == y.max():
        return base, []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    rng, margin, rules = np.random.default_rng(0), np.full(len(y), base), []
    for _ in range(TREES):
        p = sigmoid(margin)
        rows, step = np.flatnonzero(rng.random(len(y)) < 0.7), np.zeros(len(y))
        grow(x, edges, binned, y - p, p * (1 - p), rows, DEPTH, (), rules, step)
        margin += RATE * step
    rules = list(dict.fromkeys(tuple(sorted(r)) for r in rules))
    cover = np.stack([holds(r, x) for r in rules], 1)
    _, first = np.unique(np.packbits(cover, axis=0), axis=1, return_index=True)
    rules, cover = [rules[i] for i in sorted(first)], cover[:, sorted(first)]
    share = cover.mean(0)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-6))
    z = (cover - share) / spread
    check = rng.random(len(y)) < 0.25
    best, w = (np.inf, None), np.r_[base, np.zeros(z.shape[1])]
    top = np.abs(z.T @ (y - y.mean())).max() / len(y)
    for penalty in top * np.geomspace(0.3, 0.003, 8):
        w = lasso(z[~check], y[~check], penalty, w)
        p = sigmoid(w[0] + z[check] @ w[1:]).clip(1e-6, 1 - 1e-6)
        loss = -float(np.mean(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)))
        if loss < best[0] - 1e-4:
            best = (loss, penalty)
    w = lasso(z, y, best[1], np.r_[base, np.zeros(z.shape[1])], 600)
    weights = w[1:] / spread
    return float(w[0] - weights @ share), [(r, float(v)) for r, v in zip(rules, weights) if abs(v) > 1e-9]


def compile_rules(model: tuple[float, list], prefix: str = "q__") -> Column:
    """The ensemble's score in [0, 1] as a column expression over the statistics."""
    z = F.lit(model[0])
    for rule, weight in model[1]:
        test = F.lit(True)
        for f, op, cut in rule:
            c = F.col(prefix + FEATURES[f])
            test = test & (c <= cut if op == "<=" else c > cut)
        z = z + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[float, list]:
    """A model from the labelled rows that are not held out, at most `sample` of them, repeated ids included. Only statistics reach the driver."""
    marked = labels.where(F.col(label_col).isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").alias("id__"), F.col(label_col).cast("double").alias("y__"))
    some = marked.orderBy(F.xxhash64("id__"), "id__", "y__").limit(sample)
    rows = with_statistics(docs.select(F.col(id_col).alias("id__"), F.col(text_col).alias("text")).join(F.broadcast(some), "id__").select("id__", "y__", "text"))
    values = rows.select("y__", *(f"q__{f}" for f in FEATURES), F.xxhash64("id__").alias("h__"))
    got = values.orderBy("h__", *values.columns[:-1]).limit(sample).drop("h__").toPandas().to_numpy(np.float64)
    got = got[np.lexsort(got.T[::-1])]
    return fit(got[:, 1:], (got[:, 0] > 0.5).astype(float))


def score(docs: DataFrame, model: tuple[float, list], text_col: str = "text", prefix: str = "q__") -> DataFrame:
    """docs with score and the statistics columns; columns of docs by these names are replaced.

    Texts are read whole however long they are; null and empty ones score by the rules that hold at zero. Repeated
    rows stay; an empty table gives an empty result.
    """
    own = [prefix + f for f in FEATURES]
    kept = docs.select(*[column(c) for c in docs.columns if c.lower() not in {n.lower() for n in own}])
    return with_statistics(kept, text_col, prefix).withColumn("score", compile_rules(model, prefix))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows (own columns, whatever their names) that score at least threshold."""
    prefix = "q__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    kept = with_statistics(docs, text_col, prefix).where(compile_rules(train(docs, labels, id_col, text_col), prefix) >= threshold)
    return kept.select(*[column(c) for c in docs.columns])


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
