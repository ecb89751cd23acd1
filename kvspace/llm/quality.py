"""Quality classifier: a sparse rule ensemble.

Statistics of whole texts are Spark columns. Small trees fitted on a bounded sample of the
labelled rows give conjunctive rules over these statistics; a lasso logistic regression over
the rules keeps few of them; the rules and weights are compiled into one column expression
that scores every document. The regression runs in the task that holds the sample: as a job for
each of its steps it would leave the driver 8 MB of broadcasts a step.

Null texts count as empty; a text without words has statistics of 0 for its words. Very long
texts are read whole. Labels that are null are left out, of several labels of a document the
largest counts, and of several texts of a labelled doc_id that of least hash. With no label,
or labels of one class, the score is that class's share. Repeated documents are scored one
by one. An empty table gives an empty result; documents keep all their columns, whatever
their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspace.functions.steps import computed_once
from kvspace.llm.store import cut
from kvspace.llm.trees import Rule, rules_of, tree_of

#: Labelled documents that the classifier is fitted on, at most; those of least hash.
MAX_TRAINING = 6000
TREES, DEPTH, LASSO, THRESHOLD = 24, 3, 0.002, 0.3
FOLDS = 5

# Signs that prose rarely has, and capital letters.
_SIGNS = "#*$%&@^~<>{}[]=_+\\"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"
STATISTICS = ("log_chars", "signs", "bangs", "bars", "capitals", "digits", "breaks", "word_length", "variety", "repeats", "same_lines")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the statistics; shares are of characters, words or lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select(*keep, text.alias("_t")).withColumns({"_n": F.char_length("_t"), "_w": F.filter(F.split(F.lower("_t"), "\\s+"), lambda w: w != ""), "_l": F.filter(F.split("_t", "\n"), lambda x: x != "")})
    n = F.greatest(F.col("_n"), F.lit(1)).cast("double")
    words = F.greatest(F.size("_w"), F.lit(1)).cast("double")
    lines = F.greatest(F.size("_l"), F.lit(1)).cast("double")
    share = lambda signs: (F.col("_n") - F.char_length(F.translate("_t", signs, ""))) / n
    made = {
        "log_chars": F.log1p("_n"),
        "signs": share(_SIGNS),
        "bangs": share("!"),
        "bars": share("|"),
        "capitals": share(_CAPITALS),
        "digits": share("0123456789"),
        "breaks": share("\n"),
        "word_length": F.when(F.size("_w") > 0, n / words).otherwise(0.0),
        "variety": F.size(F.array_distinct("_w")) / words,
        "repeats": F.size(F.filter("_w", lambda w, i: w == F.get(F.col("_w"), i + 1))) / words,
        "same_lines": 1 - F.size(F.array_distinct("_l")) / lines,
    }
    return parts.select(*keep, *[made[k].cast("double").alias(k) for k in STATISTICS])


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for f, greater, threshold in rule:
        c = F.col(STATISTICS[f])
        out = out & ((c > threshold) if greater else (c <= threshold))
    return out


@dataclass
class Ensemble:
    """score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING) -> DataFrame:
    """(label, statistics) of at most ``limit`` labelled documents outside the held-out fold.

    The document ids are chosen first, and their bounded list is broadcast to the documents.
    Statistics are made where the texts are read: no text goes to the one task that gathers the rows.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("hash", F.xxhash64("text"))
    made = with_statistics(picked, ["doc_id", "label", "hash"])
    one = made.groupBy("doc_id").agg(F.min(F.struct("hash", "label", *STATISTICS)).alias("one")).select("one.label", *[f"one.{k}" for k in STATISTICS])
    return cut(one.coalesce(1))


def held_rules(statistics: np.ndarray, rules: list[Rule]) -> np.ndarray:
    """Rows x rules: 1 where the rule holds."""
    out = np.ones((len(statistics), len(rules)))
    for k, rule in enumerate(rules):
        for f, greater, threshold in rule:
            x = statistics[:, f]
            out[:, k] *= (x > threshold) if greater else (x <= threshold)
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = LASSO) -> tuple[float, np.ndarray]:
    """As ``descend`` for columns of 0 and 1; columns that are equal, or each other's opposite, share their weight evenly."""
    turned = x[0] == 1
    kinds, kind, size = np.unique(np.where(turned, 1 - x, x), axis=1, return_inverse=True, return_counts=True)
    intercept, weights = descend(kinds, y, penalty)
    share = (weights / size)[kind.reshape(-1)]
    return intercept + float(share[turned].sum()), np.where(turned, -share, share)


def descend(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 60, tol: float = 1e-7) -> tuple[float, np.ndarray]:
    """(intercept, weights) of the least mean logistic loss plus penalty * sum |weight|, where y has both classes.

    Proximal Newton steps, each solved by coordinate descent and shortened until the loss falls;
    the intercept is the last coordinate and has no penalty.
    """
    n = len(y)
    x = np.column_stack([x, np.ones(n)])
    least = np.append(np.full(x.shape[1] - 1, penalty), 0.0)
    w = np.zeros(x.shape[1])
    w[-1] = math.log(y.sum() / (n - y.sum()))
    loss = lambda w: float(np.mean(np.logaddexp(0, x @ w) - y * (x @ w)) + least @ np.abs(w))
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - y) / n
        bend = (x * (np.maximum(p * (1 - p), 1e-6) / n)[:, None]).T @ x
        d, moved = np.zeros_like(w), np.zeros_like(w)  # the step, and bend @ step

        def swept(at, w=w, slope=slope, bend=bend, d=d, moved=moved) -> float:
            most = 0.0
            for j in at:
                a, z = bend[j, j], w[j] + d[j]
                u = a * z - slope[j] - moved[j]
                change = math.copysign(max(abs(u) - least[j], 0.0), u) / a - z
                if change:
                    d[j] += change
                    moved += change * bend[:, j]
                    most = max(most, abs(change) * math.sqrt(a))
            return most

        every = np.flatnonzero(np.diag(bend) > 0)
        for _ in range(100):
            if swept(every) < tol:
                break
            for _ in range(100):
                if swept(every[(w + d)[every] != 0]) < tol:
                    break
        fall = float(slope @ d + least @ (np.abs(w + d) - np.abs(w)))
        t = 1.0
        while t > 1e-6 and (after := loss(w + t * d)) > now + 1e-4 * t * fall:
            t /= 2
        if t <= 1e-6 or now - after < tol * tol:
            break
        w, now = w + t * d, after
    return float(w[-1]), w[:-1]


def weights_of(rows: DataFrame, rules: list[Rule]) -> tuple[float, list[float]]:
    """(intercept, weight of each rule), fitted in one task on the bounded rows (label, statistics)."""

    def run(batches):
        table = [np.column_stack([batch.column(c).to_numpy() for c in ("label", *STATISTICS)]) for batch in batches]
        both = np.concatenate(table) if table else np.zeros((0, len(STATISTICS) + 1))
        intercept, weights = lasso_logistic(held_rules(both[:, 1:], rules), both[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array([intercept]), pa.array([weights.tolist()])], names=["intercept", "weights"])

    found = rows.select("label", *STATISTICS).coalesce(1).mapInArrow(run, "intercept double, weights array<double>").collect()[0]
    return found["intercept"], found["weights"]


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING) -> Ensemble:
    rows = training_rows(docs, labels, limit)
    n, good = rows.agg(F.count("*"), F.sum("label")).first()
    if not n:
        return Ensemble(0.0, [])
    if good in (0, n):
        return Ensemble(math.log((good + 0.5) / (n - good + 0.5)), [])
    both = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    balance = F.when(F.col("label") > 0, n / (2 * good)).otherwise(n / (2 * (n - good)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5, seed=7, weightCol="w", featureSubsetStrategy="onethird").fit(both.withColumn("w", balance))
    rules = sorted(set().union(*(rules_of(tree_of(tree)) for tree in forest.trees)))
    intercept, weights = weights_of(rows, rules)
    return Ensemble(intercept, [(r, w) for r, w in zip(rules, weights, strict=True) if w])


def score_documents(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, limit)
    scored = with_statistics(docs, ["doc_id"]).withColumn("score", model.score())
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject."""
    model = fit(docs, labels, limit)
    # the statistics' names could be names of document columns, so these travel in a struct
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    # a filter on the score itself would be pushed below the statistics and repeat them for each rule
    scored = computed_once(with_statistics(packed, ["_row"]), {"_score": model.score()})
    return scored.filter(F.col("_score") >= threshold).select("_row.*")
