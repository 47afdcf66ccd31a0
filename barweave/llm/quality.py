"""Quality scores learned from preference pairs.

Bradley-Terry: a document of label 1 is preferred to one of label 0, and the log odds of that preference are the difference of
their scores. With linear scores this is a logistic regression without intercept on feature differences, fitted by Spark.
Scores then pass a logistic curve centred on the quantile of training scores that splits the labels best.

The fit reads a bounded sample of labelled documents (``max_labelled``, lowest digests first); scoring reads all documents.
"""
import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reuse
from .common import free_name

FEATURES = ("log_words", "word_length", "upper", "digits", "punctuation", "symbols", "symbol_words", "exclaims", "bars", "distinct",
            "top_word", "word_repeats", "line_repeats", "sentence_ends")
MAX_LABELLED = 20_000
RIVALS = 4
FOLDS, HELD_OUT = 3, 1
PLAIN = frozenset(".,;:'\"!?-()[]/‘’“”–—…¿¡«»")


def features(text):
    """Shares and counts that mark prose, shouting, symbol noise, lists and repetition; all zero for a text without words."""
    words = text.split() if text else ()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = text.translate(_NO_SPACE)
    m = len(chars)
    low = chars.lower()
    if len(low) == m:
        a = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        upper = np.count_nonzero(a != np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32))
    else:
        upper = sum(c.isupper() for c in chars)
    kinds = {}
    for c in set(chars):
        if not c.isalnum():
            kinds[c] = chars.count(c)
    digits = sum(chars.count(c) for c in "0123456789")
    plain = sum(k for c, k in kinds.items() if c in PLAIN)
    odd = sum(kinds.values()) - plain
    counts = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeats = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    noisy = sum(not w[-1].isalnum() and w[-1] not in PLAIN for w in counts) / len(counts)
    return [np.log1p(n), min(m / n, 30.0), upper / m, digits / m, plain / m, odd / m, noisy, kinds.get("!", 0) / n, kinds.get("|", 0) / n,
            len(counts) / n, max(counts.values()) / n, repeats / n, 1 - len(set(lines)) / max(1, len(lines)),
            sum(kinds.get(c, 0) for c in ".?") / n]


_NO_SPACE = dict.fromkeys(map(ord, " \t\n\r\x0b\x0c "))


def feature_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(v) for v in features(t)] for t in texts])
    return run(F.coalesce(text, F.lit("")))


def fold(doc_id: Column, folds=FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_rows(docs, labels, id_col="doc_id", text_col="text", label_col="quality", max_labelled=MAX_LABELLED) -> DataFrame:
    """Features of at most about ``max_labelled`` labelled documents outside the held-out fold, lowest digests first.

    Labels other than 0 and 1 and null ids do not count; repeated labels of a document count once if they agree, else not at all. Of an
    id's rows the text of the lowest digest counts.
    """
    y = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != HELD_OUT))
    y = y.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("_max")).where("y = _max").drop("_max")
    y = y.withColumn("digest", F.md5(F.col("_id").cast("string").cast("binary")))
    chosen = y.orderBy("digest").limit(max_labelled)
    # max_labelled rows of an id, a digit and a digest: bounded, so every task can hold them.
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    first = F.min(F.struct(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), "x")).alias("first")
    return known.withColumn("x", feature_column(F.col("text"))).groupBy("doc_id", "y", "digest").agg(first).select("doc_id", "y", "digest", "first.x")


def fit(sample: DataFrame, rivals=RIVALS, reg=1e-4) -> dict:
    """Weights, centre and scale of the score from rows (y, digest, x).

    Each document of the larger class meets ``rivals`` of the other, round robin in digest order. The sample is bounded, so its windows and
    the scores brought to the driver are too. Without both labels every score is one half.
    """
    place = Window.partitionBy("y").orderBy("digest")
    s = reuse(sample.withColumn("i", F.row_number().over(place) - 1).withColumn("n", F.count("*").over(Window.partitionBy("y"))))
    sizes = {r["y"]: r["n"] for r in s.groupBy("y").agg(F.max("n").alias("n")).collect()}
    if len(sizes) < 2:
        return {"weights": [0.0] * len(FEATURES), "centre": 0.0, "scale": 1.0, "quantile": 0.0}
    most = max(sizes, key=lambda y: (sizes[y], y))
    few = sizes[1 - most]
    a = s.where(F.col("y") == most).select(F.col("x").alias("xa"), "i", F.explode(F.sequence(F.lit(0), F.lit(min(rivals, few) - 1))).alias("r"))
    a = a.withColumn("j", (F.col("i") * rivals + F.col("r")) % few)
    b = s.where(F.col("y") == 1 - most).select(F.col("x").alias("xb"), F.col("i").alias("j"))
    won, lost = ("xa", "xb") if most == 1 else ("xb", "xa")
    pairs = a.join(b, "j").select(F.zip_with(won, lost, lambda u, v: u - v).alias("d"))
    both = pairs.select("d", F.lit(1.0).alias("label")).unionByName(pairs.select(F.transform("d", lambda u: -u).alias("d"), F.lit(0.0).alias("label")))
    both = reuse(both)
    model = LogisticRegression(fitIntercept=False, regParam=reg, maxIter=60).fit(both.select(array_to_vector("d").alias("features"), "label"))
    w = [float(v) for v in model.coefficients.toArray()]
    scored = s.select("y", F.aggregate(F.zip_with("x", F.array(*map(F.lit, w)), lambda u, v: u * v), F.lit(0.0), lambda p, q: p + q).alias("s"))
    y, z = (np.array(c) for c in zip(*[(r["y"], r["s"]) for r in scored.orderBy("s", "y").collect()]))
    return {"weights": w} | _cut(y, z)


def _cut(y, z):
    """The score quantile at which most labels fall on their side, and the spread of scores as scale."""
    below = np.concatenate([[0], np.cumsum(y == 0)])
    above = (y == 1).sum() - np.concatenate([[0], np.cumsum(y == 1)])
    right = (below + above).astype(float)
    right[1:-1][z[1:] == z[:-1]] = -1  # equal scores fall on one side
    best = np.flatnonzero(right == right.max())
    k = int(best[len(best) // 2])
    centre = z[0] - 1e-6 if k == 0 else z[-1] + 1e-6 if k == len(z) else (z[k - 1] + z[k]) / 2
    return {"centre": float(centre), "scale": float(max(z.std(), 1e-6)), "quantile": k / len(z)}


def scores(model, texts):
    x = np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))
    z = (x @ np.array(model["weights"]) - model["centre"]) / model["scale"] * 2
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_column(model, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(scores(model, t))
    return run(F.coalesce(text, F.lit("")))


def fit_documents(docs, labels, id_col="doc_id", text_col="text", max_labelled=MAX_LABELLED) -> dict:
    return fit(reuse(training_rows(docs, labels, id_col, text_col, max_labelled=max_labelled)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", max_labelled=MAX_LABELLED) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Only the text enters a score; a null text scores as an empty one. A null doc_id is in no fold (held_out is false). Other columns are ignored.
    """
    model = fit_documents(docs, labels, id_col, text_col, max_labelled)
    d = docs.select(F.col(id_col).alias("doc_id"), score_column(model, F.col(text_col)).alias("score"))
    return d.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    score = free_name(docs, "score")  # the only name that meets the table's own
    return docs.withColumn(score, score_column(fit_documents(docs, labels, id_col, text_col, **how), F.col(text_col))).where(F.col(score) >= 0.5).drop(score)
