"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and beginnings of words, whose share of toxic
documents among the learnable labelled ones stands far above the rest.  Counts
are Spark aggregations over those documents, of at most about ``LABELLED_KEYS``
keys, so that the labels travel to the texts and no text is shuffled.  A text then becomes a few
dense numbers: lexicon densities (plain and after undoing character swaps), how
near lexicon words stand to words of address, capitals, punctuation, and the
rate of obfuscated words.  Trees and calibration are Spark ML models.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truecolumn.llm.common import arrow_batches, held_out, may_learn, stored

FEATURES = [
    "lexicon_share", "lexicon_words", "strong_share", "strong_words", "distinct_terms", "hidden_words", "near_you",
    "obfuscated", "capitals", "shouted", "exclaims", "punctuation", "words",
]
#: Terms of the lexicon at most: the most significant ones.  It bounds the model that workers get.
MOST_TERMS = 4000
#: A term needs this lift and this log-likelihood ratio (1 chance in 10 000), which bears counts of zero.
LEAST_LIFT, LEAST_RATIO = 3.0, 15.1
#: Labelled keys that are learned from, about; more than that are thinned by hash.
LABELLED_KEYS = 200_000
#: Lengths of the beginnings of longer words that count as terms of their own.
STEMS = (4, 5, 6, 7)
#: Words between a lexicon word and a word of address.
REACH = 4
THRESHOLD = 0.7

#: Words of address in a few languages: fixed values.
ADDRESS = frozenset(
    """
    you your yours yourself u ur
    du dich dir dein deine deinen euch ihr
    tu te toi ton ta tes vous votre vos
    tú ti tus usted ustedes vosotros
    """.split()
)
#: Characters that stand for letters in disguised words: fixed values.
SWAPS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
_HIDDEN = re.compile(r"[^\W\d_][\d@$!|*._-]+[^\W\d_]")


def terms(text: str) -> set[str]:
    """Words of a text in lower case, and beginnings of the longer ones (marked by ``^``)."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*({f"^{w[:n]}" for w in words if len(w) > n} for n in STEMS))


def weight(word: str, lexicon: dict[str, float]) -> float:
    """The largest weight of a word's terms; 0 if it has none."""
    found = lexicon.get(word, 0.0)
    for n in STEMS:
        if len(word) > n:
            found = max(found, lexicon.get(f"^{word[:n]}", 0.0))
    return found


def _counted(batches: Iterable[pa.RecordBatch]):
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            for term in terms(text):
                counts.setdefault(term, [0, 0])[toxic] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())],
            names=["term", "clean", "toxic"],
        )


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Terms and their log-odds from ``labelled(text, toxic)``; counts cover every row."""
    arrow_batches(labelled.sparkSession)
    sizes = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    toxic, clean = int(sizes.t), int(sizes.n - sizes.t)
    if not toxic or not clean:
        return {}
    counts = labelled.select("text", "toxic").mapInArrow(_counted, "term string, clean long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    t, c = F.col("toxic"), F.col("clean")
    log_odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    # Of the documents with the term and those without it, against a term that does not care.
    share = toxic / (toxic + clean)
    cell = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    n, rest = t + c, toxic + clean - t - c
    ratio = 2 * (cell(t, n * share) + cell(c, n * (1 - share)) + cell(toxic - t, rest * share) + cell(clean - c, rest * (1 - share)))
    found = counts.withColumns({"w": log_odds, "ratio": ratio})
    found = found.where((F.col("w") >= math.log(LEAST_LIFT)) & (F.col("ratio") >= LEAST_RATIO))
    return {r.term: r.w for r in found.orderBy(F.desc("ratio"), "term").limit(MOST_TERMS).collect()}


def features(text: str, lexicon: dict[str, float], strong: float) -> list[float]:
    """The numbers ``FEATURES`` of a whole text."""
    low = text.lower()
    words = _WORD.findall(low)
    total = max(1, len(words))
    weights = {w: weight(w, lexicon) for w in set(words)} if lexicon else {}
    known = {w for w, x in weights.items() if x > 0}
    sure = {w for w in known if weights[w] >= strong}
    hits = [i for i, w in enumerate(words) if w in known] if known else []
    n_sure = sum(words[i] in sure for i in hits)
    near = 0
    for i in hits:
        near += not ADDRESS.isdisjoint(words[max(0, i - REACH) : i + REACH + 1])
    hidden = [m[0] for m in _TOKEN.finditer(low) if _HIDDEN.search(m[0])] if re.search(_HIDDEN, low) else []
    undone = 0
    for token in hidden:
        plain = re.sub(r"[^\w]|_", "", token.translate(SWAPS))
        undone += weight(plain, lexicon) > 0
    letters = max(1, sum(map(len, words)))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    shouted = sum(len(w) > 2 and w.isupper() for w in text.split())
    marks = sum(text.count(c) for c in ".,;:?!-\"'()")
    return [
        len(hits) / total, math.log1p(len(hits)), n_sure / total, math.log1p(n_sure), float(len(known)), math.log1p(undone),
        math.log1p(near), len(hidden) / total, upper / letters, shouted / total, text.count("!") / total, marks / letters, math.log1p(len(words)),
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``docs(doc_id, held_out, text, ...)`` with ``x``, the array of ``FEATURES``, instead of the text."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    # Strong terms: above the median weight of the lexicon.
    strong = float(np.median(list(lexicon.values()))) if lexicon else 0.0
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", x array<double>"

    def run(batches):
        for batch in batches:
            rows = [features(t or "", shared.value, strong) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(rows, pa.list_(pa.float64()))], names=[*names, "x"])

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, trees: int = 20, depth: int = 4) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Learned from labelled rows that are not held out: four fifths of the keys
    grow the trees, one fifth calibrates.  A null text counts as empty; a null
    key or label is not learned from; a key with several labels is toxic if one
    says so; repeated rows are scored alike.  Without
    both classes among the learnable rows every score is their share of toxic
    rows (0 if there are none).
    """
    plain = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = labels.where("doc_id is not null and toxic is not null").where(may_learn(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    part = min(1.0, LABELLED_KEYS / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)) < int(part * (1 << 20)))
    # LABELLED_KEYS bounds what is sent to every executor: a few megabytes.
    met = plain.where(may_learn(F.col("doc_id"))).join(F.broadcast(known), "doc_id")
    lexicon = learn_lexicon(met.select("text", "toxic"))
    measured = stored(with_features(plain, lexicon), "toxicity-features")

    rows = measured.join(F.broadcast(known), "doc_id").select("x", F.col("toxic").cast("double").alias("label"), (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("calibrates"))
    rows = stored(rows.withColumn("features", array_to_vector("x")).drop("x"), "toxicity-labelled")
    grown = rows.where("not calibrates")
    classes = rows.agg(F.avg("label").alias("share"), F.countDistinct("label").alias("kinds")).first()
    in_growth = grown.select("label").distinct().count()
    if (classes.kinds or 0) < 2 or in_growth < 2:
        score = F.lit(float(classes.share or 0.0))
        return measured.select("doc_id", "held_out", score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))

    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, maxBins=32).fit(grown)
    raw = vector_to_array(F.col("probability"))[1]
    judged = model.transform(rows.where("calibrates")).select("label", F.round(raw, 3).alias("raw"))
    # Equal raw scores are one point with their number as weight, so the fit's input is bounded.
    points = judged.groupBy("raw").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    points = stored(points, "toxicity-points")
    scored = model.transform(measured.withColumn("features", array_to_vector("x"))).withColumn("raw", raw)
    if points.isEmpty():
        score = F.col("raw")
    else:
        fit = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(points)
        score = _step(F.col("raw"), list(fit.boundaries), list(fit.predictions))
    scored = scored.select("doc_id", "held_out", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _step(raw, boundaries: list[float], predictions: list[float]):
    """Linear interpolation between the fitted points, constant beyond them."""
    value = F.lit(predictions[-1])
    for i in range(len(boundaries) - 2, -1, -1):
        (a, b), (p, q) = boundaries[i : i + 2], predictions[i : i + 2]
        inner = F.lit(p) + (raw - a) * ((q - p) / (b - a)) if b > a else F.lit(q)
        value = F.when(raw <= b, inner).otherwise(value)
    return F.when(raw <= boundaries[0], F.lit(predictions[0])).otherwise(value)
