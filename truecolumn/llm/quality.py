"""Quality rules: text statistics and a learned decision list, in Spark expressions only.

The statistics are DataFrame expressions over the words and lines of the whole
text.  The list is learned by sequential covering from labelled statistics: a
rule grows condition by condition (the threshold with the best gain), is pruned
on rows it did not grow on, and is kept if it is precise there; the rows it
covers then go, and the next rule grows on the rest.  Every count comes from one
Spark aggregation over all labelled rows; the driver sees only counts per
statistic and bin.  The result is one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truecolumn.llm.common import stored

_SPACE = r"[ \\t\\n\\x0B\\f\\r]"
_NOT_SPACE = r"[^ \\t\\n\\x0B\\f\\r]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "n_words", "mean_word", "symbols", "upper", "exclaims", "bars", "dup_lines", "repeats", "distinct", "line_words",
]
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Share of the best gain that a stricter threshold must reach.
ALIKE = 0.97
#: Labelled keys that :func:`keep_good` learns from, about.
LABELLED_KEYS = 200_000


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the statistics ``BASE``; a null text has no words and no lines.

    ``n_repeat_words`` counts the words in three-word windows found twice or more
    in the text.  Windows are sorted by a hash that shares a 64-bit number with
    its position, neighbours of equal hash are compared by their words.
    """
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn("_text", plain)
    out = out.withColumns(
        {
            "_words": F.expr(f"array_remove(split(_text, '{_SPACE}+'), '')"),
            "_lines": F.expr(f"filter(split(_text, '\\n'), x -> x rlike '{_NOT_SPACE}')"),
        }
    )
    out = out.withColumns({"_bits": F.length(F.bin(F.size("_words"))), "n_words": F.size("_words").cast("long")})
    packed = """if(n_words < 3, cast(array() as array<bigint>),
        sort_array(transform(sequence(0, size(_words) - 3), i ->
            shiftleft(shiftrightunsigned(xxhash64(_words[i], _words[i + 1], _words[i + 2]), _bits), _bits) | i)))"""
    out = out.withColumn("_packed", F.expr(packed))
    at = "cast({} & (shiftleft(1L, _bits) - 1) as int)"
    same = (
        "shiftrightunsigned(x ^ y, _bits) = 0"
        + "".join(f" AND _words[{at.format('x')} + {k}] = _words[{at.format('y')} + {k}]" for k in range(3))
    )
    before = same.replace("y", "get(_packed, j - 1)")
    behind = same.replace("y", "get(_packed, j + 1)")
    found = f"""sort_array(transform(
        filter(transform(_packed, (x, j) -> if((j > 0 AND {before}) OR (j < size(_packed) - 1 AND {behind}), x, null)), x -> x is not null),
        x -> {at.format('x')}))"""
    out = out.withColumn("_places", F.expr(found))
    out = out.withColumns(
        {
            "word_chars": F.expr("cast(length(array_join(_words, '')) as long)"),
            "n_symbols": F.expr("cast(size(split(_text, '[#*$%&|<>]', -1)) - 1 as long)"),
            "n_dup_lines": F.expr("cast(size(_lines) - size(array_distinct(_lines)) as long)"),
            "n_repeat_words": F.expr(
                "aggregate(transform(_places, (x, j) -> cast(coalesce(least(3, get(_places, j + 1) - x), 3) as long)), 0L, (a, b) -> a + b)"
            ),
        }
    )
    return out.drop("_bits", "_packed", "_places")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """:func:`with_statistics` and the rates ``FEATURES`` that rules are learned on."""
    rate = "cast({} as double) / greatest({}, 1)"
    out = with_statistics(docs, text)
    out = out.withColumns(
        {
            "mean_word": F.expr(rate.format("word_chars", "n_words")),
            "symbols": F.expr(rate.format("n_symbols", "n_words")),
            "upper": F.expr(rate.format(r"length(regexp_replace(_text, '[^\\p{Lu}]+', ''))", "word_chars")),
            "exclaims": F.expr(rate.format("size(split(_text, '!', -1)) - 1", "n_words")),
            "bars": F.expr(rate.format("size(split(_text, '[|]', -1)) - 1", "n_words")),
            "dup_lines": F.expr(rate.format("n_dup_lines", "size(_lines)")),
            "repeats": F.expr(rate.format("n_repeat_words", "n_words")),
            "distinct": F.expr(rate.format("size(array_distinct(_words))", "n_words")),
            "line_words": F.expr(rate.format("n_words", "size(_lines)")),
        }
    )
    return out.drop("_text", "_words", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; a row that meets one is rejected, any other is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def covers(self, rule: list[Condition]) -> Column:
        out = F.lit(True)
        for condition in rule:
            out = out & condition.column()
        return out

    def verdict(self) -> Column:
        """The text of the first rule that rejects a row, else null."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(self.covers(rule), F.lit(" and ".join(map(str, rule)))).otherwise(out)
        return out


def _thresholds(rows: DataFrame, steps: int) -> dict[str, list[float]]:
    """Quantiles of each feature over all rows and over the rejected ones."""
    wanted = [0.01, *[i / steps for i in range(1, steps)], 0.99]
    columns = [F.percentile_approx(f, wanted, 1000).alias(f) for f in FEATURES]
    columns += [F.percentile_approx(F.when(F.col("bad"), F.col(f)), wanted, 1000).alias(f"bad_{f}") for f in FEATURES]
    row = rows.agg(*columns).first()
    return {f: sorted({float(x) for x in (row[f] or []) + (row[f"bad_{f}"] or []) if x is not None}) for f in FEATURES}


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many thresholds lie below the value."""
    return F.lit(sum((F.when(F.col(feature) > c, 1).otherwise(0) for c in cuts), F.lit(0)))


def learn(
    rows: DataFrame,
    steps: int = 24,
    most_rules: int = 10,
    most_conditions: int = 3,
    precision: float = 0.9,
    least_covered: int = 5,
) -> DecisionList:
    """A list from ``rows`` with ``FEATURES``, boolean ``bad`` and boolean ``prune``.

    Rows with ``prune`` judge rules, the others grow them; all rows are counted.
    The parameters bound the model, not the data.  Without bad rows the list is
    empty and keeps everything.
    """
    cuts = _thresholds(rows, steps)
    if not any(cuts.values()):
        return DecisionList()
    binned = rows.select(*FEATURES, "bad", "prune", *[_bin(f, cuts[f]).cast("int").alias(f"b_{f}") for f in FEATURES])
    binned = stored(binned, "quality-bins")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in FEATURES])).alias("c")
    found = DecisionList()
    left = binned
    while len(found.rules) < most_rules:
        rule: list[Condition] = []
        covered, before = left.where(~F.col("prune")), None
        while len(rule) < most_conditions:
            table = covered.select("bad", cells).groupBy("c.f", "c.b").agg(F.sum(F.col("bad").cast("long")).alias("p"), F.count("*").alias("t"))
            counts: dict[str, dict[int, tuple[int, int]]] = {}
            for r in table.collect():
                counts.setdefault(r.f, {})[r.b] = (r.p, r.t - r.p)
            best = _best(counts, cuts, least_covered)
            if best is None or (before is not None and best[1] <= 0):
                break
            rule.append(best[0])
            before = best
            covered = covered.where(best[0].column())
            if best[3] == 0:
                break
        if not rule:
            break
        rule, sure, covers = _pruned(left, rule, found)
        if covers < least_covered or sure < precision:
            break
        found.rules.append(rule)
        left = left.where(~found.covers(rule))
    return found


def _best(counts, cuts, least):
    """The condition of the best gain: ``(condition, gain, bad, good)``.

    Of the thresholds of one statistic within ``ALIKE`` of the best gain the
    strictest is taken, so that a rule stays clear of the rows to keep.
    """
    best, tried = None, []
    for feature, bins in counts.items():
        p_all, n_all = sum(p for p, _ in bins.values()), sum(n for _, n in bins.values())
        if not p_all or not n_all:
            continue
        prior = math.log2(p_all / (p_all + n_all))
        p = n = 0
        for i, cut in enumerate(cuts[feature]):
            p, n = p + bins.get(i, (0, 0))[0], n + bins.get(i, (0, 0))[1]
            for above, x, y in ((False, p, n), (True, p_all - p, n_all - n)):
                if x < least or x + y == p_all + n_all:
                    continue
                gain = x * (math.log2(x / (x + y)) - prior)
                tried.append((Condition(feature, above, cut), gain, x, y))
                if best is None or gain > best[1]:
                    best = tried[-1]
    if best is None or best[1] <= 0:
        return best
    one = best[0]
    alike = [t for t in tried if (t[0].feature, t[0].above) == (one.feature, one.above) and t[1] >= ALIKE * best[1]]
    return (max if one.above else min)(alike, key=lambda t: t[0].threshold)


def _pruned(left: DataFrame, rule: list[Condition], found: DecisionList):
    """The prefix of the rule that judges unseen rows best, its precision and its cover there."""
    judged = left.where("prune")
    sums = []
    for k in range(1, len(rule) + 1):
        hit = found.covers(rule[:k])
        sums += [
            F.coalesce(F.sum((hit & F.col("bad")).cast("long")), F.lit(0)).alias(f"p{k}"),
            F.coalesce(F.sum((hit & ~F.col("bad")).cast("long")), F.lit(0)).alias(f"n{k}"),
        ]
    row = judged.agg(*sums).first()
    score = lambda k: ((row[f"p{k}"] - row[f"n{k}"]) / max(1, row[f"p{k}"] + row[f"n{k}"]), row[f"p{k}"])
    k = max(range(1, len(rule) + 1), key=score)
    p, n = row[f"p{k}"], row[f"n{k}"]
    return rule[:k], p / max(1, p + n), p


def learn_from_labels(features: DataFrame, labels: DataFrame) -> DecisionList:
    """A list from ``features(doc_id, ...)`` and ``labels(doc_id, quality)``; quality 0 is bad.

    Rows without a key or a label are not learned from.  A third of the keys, by
    hash, prunes.  Rows that the base rule rejects already teach nothing new and
    are left out.
    """
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad"))
    rows = features.where(~base_failed()).select("doc_id", *FEATURES).join(known, "doc_id")  # features are stored
    rows = rows.withColumn("prune", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).drop("doc_id")
    return learn(stored(rows, "quality-labelled"))


def quality_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reason)``.

    One row per row of ``docs``; repeated rows are judged alike.  A null or empty
    text fails the base rule.  A null key is judged but never learned from.
    """
    measured = stored(with_features(docs.select("doc_id", "text")).drop("text"), "quality-features")
    verdict = learn_from_labels(measured, labels).verdict()
    reason = F.when(base_failed(), F.lit("base")).otherwise(verdict)
    return measured.select("doc_id", *BASE, base_failed().alias("base_failed"), reason.alias("reason")).select(
        "doc_id", *BASE, "base_failed", F.col("reason").isNull().alias("kept"), "reason"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that neither the base rule nor the learned list rejects, with their columns.

    The list is learned from the statistics of labelled rows, of at most about
    ``LABELLED_KEYS`` keys (more are thinned by hash); every row is then
    measured and judged where it is read, without a shuffle.
    """
    keyed = labels.where("doc_id is not null and quality is not null").select("doc_id").distinct()
    part = min(1.0, LABELLED_KEYS / max(1, keyed.count()))
    keyed = keyed.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(part * (1 << 20)))
    # LABELLED_KEYS bounds what is sent to every executor, so no text is shuffled.
    known = with_features(docs.select("doc_id", "text").join(F.broadcast(keyed), "doc_id", "left_semi")).drop("text")
    decided = learn_from_labels(stored(known, "quality-features"), labels)
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    # A filter must not be pushed below the steps: it would be rewritten into one
    # expression that repeats every step many times.  A column that is not
    # deterministic stops that.
    judged = with_features(docs.select(own, F.col("text"))).withColumn("_fence", F.monotonically_increasing_id())
    return judged.where(~base_failed() & decided.verdict().isNull() & (F.col("_fence") >= 0)).select("_row.*")
