"""Language, toxicity and quality: held-out accuracy, and statistics against plain re-statements."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents, empty

from truecolumn.llm import quality as Q
from truecolumn.llm import toxicity as X
from truecolumn.llm.language import UNKNOWN, Profiles, grams, language_of_documents, ranked

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def is_held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 3 == 1


def test_language_of_held_out_documents(spark):
    docs = documents(spark, FOLDER)
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = language_of_documents(docs).collect()
    assert len(got) == docs.count()
    right = Counter()
    for r in got:
        lang, text = truth[r.doc_id]
        assert r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1
        if text is None or not any(c.isalpha() for c in text):
            assert r.lang_pred == UNKNOWN
        elif r.held_out and lang:
            right[r.lang_pred == lang] += 1
    assert right[True] >= 0.98 * sum(right.values()) and sum(right.values()) > 200
    assert language_of_documents(empty(spark)).count() == 0


def test_nothing_learned_from_held_out_languages(spark):
    rows = [(i, "zzz qqq " * 5 if is_held_out(i) else "abc abd " * 5, "xx" if is_held_out(i) else "yy") for i in range(40)]
    got = language_of_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"yy"}


def out_of_place(text, lists, size):
    counts = Counter(grams(text).tolist())
    own = sorted(counts, key=lambda c: (-counts[c], c))[:size]
    sums = {}
    for name, theirs in lists.items():
        place = {c: i for i, c in enumerate(theirs)}
        sums[name] = sum(abs(i - place[c]) if c in place else size for i, c in enumerate(own))
    return sums


def test_distances_are_out_of_place_sums():
    texts = {"a": "the cat and the hat " * 3, "b": "der hund und die katze " * 3, "c": "le chat et le chien " * 3}
    lists = {k: ranked(grams(t), 40).tolist() for k, t in texts.items()}
    profiles = Profiles(lists, 40)
    for text in ("the dog and a cat", "der Mann UND die Frau", "le  homme, et la femme!", "x"):
        sums = out_of_place(text, lists, 40)
        name, score = profiles.judge(text)
        best, second = sorted(sums.values())[:2]
        assert sums[name] == best and score == pytest.approx(1 - best / second)
    assert profiles.judge("123 !?") == (UNKNOWN, 0.0) == profiles.judge(None)
    marks = grams("Ab, c")
    assert len(marks) == 3 + 5 + 3  # letters; pairs with borders; triples around one letter or more


def test_toxicity_of_held_out_documents(spark):
    docs = documents(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = X.score_documents(docs, labels).collect()
    assert len(got) == docs.count()
    found = Counter()
    for r in got:
        assert r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.held_out and r.doc_id in truth:
            found[truth[r.doc_id], r.predicted] += 1
    assert found[0, 1] == 0 and found[1, 1] >= 0.7 * (found[1, 1] + found[1, 0])
    assert X.score_documents(empty(spark), labels).count() == 0
    nothing = labels.where("toxic is null")
    assert {(r.score, r.predicted) for r in X.score_documents(documents(spark), nothing).collect()} == {(0.0, 0)}


def test_toxicity_features():
    lexicon = {"idiot": 3.0, "^scumb": 3.0}
    names = dict(zip(X.FEATURES, X.features("You IDIOT!! a scumbag, 1d1ot and idiots", lexicon, 2.0), strict=True))
    assert names["distinct_terms"] == 2 and names["near_you"] > 0 and names["hidden_words"] > 0
    assert names["shouted"] > 0 and names["exclaims"] > 0
    assert len(X.features("", lexicon, 2.0)) == len(X.FEATURES) and not any(X.features("", lexicon, 2.0))
    assert X.terms("Pathetic ox") >= {"pathetic", "ox", "^path", "^patheti"}


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_of_documents(spark):
    docs, labels = documents(spark, FOLDER), spark.read.parquet(f"{FOLDER}/labels.parquet")
    odd = [(800_000 + i, t) for i, t in enumerate(("a a a a", "a b a b a b", "x y z x y z q", "#|<>& |", "A\nA\n\n A\nA", "a b c\na b c"))]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    texts, truth = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    rows = Q.quality_of_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    seen = Counter()
    for r in rows:
        want = statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
        if r.doc_id in truth and not r.base_failed:
            seen[truth[r.doc_id], r.kept] += 1
    assert seen[1, False] == 0 and seen[0, False] >= 0.9 * (seen[0, True] + seen[0, False])
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert Q.quality_of_documents(empty(spark), labels).count() == 0
    assert Q.quality_of_documents(docs, labels.limit(0)).where("not kept and not base_failed").count() == 0


def test_decision_list_finds_the_planted_rules(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        x = {f: float(rng.random()) for f in Q.FEATURES}
        rows.append((*x.values(), bool(x["symbols"] > 0.8 or (x["upper"] > 0.7 and x["bars"] < 0.4)), i % 3 == 0))
    schema = ", ".join(f"{f} double" for f in Q.FEATURES) + ", bad boolean, prune boolean"
    data = spark.createDataFrame(rows, schema)
    found = Q.learn(data)
    used = {c.feature for rule in found.rules for c in rule}
    assert {"symbols", "upper", "bars"} <= used
    wrong = data.where(found.verdict().isNotNull() != data["bad"]).count()
    assert wrong < 0.06 * 3000
    assert Q.learn(data.where("not bad")).rules == []


def test_no_python_in_quality_plans(spark):
    docs, labels = documents(spark), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    plan = Q.keep_good(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
