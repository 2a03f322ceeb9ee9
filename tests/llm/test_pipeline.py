"""The pipeline: what each stage does to the rows it gets, and that planted cases are caught."""

import hashlib
from collections import Counter

import corpus_pipeline as C
import numpy as np
import public_tokenizers as P
import tiktoken
from helpers import documents, empty
from test_pairs import shingles

from truecolumn.llm.bpe import read_ranks
from truecolumn.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


def test_stages_over_given_and_planted_rows(spark):
    docs = documents(spark, odd=False)
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    clean = docs.where("doc_id = 28 or n_chars between 1500 and 4000").where("text not like '%*%' and text not like '%!!%'").limit(3).collect()
    words = clean[0].text.split()
    planted = [
        (700_001, clean[0].text + " one more word", "en", "src1", 1),
        (700_002, " ".join(words[:200]) + " " + bench + " " + " ".join(words[200:260]), "en", "src1", 1),
        (700_003, " ".join(reversed(clean[1].text.split())) + " token: abcdef123456", "en", "src1", 1),
        (700_004, "short", "en", "src1", 5),
        (None, " ".join(reversed(clean[2].text.split())), None, None, None),
    ]
    docs = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    before, outputs = docs, {}
    for name, stage in C.STAGES:
        after = stored(stage(spark, before, FOLDER), name)
        outputs[name] = (before.collect(), after.collect())
        if name != C.STAGES[-1][0]:
            assert after.columns == C.COLUMNS
        before = after
    kept = {name: Counter(r.doc_id for r in rows[1]) for name, rows in outputs.items()}
    assert 700_004 not in kept["quality"] and {700_001, 700_002, 700_003, None} <= set(kept["quality"])
    assert 700_001 not in kept["near_dedup"] and clean[0].doc_id in kept["near_dedup"]
    assert 700_002 in kept["near_dedup"] and 700_002 not in kept["decontamination"]
    assert kept["secrets"] == kept["decontamination"] == kept["byte_bpe"]
    # Near copies: whatever went has a link of 0.8 to something with a smaller key.
    rows = {r.doc_id: shingles(r.text, 5) for r in outputs["near_dedup"][0] if r.doc_id is not None}
    for gone in set(rows) - set(kept["near_dedup"]):
        assert any(k < gone and 100 * len(rows[k] & rows[gone]) >= 80 * len(rows[k] | rows[gone]) for k in rows)
    texts = {r.doc_id: r.text for r in outputs["secrets"][1]}
    assert texts[700_003].endswith("token: [SECRET]")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(read_ranks(P.path("byte_bpe_50k.tiktoken")))}, special_tokens={})
    for r in outputs["byte_bpe"][1]:
        ids = np.array(encoding.encode_ordinary(texts[r.doc_id] or ""), dtype="<u4").tobytes()
        assert bytes(r.ids) == ids and r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.round_trip
    assert C.STAGES[0][1](spark, empty(spark), FOLDER).count() == 0


def test_run_gives_the_last_stage(spark):
    out = C.run(spark, FOLDER)
    assert out.count() > 50 and out.where("not round_trip").count() == 0
