"""BPE, packing, archives and decontamination: library results, round trips and brute force."""

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from helpers import documents, empty, words

from truecolumn.llm import arc as A
from truecolumn.llm import decontaminate as D
from truecolumn.llm.bpe import Codec, read_ranks, token_digests, tokenize
from truecolumn.llm.packing import FreeSpace, best_fit, cut, pack, position_ids, token_ids
from truecolumn.llm.words import slices, windows, words_of

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {token: i for i, token in enumerate(read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_are_the_librarys(spark, library):
    docs = documents(spark)
    want = Counter()
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        raw = np.array(ids, dtype="<u4").tobytes()
        want[r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    got = token_digests(docs, PATH, P.PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert token_digests(empty(spark), PATH, P.PATTERN).count() == 0
    named = docs.withColumnRenamed("kept", "ids").withColumnRenamed("score", "decoded")
    assert sorted(tokenize(named, PATH, P.PATTERN).columns) == sorted([*docs.columns[:6], "x1", "n_words", "spans", "ids", "decoded"])


def test_pieces_of_every_length(library):
    codec = Codec(read_ranks(PATH), P.PATTERN)
    rng = random.Random(5)
    for size in (1, 2, 7, 199, 201, 2000):
        for letters in ("ab", "ther", "<|*#", "aé漢\U0001f600", " \t\n", "0123"):
            text = "".join(rng.choice(letters) for _ in range(size))
            assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)
            heap = b"".join(codec.merged_by_heap(p.encode()) for p in codec.split(text))
            assert np.frombuffer(heap, "<u4").tolist() == library.encode_ordinary(text)
            assert codec.decode(codec.encode([text, "", text])) == [text.encode(), b"", text.encode()]


def test_queries_take_a_row_for_each_new_piece(monkeypatch):
    """Neither a row for each byte, nor a query over every token of a text to decode it."""
    codec, taken = Codec(read_ranks(PATH), P.PATTERN), []
    plain = codec._queried
    monkeypatch.setattr(codec, "_queried", lambda sql, name, rows: taken.append(rows.num_rows) or plain(sql, name, rows))
    texts = ["zqxjkvzq wvzxqj zqxjkvzq", "", "\u6f22zq zqxjkvzq zqxjkvzq"]
    pieces = {p for t in texts for p in codec.split(t) if p.encode() not in codec.rank}
    assert codec.decode(codec.encode(texts)) == [t.encode() for t in texts]
    assert taken == [len(pieces)]


def test_packed_rows_give_the_documents_back(spark, library):
    docs = documents(spark)
    tokens = token_ids(docs, PATH, P.PATTERN)
    for length, kind, width in ((64, "<u2", 2), (2048, "<u4", 4)):
        parts = defaultdict(list)
        for r in pack(tokens, length, id_bytes=width, block=5_000).collect():
            ids = np.frombuffer(r.ids, kind)
            assert len(ids) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
            assert (ids[r.n_tokens :] == 50_256).all()
            positions = position_ids(r.position_resets, length)
            for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
                parts[doc].append((start, ids[a:b].tolist()))
                assert positions[a] == 0 and positions[b - 1] == b - a - 1
        for doc_id, rows in Counter((r.doc_id, r.text) for r in docs.collect()).items():
            want = library.encode_ordinary(doc_id[1] or "")
            pieces = sorted(parts.get(doc_id[0], []))
            assert len(pieces) == rows * -(-len(want) // length)
            assert sum((ids for _, ids in pieces[::rows]), []) == want
    assert pack(token_ids(empty(spark), PATH, P.PATTERN)).count() == 0


def test_best_fit_agrees_with_plain_search():
    rng = random.Random(1)
    pieces = [p for i in range(800) for p in cut(i, np.arange(int(rng.expovariate(1 / 40)), dtype="<u4"), 64)]
    rows = best_fit(pieces, 64)
    free = []
    for piece in sorted(pieces, key=lambda p: -len(p.ids)):
        fits = [(f, i) for i, f in enumerate(free) if f >= len(piece.ids)]
        if fits:
            free[min(fits)[1]] -= len(piece.ids)
        else:
            free.append(64 - len(piece.ids))
    assert sorted(free) == sorted(64 - sum(len(p.ids) for p in row) for row in rows)
    space = FreeSpace(10)
    assert space.take(1) is None
    space.put(0, 10)
    space.put(1, 3)
    assert space.take(2) == (1, 3) and space.take(2) == (0, 10) and space.take(1) is None


def test_pages_through_archives(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    again = pages.selectExpr("page_id + 100000", "url", "html").limit(20)
    odd = [(900_001, "http://a b/ü\n", None), (900_002, None, ""), (None, "x", "q\r\n\r\nWARC/1.0\r\n"), (900_003, "y", "http 漢\n" * 40_000), (900_003, "y", "http 漢\n" * 40_000)]
    pages = pages.union(again).union(spark.createDataFrame(odd, pages.schema))
    rows = pages.collect()
    top = {}
    for r in rows:
        if r.page_id is not None:
            top[r.html or ""] = max(top.get(r.html or "", -1), r.page_id)
    want = Counter()
    for r in rows:
        data = (r.html or "").encode()
        other = top[r.html or ""] if r.page_id is not None and r.page_id != top[r.html or ""] else None
        want[r.page_id, len(data), A.digest(data), "response" if other is None else "revisit", other] += 1
    got = A.converted_pages(spark, pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert len({r.record_id for r in got if r.page_id is not None}) == len({r.page_id for r in rows}) - 1
    assert A.converted_pages(spark, pages.limit(0)).count() == 0


def test_archives_are_compressed_fast(spark, tmp_path):
    rng = random.Random(3)
    body = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "row", "cell"]) for _ in range(20_000)).encode()
    rows = spark.createDataFrame([(1, "http://x/", "20240101000000", "text/html", bytearray(body))], "key long, target string, date string, mime string, payload binary")
    folder = A.write_arc(rows.coalesce(1), str(tmp_path / "arc"), 1)
    (file,) = [f for f in (tmp_path / "arc").iterdir() if f.suffix == ".gz"]
    plain = gzip.decompress(file.read_bytes())
    assert plain.endswith(body + b"\n")
    small, fast = (len(gzip.compress(plain, level)) for level in (6, 1))
    assert file.stat().st_size > (small + fast) / 2
    assert [(r.key, bytes(r.payload)) for r in A.read_arc(spark, folder).collect()] == [(1, body)]


def test_both_arc_versions_and_odd_headers():
    for version in (1, 2):
        block = A.http_block(7, b"body\n\nhttp://x 1 2 3 4\n", "text/html")
        data = A.version_block(version) + b"\n" + A.arc_record(version, "http://e/ a", "200102", "text/html", block) + b"\n"
        data += A.arc_record(version, "http://f/", "20010203040506", "-", b"") + b"\n"
        one, two = A.parse_arc(data)
        assert one["target"] == "http://e/%20a" and one["block"] == block and A.split_http(one["block"])[1].startswith(b"body")
        assert two["block"] == b"" and A.arc_date(two["date"]) == "2001-02-03T04:05:06Z"
    blank = A.version_block(1) + b"http://with blank/ 1.2.3.4 2001 text/plain 3\nabc\n"
    assert next(iter(A.parse_arc(blank)))["target"] == "http://with blank/"
    with pytest.raises(ValueError, match="ends within"):
        list(A.parse_arc(A.version_block(1) + b"http://x 1.2.3.4 2001 text/plain 30\nabc\n"))
    with pytest.raises(ValueError, match="10 fields"):
        list(A.parse_arc(A.version_block(2) + b"http://x 1.2.3.4 2001 text/plain 3\nabc\n"))
    assert A.arc_date("2001") == "2001-01-01T00:00:00Z" and A.arc_date("x") == "1970-01-01T00:00:00Z"
    assert A.arc_date("20019999") == "1970-01-01T00:00:00Z"


def test_decontamination_agrees_with_brute_force(spark):
    docs = documents(spark).select("doc_id", "text", "lang")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text")
    bench = bench.union(spark.createDataFrame([(None, "a b c"), (901, None), (902, "")], bench.schema))
    rng = random.Random(4)
    base = [r.text.split()[:300] for r in docs.limit(40).collect() if r.text]
    items = [r for r in bench.collect() if r.text and r.item_id is not None]
    planted = []
    for i, item in enumerate(items * 2):
        w = [x for x in item.text.split() if rng.random() > 0.12]
        around = base[i % len(base)]
        at = rng.randrange(len(around) + 1)
        planted.append((10**6 + i, " ".join(around[:at] + w + around[at:]), "en"))
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    known = D.read_items([(r.item_id, r.text, None) for r in items])
    index = D.Index(known, None, None, None, None, None, 1)
    masks = [(D.places(i.words), len(i.words)) for i in known]
    rows = docs.collect()
    want = set()
    for r, h in zip(rows, D._hashes([r.text or "" for r in rows]), strict=True):
        for item, (m, n) in zip(known, masks, strict=True):
            if D.common_words(h.tolist(), m, n) >= 0.6 * n and index._tightest(h.tolist(), item):
                want.add((r.doc_id, item.item_id))
    assert len(got & want) >= 0.95 * len(want) and got <= want and len(want) >= 80
    hit = {d for d, _ in got}
    kept = D.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.doc_id not in hit)
    assert D.contaminated(empty(spark), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0


def test_widespread_items_are_found(spark):
    rng = random.Random(7)
    rows = [r.text.split()[:200] for r in documents(spark).limit(120).collect() if r.text]
    item = "which seven rivers of the old northern province meet below the ruined bridge at harvest"
    split = item.split()
    bench = spark.createDataFrame([(1, item), (2, "quite another item of words that nobody ever copied anywhere")], "item_id long, text string")
    # A third of the rows are exact copies, some others hold the item among other words.
    copy = " ".join(rows[0] + split + rows[1])
    table = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(1000 + i, copy) for i in range(len(rows) // 2)]
    for i in range(20):
        at = rng.randrange(len(rows[i]))
        table.append((2000 + i, " ".join(rows[i][:at] + split + rows[i][at:])))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    want = {(i, 1) for i, _ in table if i >= 1000}
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()} == want
    assert {r.doc_id for r in D.without_contaminated(docs, bench).collect()} == set(range(len(rows)))
    few = docs.where("doc_id between 2000 and 2002")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(few, bench).collect()} == {(2000 + i, 1) for i in range(3)}


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_truncated_items_are_found(spark):
    def split(text):
        return "".join(c if not c.isascii() or c.isalnum() else " " for c in text.lower()).split()

    rows = [r.text.split()[:60] for r in documents(spark).limit(30).collect() if r.text]
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").limit(20)
    items = [(r.item_id, split(r.text)) for r in bench.collect()]
    table = []
    for i, (item_id, item) in enumerate(items):
        n = len(item)
        for k, share in enumerate((0.5, 0.62, 0.7, 0.8, 0.9)):
            size = -int(-n * share // 1)
            for last, part in enumerate((item[:size], item[n - size :])):
                around = rows[(3 * i + k) % len(rows)]
                table.append((item_id * 100 + 10 * last + k, " ".join(around[:30] + part + around[30:])))
    want = set()
    for doc_id, text in table:
        have = split(text)
        for item_id, item in items:
            size = len(item) + len(item) // 2
            if len(set(have) & set(item)) < 0.3 * len(set(item)):
                continue
            if any(longest_common(have[a : a + size], item) >= 0.6 * len(item) for a in range(0, max(1, len(have) - size + 1), 3)):
                want.add((doc_id, item_id))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    found = D.contaminated(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert {(i * 100 + 10 * last + k, i) for i, _ in items for last in (0, 1) for k in (1, 2, 3, 4)} <= want
    assert got == want and all(r.answer is None for r in found)
    # An answer that is given must be there.
    told = bench.selectExpr("item_id", "text", "substring_index(text, ' ', -5) as answer")
    answered = {(r.doc_id, r.item_id) for r in D.contaminated(docs, told, "answer").collect()}
    assert answered < got and {(i * 100 + 10 + k, i) for i, _ in items for k in (1, 2, 3, 4)} <= answered


def test_items_of_null_and_repeated_keys(spark):
    texts = [
        "which seven rivers meet below the ruined bridge at harvest time",
        "name every green planet that a slow comet passed before dawn",
        "how many copper coins did four tired sailors hide under sand",
        "why would cold iron ring louder than warm glass in winter",
    ]
    bench = spark.createDataFrame(list(zip((5, 5, None, None), texts, strict=True)), "item_id long, text string")
    rows = [r.text.split()[:80] for r in documents(spark).limit(20).collect() if r.text]
    table = [(i, " ".join(w)) for i, w in enumerate(rows)]
    table += [(100 + i, " ".join(rows[i] + text.split() + rows[i + 1])) for i, text in enumerate(texts)]
    # One task finds the texts of one key one after the other.
    table += [(200, f"{texts[0]} {' '.join(rows[0])} {texts[1]}"), (None, texts[2])]
    docs = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    want = Counter([(100, 5), (101, 5), (102, None), (103, None), (200, 5), (200, 5), (None, None)])
    assert Counter((r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()) == want
    assert sorted(r.doc_id for r in D.without_contaminated(docs, bench).collect()) == list(range(len(rows)))


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = step(row, x, b)
        return row[-1]

    def step(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        return new

    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 90))]
        b = [rng.randrange(6) for _ in range(rng.randrange(1, 70))]
        assert D.common_words(a, D.places(np.array(b)), len(b)) == plain(a, b)


def test_words_of_batches():
    texts = ["a b", None, "", " \t\x0b", "x" * 50, "é 漢  z\n", "A b A"]
    column = pa.array(texts)
    got = words_of(column)
    sizes = [len(words(t)) for t in texts]
    assert np.diff(got.at).tolist() == sizes
    for i, text in enumerate(texts):
        again = words_of(pa.array([text], pa.string()))
        assert got.hashes[got.at[i] : got.at[i + 1]].tolist() == again.hashes.tolist()
    lower = words_of(column, lower=True)
    assert lower.hashes[lower.at[6]] == lower.hashes[lower.at[6] + 2] == lower.hashes[0]
    assert words_of(pa.array(["p.q-r"]), plain=True).at.tolist() == [0, 3]
    assert windows(got.hashes, 3)[0] == windows(got.hashes[:3], 3)[0]
    batch = pa.record_batch({"t": column})
    assert [s.num_rows for s in slices(batch, "t", 10)] and sum(s.num_rows for s in slices(batch, "t", 10)) == len(texts)


def test_every_passage_shapes_the_latent_space(spark, monkeypatch):
    rng, words = random.Random(3), [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice([*words, "other"]) for _ in range(rng.randint(0, 130))) for _ in range(40)]
    known = D.Vocabulary(D.read_items([(1, " ".join(words), None)]))
    number = {int(h[0]): int(np.searchsorted(known.words, h[0])) for h in D._hashes(words)}
    held, pairs = Counter(), Counter()
    for h in D._hashes(texts):
        held.update({number[w] for w in h.tolist() if w in number})
        for begin in range(0, len(h), D.STEP * D.STEPS):
            found = Counter(number[w] for w in h[begin : begin + D.STEP * D.STEPS].tolist() if w in number)
            pairs.update({(a, b): found[a] * found[b] for a in found for b in found if a <= b})
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for dense, most in ((D.DENSE_WORDS, D.HELD_PAIRS), (0, D.HELD_PAIRS), (0, 20)):
        monkeypatch.setattr(D, "DENSE_WORDS", dense)
        monkeypatch.setattr(D, "HELD_PAIRS", most)
        got = {(r.word, r.other): r.n for r in D.counted(table, known).collect()}
        assert got == {**pairs, **{(w, -1): n for w, n in held.items()}}
    # The matrix's square by pairs gives the singular vectors of the matrix itself.
    matrix = np.zeros((200, 12))
    for i, h in enumerate(D._hashes(texts)):
        for j, w in enumerate(h.tolist()):
            if w in number:
                matrix[5 * i + j // (D.STEP * D.STEPS), number[w]] += 1
    idf = np.linspace(1, 2, 12)
    basis = D.latent_space(D.counted(table, known).where("other >= 0"), idf, rank=12)
    want = matrix * idf
    np.testing.assert_allclose(want @ basis @ basis.T, want, atol=1e-6)
    sizes = np.linalg.norm(want @ basis, axis=0)
    np.testing.assert_allclose(sizes, np.linalg.svd(want)[1][: len(sizes)], rtol=1e-6)


def test_only_possible_passages_meet_the_subsequence(monkeypatch):
    """One word of great weight makes a passage near, but too few words of the item are there to confirm it."""
    item = " ".join(["rare", *(f"w{i}" for i in range(19))])
    items = D.read_items([(1, item, None)])
    known = D.Vocabulary(items)
    heavy = int(np.searchsorted(known.words, items[0].words[0]))
    idf = np.ones(len(known))
    idf[heavy] = 30.0
    query = (idf**2).astype(np.float32)
    length = np.sqrt(query.sum())
    share = ((idf**2)[:, None] / length).astype(np.float32)
    index = D.Index(items, known, np.array([0]), share, query, np.array([length], np.float32), 1)
    tried, plain = [], D.common_words
    monkeypatch.setattr(D, "common_words", lambda *x: tried.append(1) or plain(*x))
    assert index.search(words_of(pa.array(["rare w1 w2 and much else", None, ""]), plain=True)) == [] and not tried
    assert [x[:2] for x in index.search(words_of(pa.array(["x", f"so {item} it goes"]), plain=True))] == [(1, 0)] and tried


def test_sums_over_passages():
    rng = np.random.default_rng(2)
    at = np.array([0, 0, 130, 131, 131, 400])
    spots = np.sort(rng.choice(400, 150, replace=False))
    values, rows = rng.integers(0, 9, (7, 3)), rng.integers(0, 7, 150)
    passages = D.Passages(at, spots)
    want = np.zeros((passages.total, 3), dtype=int)
    for p in range(passages.total):
        text, begin, end = passages.span(p)
        inside = (spots >= at[text] + begin) & (spots < min(at[text] + end, at[text + 1]))
        want[p] = values[rows[inside]].sum(axis=0) if begin < at[text + 1] - at[text] else 0
    steps = [p for p in range(passages.total) if passages.span(p)[1] < at[passages.span(p)[0] + 1] - at[passages.span(p)[0]]]
    assert (passages.sums(values, rows)[steps] == want[steps]).all()
    assert (passages.sums(values[rows]) == passages.sums(values, rows)).all()
    assert D.Passages(np.array([0, 5]), np.zeros(0, int)).sums(np.zeros((0, 3))).sum() == 0
