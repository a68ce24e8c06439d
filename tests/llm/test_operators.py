"""Each operator against a brute-force version or an exact round trip, on the smallest tables and on hand-made rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import common, exact, language, linear, media, ngram_join, packing, piece_codec, privacy, queries, repeats, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "  a  b\x00c ", "▁x ▁", "日本語 🖍 é́ İΣς", "<s> <|endoftext|>a<0x41>", "a" * 3000, "\x1c!\x1c! x\xa0y z", "It's I'll don't", "A\n\tb\r\x0bc", "ﬁ ² ½ ☃"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="module")
def odd(spark):
    """Hand-made rows with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(ODD)], "doc_id bigint, text string, ids string, n bigint")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def components_of(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_bits_let_all_ids_through(spark):
    ids = spark.range(0, 3000, 7).toDF("k").unionByName(spark.createDataFrame([(None,)], "k bigint"))
    some = spark.range(5000).where(common.id_filter(ids, "k", 1 << 14)(F.col("id")))
    found = {r["id"] for r in some.collect()}
    assert set(range(0, 3000, 7)) <= found and len(found) < 700
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (7, "c"), (1, "d")], "id bigint, __id string")
    assert sorted(r["__id"] for r in common.without_ids(rows.withColumnRenamed("__id", "t"), spark.createDataFrame([(1,)], "__id bigint"), "id").withColumnRenamed("t", "__id").collect()) == ["b", "c"]


# -- 1 ------------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(texts):
    import sentencepiece

    model, lib = piece_codec.load(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in [*texts.values(), *(t or "" for t in ODD)]:
        ids, begins, ends = model.encode(text)
        assert ids.tolist() == lib.encode(text)
        assert model.decode(ids) == lib.decode(ids.tolist())
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(begins, ends, strict=True)) == raw
    for ids in ([300, 200, 201, 5], [3 + 0xC3, 3 + 0x28, 28705, 28705], [0, 1, 2, 1526]):
        assert model.decode(np.array(ids)) == lib.decode(ids)


def test_word_is_merged_once_whatever_closes_it(monkeypatch):
    import sentencepiece

    model, lib = piece_codec.PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    merged = []
    merge = model._merge
    monkeypatch.setattr(model, "_merge", lambda word: merged.append(word) or merge(word))
    ends = ["", ",", ".", "...", ".\"", "?!", ")", "&&&", "'", "%$", "://", "-", "\u2581."]
    for core in ("▁qwhatherei", "▁日本", "▁🖍", "▁C", "▁1", "▁", "▁x_", "▁(a"):
        text = " ".join(core[1:] + e for e in ends)
        ids, begins, ends_at = model.encode(text)
        assert ids.tolist() == lib.encode(text)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(begins, ends_at, strict=True)) == raw
    assert merged.count("▁qwhatherei") == 1 and not any("qwhatherei" in w for w in merged if w != "▁qwhatherei")


@pytest.mark.parametrize("most", [0, 3000, 1 << 24])
def test_word_is_merged_once_a_batch_however_little_is_remembered(monkeypatch, most):
    import sentencepiece

    model, lib = piece_codec.PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model.memo.most = most
    merged = []
    merge = model._merge
    monkeypatch.setattr(model, "_merge", lambda word: merged.append(word) or merge(word))
    for turn in range(3):
        batch = [t or "" for t in ODD] + [f"{t or ''} qwhatherei{'.' * (k % 3)} w{turn}x{k}" for k, t in enumerate(ODD * 20)]
        before = len(merged)
        for text, (ids, begins, ends) in zip(batch, model.encode_all(batch), strict=True):
            assert ids.tolist() == lib.encode(text)
            assert b"".join(text.encode()[a:b] for a, b in zip(begins, ends, strict=True)) == text.encode()
        assert len(set(merged[before:])) == len(merged) - before
        assert ("▁qwhatherei" in merged[before:]) == (turn == 0 or most < 1 << 24)
        assert model.memo.strings.nbytes + model.memo.lists.nbytes <= most or not len(model.memo.strings)
    assert list(model.encode_all([])) == []


def test_piece_query_projects_every_piece(spark, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r["spans_sha256"] for r in queries.op1_piece_codec(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    seen = 0
    for i, text in texts.items():
        pieces = lib.encode(text, return_type="proto").pieces
        if not text or "".join(p.surface for p in pieces) != text or any(p.begin == p.end for p in pieces):
            continue  # the library gives the bytes of one character other spans
        at = np.cumsum([0, *(len(p.surface.encode()) for p in pieces)])
        assert got[i] == hashlib.sha256(at[:-1].astype("<i8").tobytes() + at[1:].astype("<i8").tobytes()).hexdigest()
        seen += 1
    assert seen > len(texts) / 2


def test_character_map_is_walked_by_longest_prefix():
    # a double array with the keys "a" -> "x" and "ab" -> "yz"
    units = [0] * 512
    root, node_a, node_ab = 256, 0, 0
    units[0] = root << 10
    node_a = root ^ ord("a")
    below = node_a ^ 1
    units[node_a] = ord("a") | 1 << 8 | (1 << 10)
    units[below] = 0 | 1 << 31
    node_ab = below ^ ord("b")
    units[node_ab] = ord("b") | 1 << 8 | (2 << 10)
    units[node_ab ^ 2] = 2 | 1 << 31
    blob = np.array([len(units) * 4], "<u4").tobytes() + np.array(units, "<u4").tobytes() + b"x\0yz\0"
    charmap = piece_codec.CharacterMap(blob)
    assert charmap.longest(b"ab", 0) == (2, b"yz")
    assert charmap.longest(b"ac", 0) == (1, b"x")
    assert charmap.longest(b"ca", 0) == (0, b"")
    model = piece_codec.PieceModel(PIECES)
    model.charmap, model.squeeze = charmap, True
    norm, source = model.normalise(" ab  c ")
    assert norm == "▁yz▁c" and source.tolist() == [1, 1, 1, 3, 5, 6]


def test_encode_query(spark, odd, nothing, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = {r["doc_id"]: r for r in queries.op1_piece_codec(spark, SMALL).collect()}
    assert rows.keys() == texts.keys()
    for doc, text in texts.items():
        ids = lib.encode(text)
        assert rows[doc]["n_tokens"] == len(ids)
        assert rows[doc]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    coded = piece_codec.encode_documents(odd, PIECES)
    back = {r["doc_id"]: r["text"] for r in piece_codec.decode_documents(coded, PIECES).collect()}
    assert back == {i: lib.decode(lib.encode(t or "")) for i, t in enumerate(ODD)}
    assert piece_codec.encode_documents(nothing, PIECES).count() == 0


# -- 2 ------------------------------------------------------------------------------------------------------------------


def brute_links(texts, words, percent):
    def cut(text):
        parts = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        return {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)} if len(parts) >= words else {tuple(parts)} if parts else set()

    sets = {d: cut(t or "") for d, t in texts.items()}
    ids = sorted(d for d in sets if sets[d])
    pairs = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                pairs.append((a, b))
    return sets, components_of(pairs, sets)


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_join_finds_all_components(spark, words, percent):
    rnd = random.Random(words)
    base = [" ".join(rnd.choice("ab cd ef gh ij kl mn".split()) + str(rnd.randrange(9)) for _ in range(n)) for n in (1, 2, 8, 9, 10, 30, 60, 120)]
    texts = {}
    for i in range(400):
        parts = rnd.choice(base).split()
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 3, 6))):
            parts[rnd.randrange(len(parts))] = rnd.choice(("zz", "Yy", parts[0]))
        texts[i] = rnd.choice((" ", "\n ", "\t")).join(parts)
    texts |= {500: None, 501: "", 502: " \n", 503: "one", 504: "ONE"}
    sets, want = brute_links(texts, words, percent)
    df = spark.createDataFrame([(k, v, "s") for k, v in texts.items()], "doc_id bigint, text string, token string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(df, words, percent).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in texts}
    kept = {r["doc_id"] for r in ngram_join.keep_one(df, words, percent).collect()}
    assert kept == {d for d in texts if want[d] == d}


def test_join_tells_rows_of_one_id_apart(spark):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u"), (2, "k l m n"), (None, "k l m n"), (None, "v w x y z"), (3, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in ngram_join.link_components(df, 3, 90).select("doc_id", "n_shingles", "component_id").collect())
    assert got == Counter([(1, 4, 1), (1, 4, 1), (2, 4, 1), (2, 2, 2), (None, 2, 2), (None, 3, None), (3, 0, 3), (None, 0, None)])
    kept = Counter(tuple(r) for r in ngram_join.keep_one(df, 3, 90).collect())
    assert kept == Counter([rows[0], rows[1], rows[3], rows[5], rows[6], rows[7]])


def test_join_query(spark, texts, nothing):
    sets, want = brute_links(texts, 3, 90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op2_ngram_join(spark, SMALL).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in texts}
    assert ngram_join.link_components(nothing).count() == 0


# -- 3 ------------------------------------------------------------------------------------------------------------------


def test_patterns_cover_the_histogram():
    rng = np.random.default_rng(3)
    for counts in (np.zeros(16, int), rng.integers(0, 40, 16), rng.integers(0, 9, 256), np.eye(1, 64, 40, dtype=int)[0] * 1000):
        patterns = packing.solve_patterns(counts)
        sizes = np.arange(1, len(counts) + 1)
        assert all((p * sizes).sum() <= len(counts) for p, _ in patterns)
        assert (sum((p * n for p, n in patterns), np.zeros(len(counts), int)) == counts).all()
    # greedy filling takes a bin of two sixes' rests here; column generation finds the exact fit
    counts = np.zeros(20, int)
    counts[[9 - 1, 7 - 1, 6 - 1, 4 - 1]] = 60, 60, 60, 60  # 9 + 7 + 4 fill a bin; 6 + 6 + 6 leave little
    assert sum(n for _, n in packing.solve_patterns(counts)) <= 60 + 21


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    pieces, used = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        used[r["sequence_id"]].append(r)
    assert pieces.keys() == texts.keys()
    for doc, own in pieces.items():
        ids = [*tok.encode(texts[doc], add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and len(part) == r["length"] and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in used.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return sum(r["length"] for r in rows) / (2048 * len(used))


def test_packing_remembers_few_bytes():
    """Of 240,000 words a dict of bytes took over 40 MB in each worker."""
    import tracemalloc

    import pyarrow as pa
    from tokenizers import Tokenizer

    letters, lib = np.array([*"abcdefghijklmnopqrstuvwxyz"]), Tokenizer.from_file(WORDS)
    rng = np.random.default_rng(5)
    words = packing.WordTokens(WORDS)
    pool = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        for turn in range(6):
            made = ["".join(w) for w in letters[rng.integers(0, 26, (40_000, 9))]]
            texts = [*(t or "" for t in ODD), *(f" {' '.join(made[k : k + 400])},\tthe End?! " for k in range(0, len(made), 400))]
            for text, ids in zip(texts, words.ids(pa.array(texts)), strict=True):
                if turn in (0, 5):
                    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
        del made, texts, text, ids
        assert tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - pool < 3 * packing.MEMO_BYTES
    finally:
        tracemalloc.stop()


def test_packing_query(spark, texts, odd, nothing):
    assert check_packing(queries.op3_packing(spark, SMALL).collect(), texts) > 0.97
    check_packing(packing.pack(odd, WORDS).collect(), {i: t or "" for i, t in enumerate(ODD)})
    assert packing.pack(nothing, WORDS).count() == 0


# -- 4 ------------------------------------------------------------------------------------------------------------------


def test_linear_model_against_gradient_descent():
    rng = np.random.default_rng(1)
    x = linear.Sparse([np.flatnonzero(r).tolist() for r in rng.random((200, 5)) < 0.4], 5)
    beside = rng.random((200, 1))
    y = (rng.random(200) < 0.2 + 0.6 * x.dense()[:, 0]).astype(float)
    full = np.hstack([x.dense(), beside, np.ones((200, 1))])
    w = np.zeros(7)
    for _ in range(20_000):
        w -= 0.01 * (full.T @ (1 / (1 + np.exp(-full @ w)) - y) + np.append(np.full(6, 0.5), 1e-6) * w)
    assert np.abs(toxicity.fit_linear(x, beside, y) - w).max() < 1e-3


def test_chain_feeds_out_of_fold_predictions():
    rng = np.random.default_rng(4)
    x = rng.random((300, 6)) < 0.3
    first = (x[:, 0] & ~x[:, 1]).astype(float)
    y = np.stack([first, np.maximum(first, x[:, 2])], axis=1)
    rows = linear.Sparse([np.flatnonzero(r).tolist() for r in x], 6)
    chain = toxicity.fit_chain(rows, y, ["a", "b"], {}, np.arange(300) % 5)
    assert [len(w) for w in chain.weights] == [7, 8]
    p = chain.probabilities(rows)
    assert ((p[:, 1] > 0.5) == (y[:, 1] > 0.5)).mean() > 0.97


def test_kinds_are_learned():
    rows = linear.Sparse([[k % 3 * 2, k % 3 * 2 + 1] for k in range(30)] + [[], [0]], 6)
    y = np.array([1.0] * 31 + [0.0])
    kinds = toxicity.kinds_of(rows, y)
    assert kinds[30:].sum() == 0 and (kinds[:30].sum(axis=1) == 1).all()
    assert len({tuple(kinds[k]) for k in range(3)}) == 3 and all((kinds[k] == kinds[k % 3]).all() for k in range(30))


def test_toxic_documents_are_found_held_out(spark):
    """All labelled documents, each scored by a chain that was fitted to the others."""
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    hits = toxic = wrong = clean = 0
    for fold in range(2):
        here = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(8)) == fold
        chain = toxicity.train(docs, labels.where(~here))
        rows = toxicity.score(docs, chain).join(labels.where(here).select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
        hits += sum(r["toxic"] for r in rows if r["y"])
        toxic += sum(r["y"] for r in rows)
        wrong += sum(r["toxic"] for r in rows if not r["y"])
        clean += sum(not r["y"] for r in rows)
    assert wrong <= 0.01 * clean and hits >= 0.85 * toxic, (hits, toxic, wrong, clean)


def test_toxicity_edge_cases(spark, odd, nothing):
    labels = spark.createDataFrame([(0, 1), (0, None), (99, 1)], "doc_id bigint, toxic int")
    none = toxicity.train(odd, labels.where("false"))
    assert {r["p_toxic"] for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.reject(odd, none).count() == len(ODD)
    assert {r["p_toxic"] for r in toxicity.score(odd, toxicity.train(odd, labels)).collect()} == {1.0}
    assert toxicity.score(nothing, none).count() == 0


# -- 5 ------------------------------------------------------------------------------------------------------------------


def brute_exact(texts):
    groups = defaultdict(list)
    for d, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    return {d: (min(g), len(g), d == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}


def test_naming_tells_texts_apart(spark, nothing):
    rnd = random.Random(5)
    texts = {i: "".join(rnd.choice("ab ") for _ in range(rnd.choice((0, 1, 3, 4, 5, 8, 9, 16, 17, 40)))) for i in range(300)}
    texts |= {900: None, 901: "", 902: "é" * 20, 903: "é" * 20, 904: "é" * 19 + "e"}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id bigint, text string, name int")
    names = defaultdict(set)
    want = brute_exact(texts)
    for r in exact.name_texts(df, block=4).collect():
        names[r["blocks"], r["name"]].add(r["doc_id"])
    groups = defaultdict(set)
    for d, w in want.items():
        groups[w[0]].add(d)
    assert sorted(map(sorted, names.values())) == sorted(map(sorted, groups.values()))
    assert {r["doc_id"] for r in exact.keep_first(df).collect()} == {d for d in texts if want[d][2]}
    assert exact.duplicates(nothing).count() == 0


@pytest.mark.parametrize("parts", [2, 7])
def test_hashes_that_collide_and_repeated_rows(spark, parts):
    rnd = random.Random(7)
    rows = [(rnd.choice((None, *range(60))), rnd.choice(("a b", "a  b", "z", "", None, "abcdefgh" * 3, "abcdefgh" * 2 + "x", "hgfedcba"))) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    want = Counter()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            want[i, keep, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    for hashed in (F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(2))):
        assert Counter(map(tuple, exact.duplicates(df, hashed=hashed).collect())) == want
    kept = Counter((r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in exact.keep_first(df).collect())
    assert kept == {(min((i for i in ids if i is not None), default=None), t): 1 for t, ids in groups.items()}


def test_names_do_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id doc_id", "repeat(concat('t', id % 90), cast(id % 40 as int)) text")
    a, b = ({r["doc_id"]: (r["blocks"], r["name"]) for r in exact.name_texts(df.repartition(n), block=8).collect()} for n in (1, 9))
    assert a == b and len(set(a.values())) == df.select("text").distinct().count()


def test_exact_query(spark, texts):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in queries.op5_exact_dedup(spark, SMALL).collect()}
    assert got == brute_exact(texts)


# -- 6 ------------------------------------------------------------------------------------------------------------------


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(4000).selectExpr("concat('host', id) host", "id % 37 = 0 listed")
    cascade = url_filter.Cascade.build(keys, "host", "listed")
    assert len(cascade.levels) > 1
    assert keys.where(cascade.holds(F.col("host")) != F.col("listed")).count() == 0
    empty = url_filter.Cascade.build(keys.where("not listed"), "host", "listed")
    assert keys.where(empty.holds(F.col("host"))).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.org/es/1", "https://x.example.org/en/12?q", "https://example.org", "http://b.com/fr/x#y", "http://com/de/", "http://com.net/de/", "http://notexample.org/es/",
            "http://spam-farm.example.net/x", "http://cheap-pills.com/en", "nothing", None, "", "http://", "x://h?a/b", "http://cheap-pills.com/fr/", "http://a.com/de/://z.org/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    keys = spark.createDataFrame([("Spam-Farm.example.net",), ("cheap-pills.com",), ("cheap-pills.com",), (None,), ("",), ("elsewhere.com",)], "key string")
    want = [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("x.example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "", None, "allow"), ("b.com", "/fr/x", "com/fr/", "allow"),
        ("com", "/de/", "com/de/", "block"), ("com.net", "/de/", None, "allow"), ("notexample.org", "/es/", "org/", "allow"), ("spam-farm.example.net", "/x", None, "block"),
        ("cheap-pills.com", "/en", None, "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"), ("cheap-pills.com", "/fr/", "com/fr/", "allow"),
        ("a.com", "/de/://z.org/", "com/de/", "block"),
    ]
    for most in (url_filter.MAX_LISTED, 0):  # by the cascade, and by the join beyond its bound
        assert [tuple(r)[1:] for r in url_filter.judge(df, keys, most=most).orderBy("page_id").collect()] == want
    assert url_filter.judge(df.where("false"), keys).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df.where("page_id in (7, 8)"), keys.where("false")).collect()} == {"allow"}


def test_url_cascade_and_join_agree(spark):
    pages = spark.range(6000).selectExpr("id page_id", "concat('http://', if(id % 3 = 0, 'www.', ''), 'h', id % 2000, '.net/p') url")
    keys = spark.range(0, 2000, 11).selectExpr("concat('h', id, '.net') key")
    a, b = (url_filter.judge(pages, keys, most=most) for most in (url_filter.MAX_LISTED, 10))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert a.where("verdict = 'block'").count() == 6000 * 182 // 2000


# -- 7 ------------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark, texts, odd, nothing):
    rows = {r["doc_id"]: r for r in queries.op7_media_columns(spark, SMALL).collect()}
    for doc, text in texts.items():
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[doc]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    stored = media.store_documents(odd)
    for r in media.media_columns(stored).collect():
        raw = (ODD[r["doc_id"]] or "").encode()
        n = -(-max(len(raw), 1) // 64)
        assert r["error"] is None and r["codec"] == "raw " and r["duration_s"] == n * 64 / 8000
        assert len(r["keyframes"]) == -(-n // 16) and all(k["end"] - k["begin"] == 64 for k in r["keyframes"])
    broken = spark.createDataFrame([(1, b"\0\0\0\x10moov\0\0\0\xffx"), (2, None), (3, b""), (4, b"\0\0\0\x04free")], "doc_id bigint, media binary")
    assert all(r["error"] and r["codec"] is None for r in media.media_columns(broken).collect())
    assert media.store_documents(nothing).count() == 0
    for doc, text in texts.items():
        n = rows[doc]["payload_bytes"] // 64
        at = [k["begin"] for k in rows[doc]["keyframes"]]
        assert len(at) == -(-n // 16) and all(b - a == 16 * 64 for a, b in zip(at, at[1:], strict=False))


def _box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_nested_boxes_tracks_and_false_counts(spark):
    data = media.write_container(bytes(64 * 40))
    at = next(body for kind, _, body, _ in media.walk(data) if kind == b"trak")
    end = next(end for kind, _, _, end in media.walk(data) if kind == b"trak")
    track = data[at - 8 : end]
    where = data.index(b"stss") - 4
    (size,) = struct.unpack_from(">I", data, where)
    every = track.replace(data[where : where + size], _box(b"free", bytes(size - 8)))  # no key table: each sample is a key frame
    both = _box(b"moov", every, track)
    base = len(data) - len(both) - 64 * 40
    padded = _box(b"free", bytes(max(0, base - 8))) + both + data[-64 * 40 :]
    tracks = media.read_tracks(padded)
    assert [len(t["keys"]) for t in tracks] == [40, 3] and len(media.read_container(padded)["keys"]) == 40
    deep = b""
    for _ in range(20_000):
        deep = _box(b"udta", deep)
    assert sum(1 for _ in media.walk(deep)) == 20_000
    many = data.replace(struct.pack(">II", 64, 40), struct.pack(">II", 64, 2**32 - 1))
    wrong = bytearray(data)
    key = data.index(b"stss") + 12
    wrong[key : key + 4] = bytes(4)  # key frames are counted from 1
    far = data.replace(_box(b"stco", bytes(4), struct.pack(">II", 1, len(data) - 64 * 40)), _box(b"stco", bytes(4), struct.pack(">II", 1, len(data) * 2)))
    rows = spark.createDataFrame([(1, many), (2, deep), (3, bytes(wrong)), (4, far), (5, padded)], "doc_id bigint, media binary")
    got = {r["doc_id"]: r for r in media.media_columns(rows).collect()}
    assert all(got[i]["error"] and got[i]["keyframes"] is None for i in (1, 2, 3, 4))
    assert got[5]["error"] is None and [len(t["keyframes"]) for t in got[5]["tracks"]] == [40, 3] and len(got[5]["keyframes"]) == 40


# -- 8 ------------------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_base_spans_follow_the_patterns(texts):
    rnd = random.Random(8)
    made = ["".join(rnd.choice(["a@", "@b.c", "x.y", "@", ".", "-", " ", "+1", "4539 1488", "0343 6467", "1.2.3.4", "256", "+49 (30) 123-4567", "é"]) for _ in range(12)) for _ in range(3000)]
    for text in [*texts.values(), *made, "4539148803436467", "a@b@c.de", "x@y.z@u.v", "1.2.3.4.5", "0255.1.1.1", "+12345678 9"]:
        spans = privacy.base_spans(text)
        assert [s[1:] for s in spans if s[0] == "email"] == [m.span() for m in EMAIL.finditer(text)]
        assert [s[1:] for s in spans if s[0] == "ip"] == [m.span() for m in privacy.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert spans == sorted(spans, key=lambda s: (privacy.KINDS.index(s[0]), s[1]))
    assert ("card", 0, 16) in privacy.base_spans("4539148803436467") and not privacy.base_spans("4539148803436468")


def test_disclosing_terms(spark, nothing):
    def filler(i):
        return " ".join(random.Random(i * 10 + k).choice(["river", "stone", "walks", "morning", "paper", "green"]) for k in range(12))

    rows = [(i, f"{filler(i)} lighthouse mails keeper@sea.example at {filler(i + 500)}", "t") for i in range(6)]
    rows += [(i, f"{filler(i)} nothing here {filler(i + 500)}", "t") for i in range(6, 80)] + [(90, None, "t"), (91, "", "t"), (92, "keeper@sea.example", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, term string")
    found = {r["doc_id"]: r for r in privacy.find_spans(df).collect()}
    assert found.keys() == {r[0] for r in rows}
    for i in range(6):
        hit = {rows[i][1][s["begin"] : s["end"]]: s["kind"] for s in found[i]["terms"]}
        assert hit.get("lighthouse") == "remove" and "river" not in hit
    assert all(not found[i]["base"] and not found[i]["terms"] for i in range(6, 80))
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(df).collect()}
    assert "keeper@" not in "".join(t or "" for t in clean.values()) and "lighthouse" not in "".join(t or "" for t in clean.values())
    assert clean[90] is None and clean[92] == "[EMAIL]" and all(clean[i] == rows[i][1] for i in range(6, 80))
    assert privacy.find_spans(nothing).count() == 0


def test_terms_of_an_entity_seen_once(spark):
    """The term stands far from its entity, and once more in a document without it."""
    common = "the river and the stone by the green morning paper " * 3
    rows = [(0, f"Kestrelford {common} to one@sea.example {common} kestrelford"), (1, f"{common} Kestrelford")]
    for n in (30, 300, 30_000):  # it is the same in corpora of any size
        df = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(spark.range(2, n).selectExpr("id doc_id", f"concat('{common} ', id) text"))
        found = {r["doc_id"]: [(s["kind"], s["begin"], s["end"]) for s in r["terms"]] for r in privacy.find_spans(df).where("size(terms) > 0").collect()}
        assert found == {i: [("generalise", m.start(), m.end()) for m in re.finditer("kestrelford", text.lower())] for i, text in rows}
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(df).where("doc_id < 2").collect()}
    assert "estrelford" not in clean[0] + clean[1] and clean[1].endswith(" [TERM]")


def test_copies_do_not_change_disclosing_terms(spark):
    common = "the river and the stone by the green morning paper " * 3
    own = [(i, f"Kestrelford {common} to one@sea.example {i}") for i in range(3)]
    df = spark.createDataFrame(own, "doc_id bigint, text string").unionByName(spark.range(3, 2_000).selectExpr("id doc_id", f"concat('{common} ', id) text"))
    # Many copies of a text with the entity, of one with the term and of one with neither.
    copied = [(10_000 + i, own[0][1]) for i in range(40)] + [(20_000 + i, own[1][1]) for i in range(2)] + [(30_000 + i, f"{common} 7") for i in range(300)]
    more = df.unionByName(spark.createDataFrame(copied, "doc_id bigint, text string"))

    def terms(frame):
        return {r["doc_id"]: r["terms"] for r in privacy.find_spans(frame).collect()}

    plain, with_copies = terms(df), terms(more)
    assert [s["kind"] for s in plain[0]] == ["remove"] and all(with_copies[i] == t for i, t in plain.items())
    assert all(with_copies[i] == plain[0] for i, _ in copied[:40]) and all(with_copies[i] == plain[1] for i, _ in copied[40:42])
    rows = privacy.find_base(more)
    assert rows.select("key").distinct().count() == df.count()


def test_planted_terms_are_found_and_others_stay(spark):
    """Of terms planted beside an entity in one to five documents, and in as many or fewer others, all that leave few bits are found."""
    rnd = random.Random(12)
    made = lambda n: ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(n)]
    names, lexicon = list(dict.fromkeys(made(60))), made(300)
    texts = [" ".join(rnd.choice(lexicon) for _ in range(80)) for _ in range(1500)]
    want = {}
    for k, name in enumerate(names):
        own, other = 1 + k % 5, k // 5 % 3
        for i in range(own + other):
            texts[20 * k + i] += f" {name}" + f" mail p{k}@sea.example" * (i < own)
        d = own + other
        bound = (own / d + 1 / (2 * d) - (own / d * (1 - own / d) / d + 1 / (4 * d * d)) ** 0.5) / (1 + 1 / d)
        if d > 1 and bound >= 2**-2.3:
            want[name] = "remove" if bound >= 2**-0.7 else "generalise"
    assert len(want) > 40 and set(want.values()) == {"remove", "generalise"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(texts[r["doc_id"]][s["begin"] : s["end"]], s["kind"]) for r in privacy.find_spans(df).collect() for s in r["terms"]}
    assert got == set(want.items())


def test_privacy_query(spark, texts):
    for r in queries.op8_privacy(spark, SMALL).collect():
        spans = privacy.base_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)
        count = Counter(k for k, _, _ in spans)
        assert [r[f"n_{k}"] for k in privacy.KINDS] == [count[k] for k in privacy.KINDS]


# -- 9 ------------------------------------------------------------------------------------------------------------------


def test_automaton_parses_like_brute_force():
    rnd = random.Random(9)
    text = [rnd.randrange(3) for _ in range(200)]
    grams = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, min(len(text), i + 30) + 1)}
    automaton = language.Automaton(np.array(text))
    for n in (1, 2, 7, 25):
        rows = [[rnd.randrange(4) for _ in range(n)] for _ in range(20)]
        got = automaton.phrases([automaton.classed(np.array([r[k] for r in rows])) for k in range(n)], 20)
        for r, g in zip(rows, got, strict=True):
            count, cur = 1, ()
            for c in r:
                if (*cur, c) in grams:
                    cur = (*cur, c)
                else:
                    count, cur = count + 1, (c,) if (c,) in grams else ()
            assert g == count


def test_scripts_with_thousands_of_letters():
    rnd = random.Random(9)
    # languages that share most of their letters, some of them rarer than the dense table holds, and differ in their words
    letters = {"ja": range(0x4E00, 0x5600), "zh": range(0x4F00, 0x5700), "ko": range(0xAC00, 0xB400), "ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA)}
    lexicon = {k: ["".join(chr(rnd.choice(v)) for _ in range(rnd.randrange(1, 4))) for _ in range(900)] for k, v in letters.items()}
    write = lambda k, n: " ".join(rnd.choice(lexicon[k]) for _ in range(n))
    model = language.build({k: [write(k, 4000 if k in ("ru", "el") else 1500)] for k in letters})
    assert len(model["zh"].keys)
    wanted = [k for k in letters for _ in range(20)]
    got, scores = language.predict(model, [write(k, 30) for k in wanted])
    assert got == wanted and min(scores) > 0
    for k in ("zh", "ru"):
        sample = write(k, 300)
        own = language.Automaton(np.array([ord(c) if c != " " else 0 for c in sample]))
        texts = [sample[50:70], write(k, 20), "".join(map(chr, (letters[k][0], 0x10400)))]
        for t in texts:
            codes = language.symbols(t)
            count, cur, plain = 1, "", sample.replace(" ", "\0")
            for letter in map(chr, codes):
                if cur + letter in plain:
                    cur += letter
                else:
                    count, cur = count + 1, letter if letter in plain else ""
            c = own.classed(codes)
            assert own.phrases([c[j : j + 1] for j in range(len(c))], 1)[0] == count


def test_a_language_of_one_document_is_learned_from_all_of_it(spark):
    text = " ".join(f"wort{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(3000))
    df = spark.createDataFrame([(1, text, "de"), (2, None, "de"), (3, "abc", None), (4, "!!", "en")], "doc_id bigint, text string, lang string")
    found = language.samples(df)
    assert found.keys() == {"de"} and len(found["de"]) > 45 and sum(map(len, found["de"])) <= language.SALTS * language.SAMPLE_PIECE
    assert all(p in text for p in found["de"])
    long = spark.createDataFrame([(1, text * 30)], "doc_id bigint, text string")
    assert [r["lang_pred"] for r in language.identify(long, language.build({**found, "en": ["the cat"]})).collect()] == ["de"]


def test_language_held_out(spark, nothing):
    path = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.op9_language(spark, path).collect()
    assert {r["doc_id"] for r in rows} == truth.keys()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(odd, nothing):
    model = language.build({"en": ["the cat sat on the mat " * 5], "de": ["der hund und die katze " * 5], "xx": ["123"]})
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0)
    assert all(v[0] in ("en", "de", "und") for v in got.values())
    assert language.predict(language.build({}), ["abc"]) == (["und"], [0.0])
    assert language.samples(nothing.withColumnRenamed("ids", "lang")) == {}
    assert language.identify(nothing, model).count() == 0


# -- 10 -----------------------------------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    raw = {d: (t or "").encode() for d, t in texts.items()}
    seen = Counter(r[i : i + length] for r in raw.values() for i in range(len(r) - length + 1))
    out = {}
    for d, r in raw.items():
        mark = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(mark)))
        kept = bytes(b for b, m in zip(r, mark, strict=True) if not m)
        out[d] = (len(r), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, texts, monkeypatch):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op10_repeats(spark, SMALL).collect()}
    assert got == brute_repeats(texts, 200)


@pytest.mark.parametrize("group", [repeats.GROUP, 2])
def test_repeats_of_all_kinds(spark, group, nothing):
    rnd = random.Random(10)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = [word(n) for n in (199, 200, 201, 260, 700)]
    texts = {i: word(rnd.randrange(150)) + rnd.choice(shared) + word(rnd.randrange(300)) + rnd.choice(shared)[rnd.randrange(60) :] for i in range(60)}
    texts |= {100: None, 101: "", 102: "x" * 150, 103: "x" * 900, 104: "ab" * 400, 105: word(500) + "é" * 150, 106: word(10) + "é" * 150, 107: texts[3], 108: texts[3]}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id bigint, text string, place int")
    monkey = repeats.repeated_stretches(repeats.id_and_text(df, "doc_id", "text"), group=group).collect()
    marks = {d: bytearray(len((t or "").encode())) for d, t in texts.items()}
    for r in monkey:
        marks[r["doc_id"]][r["begin"] : r["end"]] = b"\1" * (r["end"] - r["begin"])
    want = brute_repeats(texts, 200)
    assert {d: sum(m) for d, m in marks.items()} == {d: w[1] for d, w in want.items()}
    if group == repeats.GROUP:
        got = {r["doc_id"]: tuple(r)[1:5] for r in repeats.remove_repeats(df).collect()}
        assert got == want
        assert repeats.remove_repeats(nothing).count() == 0


def test_repeats_tell_rows_of_one_id_apart(spark):
    rnd = random.Random(4)
    a, b, c = ("".join(rnd.choice("abcdefgh ") for _ in range(600)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a), (None, c), (None, c + "!"), (3, None), (3, "x" + c[:300])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_repeats(dict(enumerate(t for _, t in rows)), 200)
    got = Counter((r["doc_id"], *tuple(r)[1:5]) for r in repeats.remove_repeats(df).collect())
    assert got == Counter((d, *want[k]) for k, (d, _) in enumerate(rows))


@pytest.mark.parametrize("length", [8, 13, 40])
def test_suffixes_equal_brute_force(length):
    rnd = random.Random(length)
    for _ in range(20):
        raw = "".join(rnd.choice(("ab", "a", "abaab" * 8)) for _ in range(60)).encode()
        at = np.array(sorted(rnd.sample(range(len(raw) - length), 50)))
        group = np.sort(np.array([rnd.randrange(3) for _ in at]))
        seen = Counter((g, raw[i : i + length]) for g, i in zip(group, at, strict=True))
        got = repeats.repeated_suffixes(np.frombuffer(raw, np.uint8), at, group, length)
        assert got.tolist() == [seen[g, raw[i : i + length]] > 1 for g, i in zip(group, at, strict=True)]


def test_long_texts_are_parsed_in_segments(monkeypatch):
    raw = bytes(random.Random(1).randrange(97, 105) for _ in range(5000))
    whole = {(a, z): t for a, z, t in repeats.runs(raw)}
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    cut = list(repeats.runs(raw))
    place = {p: t for (a, z), t in whole.items() for p in range(a, z + 1)}
    assert all(place[p] == t for a, z, t in cut for p in range(a, z + 1)) and cut[-1][1] == len(raw) - 200
