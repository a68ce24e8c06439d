"""Near copies by min-max hashing, collocations and token alignment against brute-force versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import alignment, collocations, min_max, ngram_join, queries

from .test_operators import ODD, SMALL, brute_links

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def test_files_in_fragments_are_refused():
    from folioscope.llm import media

    whole = media.write_container(bytes(64))
    assert len(media.read_tracks(whole)) == 1
    with pytest.raises(ValueError, match="fragments"):
        media.read_tracks(whole + media._box(b"moof", media._box(b"traf", b"")))


# -- 11 -----------------------------------------------------------------------------------------------------------------


def test_signatures_are_unbiased_and_vary_less_than_least_hashes():
    """Over many pairs of sets, the mean estimate is the similarity, and its variance below that of as many independent values."""
    rng = np.random.default_rng(2)
    for both, own in ((60, 20), (17, 3), (300, 60)):
        want, found = both / (both + 2 * own), []
        for _ in range(300):
            s = np.unique(rng.integers(0, 2**64, both + 2 * own + 5, dtype=np.uint64))
            rng.shuffle(s)
            x, y = min_max.signature(s[: both + own]), min_max.signature(np.concatenate((s[:both], s[both + own : both + 2 * own])))
            found.append(min_max.estimate(x, y))
        independent = want * (1 - want) / (2 * min_max.PERMUTATIONS)
        assert abs(np.mean(found) - want) < 4 * (independent / 300) ** 0.5
        assert np.var(found) < 1.1 * independent
    s = np.arange(5000, dtype=np.uint64)
    parts = np.stack([min_max.signature(s[:3000]).reshape(-1, 2), min_max.signature(s[3000:]).reshape(-1, 2)])
    whole = min_max.signature(s).reshape(-1, 2)
    assert (whole[:, 0] == parts[..., 0].min(0)).all() and (whole[:, 1] == parts[..., 1].max(0)).all()


def test_last_round_meets_by_shingles_once(spark, monkeypatch):
    """A pair that shares several bands meets once for each rare shingle, and marks tell long sets apart that are not similar."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(1200)]

    def changed(n):
        out = list(base)
        for i in rnd.sample(range(len(out)), n):
            out[i] = f"x{rnd.random()}"
        return " ".join(out)

    docs = spark.createDataFrame([(i, changed(28)) for i in range(12)], "doc_id bigint, text string")
    seen = []

    def spied(rows, narrowed, *rest):
        open_rows = rows.drop("degree").withColumn("comp", F.col("doc_id"))
        found = narrowed(open_rows)
        finer, agreed = found if isinstance(found, tuple) else (found, lambda pairs: pairs)
        seen.append((open_rows, finer, agreed))
        return ngram_join.resolved(rows, narrowed, *rest)

    monkeypatch.setattr(min_max, "resolved", spied)
    texts = {r["doc_id"]: set(ngram_join.shingles(r["text"], 3).tolist()) for r in docs.collect()}
    got = {r["doc_id"]: r["component_id"] for r in min_max.near_copies(docs, words=3, percent=85).collect()}
    assert got == {i: i for i in texts}
    ((open_rows, finer, agreed),) = seen
    assert open_rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] > 1
    assert finer.groupBy("doc_id", "pos").count().agg(F.max("count")).first()[0] == 1
    met = finer.alias("m").join(finer.alias("h"), "token").where(F.col("m.doc_id") < F.col("h.doc_id"))
    assert met.count() and not met.where(ngram_join.passes("m", "h", 85, True)).count()
    bands = {}
    for r in open_rows.collect():
        bands.setdefault(r["doc_id"], set()).add(r["token"])
    every = [(a, b) for a in bands for b in bands if a < b]
    told = {(r["a"], r["b"]) for r in agreed(spark.createDataFrame(every, "a bigint, b bigint")).collect()}
    assert told == {(a, b) for a, b in every if bands[a] & bands[b]}


def test_bands_find_similar_sets():
    rng = np.random.default_rng(6)
    for size in (6, 20, 400):
        for _ in range(200):
            s = np.unique(rng.integers(0, 2**64, size + size // 6, dtype=np.uint64))
            rng.shuffle(s)
            x, y = (min_max.signature(v) for v in (s[:size], s[len(s) - size :]))
            assert np.intersect1d(min_max.bands(x), min_max.bands(y)).size or len(s) > size / 0.8


@pytest.mark.parametrize("words,percent,told_apart", [(3, 85, False), (5, 80, True)])
def test_near_copies_equal_brute_force(spark, words, percent, told_apart):
    rnd = random.Random(words)
    base = [" ".join(rnd.choice("ab cd ef gh ij kl mn".split()) + str(rnd.randrange(9)) for _ in range(n)) for n in (1, 2, 7, 8, 10, 30, 60, 120, 2500)]
    rows = []
    for i in range(350):
        parts = rnd.choice(base).split()
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 3, 6))):
            parts[rnd.randrange(len(parts))] = rnd.choice(("zz", "Yy", parts[0]))
        rows.append((i, rnd.choice((" ", "\n ", "\t")).join(parts)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE")]
    odd = [(3, "a row of an id that is there already, and like no other"), (None, rows[0][1]), (None, None), (7, rows[8][1])]
    frame = rows + odd if told_apart else rows
    texts = dict(enumerate(t for _, t in frame))
    sets, top = brute_links(texts, words, percent)
    groups = defaultdict(list)
    for k in texts:
        groups[top[k]].append(k)
    least = {k: min((frame[j][0] for j in groups[top[k]] if frame[j][0] is not None), default=None) for k in texts}
    df = spark.createDataFrame([(k, v, "s") for k, v in frame], "doc_id bigint, text string, token string")
    found = min_max.near_copies(df, words, percent).collect()
    assert Counter(tuple(r) for r in found) == Counter((frame[k][0], len(sets[k]), least[k]) for k in texts)
    if told_apart:
        kept = Counter((r["doc_id"], r["text"]) for r in min_max.keep_one(df, words, percent).collect())
        assert sum(kept.values()) == len(groups) and all(any(frame[k] in kept for k in g) for g in groups.values())
    assert min_max.near_copies(df.where("false")).count() == 0


def test_near_copy_query(spark, texts):
    sets, want = brute_links(dict(texts), 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op11_min_max(spark, SMALL).collect()}
    assert got == {d: (len(sets[d]), want[d], want[d] == d) for d, _ in texts}
    with pytest.raises(ValueError):
        min_max.near_copies(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), percent=50)


# -- 12 -----------------------------------------------------------------------------------------------------------------


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_collocations(rows, least, longest, inside, first):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= inside * a for b in longer):
                continue
            score, k = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, n, p.decode(), -a, x, y, total[lang], -score) for n, (score, a, p, x, y) in enumerate(sorted(kept)[:first], 1)]
    return sorted(out)


def test_collocations_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["the", "old", "House", "a", "b", "x\x00y", "é", "日本", "-", "'"]
    rows = [("".join(rng.choice(words) + rng.choice([" "] * 9 + ["\t", "  ", ". ", ",", "\n", "\r"]) for _ in range(rng.choice([1, 3, 40, 400]))), rng.choice(["en", "de", None, "und"])) for _ in range(60)]
    rows += [(None, "en"), ("", "fr"), (" \t\n", "en"), ("the old house " * 500, "en"), ("the old house " * 500, "en"), ("...", None)]
    df = spark.createDataFrame([(1, t, g, "x", "y") for t, g in rows], "doc_id bigint, text string, lang string, phrase string, n string")
    for least, longest, first in ((10, 3, 2000), (3, 4, 25)):
        found = collocations.collocations(df.repartition(5), least, longest, 50, first)
        got = sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == brute_collocations(rows, least, longest, 50, first)
    assert collocations.collocations(df.where("false")).count() == 0


def test_full_bits_lose_no_phrase(spark, texts):
    """A table of bits so small that it lets everything through gives the same."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    for bits in (64, 1 << 20):
        _, levels = collocations.frequent_phrases(df, 10, 3, bits=bits)
        assert [lv.count() for lv in levels] == [collocation_sizes(df, k) for k in (1, 2, 3)]


def collocation_sizes(df, k):
    count = Counter()
    for r in df.select("text", "lang").collect():
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r["text"])):
            w = re.findall(r"[^\x20\x09]+", piece)
            count.update((r["lang"], *w[i : i + k]) for i in range(len(w) - k + 1))
    return sum(n >= 10 for n in count.values())


def test_products_beyond_64_bits_are_exact(spark):
    a, left, right = 3_037_000_499 * 5, 3_037_000_499 * 7 + 1, 3_037_000_499 * 11 + 3
    level = lambda rows: spark.createDataFrame(rows, "lang string, phrase string, f bigint")
    (row,) = collocations.scored([level([("e", "x", left), ("e", "y", right)]), level([("e", "x y", a)])]).collect()
    assert row["score"] == 1000000 * a * a // (left * right) and (row["l"], row["r"]) == (left, right)


def test_collocation_sql_agrees(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    got = queries.QUERIES["op12_collocations"](spark, SMALL).toPandas()
    want = con.sql(queries.ORACLES["op12_collocations"]).df()[list(got.columns)]
    assert len(got) and sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))


# -- 13 -----------------------------------------------------------------------------------------------------------------


def brute_alignment(texts):
    """From the libraries themselves, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    of = alignment.byte_values()
    docs = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        x = [(i, len(t)) for i in a.encode(raw.decode(), add_special_tokens=False).ids for t in [a.id_to_token(i)]] if text else []
        y = []
        for i in b.encode(text) if text else []:
            p = b.id_to_piece(i)
            y.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        spelled = b"".join(bytes(of[c] for c in a.id_to_token(i)) for i, _ in x)
        if not text or spelled != raw or b"".join(t for _, t in y) != raw:
            docs.append(None)
            continue
        cut_x, cut_y, at = {}, {}, 0
        for n, (_, w) in enumerate(x, 1):
            at += w
            cut_x[at] = n
        at = 0
        for n, (_, t) in enumerate(y, 1):
            at += len(t)
            cut_y[at] = n
        found, m, n = [], 0, 0
        for cut in sorted(set(cut_x) & set(cut_y)):
            found.append(([i for i, _ in x[m : cut_x[cut]]], [i for i, _ in y[n : cut_y[cut]]]))
            m, n = cut_x[cut], cut_y[cut]
        docs.append((len(x), len(y), found, Counter((p, q) for g in found for p in g[0] for q in g[1])))
    count = Counter(pair for d in docs if d for pair in d[3])
    most = {}
    for (p, _), n in count.items():
        most[p] = max(most.get(p, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in d[2])
        best = sum(k for pair, k in d[3].items() if count[pair] == most[pair[0]])
        out.append((d[0], d[1], len(d[2]), sum(d[3].values()), best, sum(k * count[pair] for pair, k in d[3].items()), hashlib.sha256(shown.encode()).hexdigest()))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("known", [alignment.KNOWN, 50, 0])
def test_alignment_equals_the_libraries(spark, texts, known):
    """Also where all or most pairs are joined instead of looked up."""
    rng = random.Random(3)
    odd = [*ODD, " lead", "trail ", "a  b   c\n\n d", "x　 y \x85 z", "it's 3.14 — ok…", "\n", "   ", "🖍️" * 50, "日本語 " * 40, "<|endoftext|> <s> </s><unk>", "x" * 20000, " ".join(rng.choice("ab\n\t é") for _ in range(3000))]
    rows = [*texts[:60], *enumerate(odd), (1, "twice"), (1, "twice"), (None, "no id"), (1, "other")]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id bigint, text string, n_a string, row int").repartition(3)
    got = Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in alignment.align(df, BYTES, PIECES, known).collect())
    want = Counter((d, *w) for (d, _), w in zip(rows, brute_alignment([t for _, t in rows]), strict=True))
    assert got == want
    assert alignment.align(df.where("false"), BYTES, PIECES).count() == 0


def test_memo_may_be_emptied(texts, monkeypatch):
    pair = alignment.Pair(BYTES, PIECES)
    whole = pair.encode([t or "" for _, t in texts[:40]])
    monkeypatch.setattr(alignment, "MEMO", 5)
    assert [pair.encode([t or ""])[0] for _, t in texts[:40]] == whole


def test_ranks_and_ranges_of_bits():
    rng = np.random.default_rng(1)
    ends = np.flatnonzero(rng.random(1000) < 0.3) + 1
    bits = alignment.EndBits.of(ends, 1000)
    assert bits.select().tolist() == (ends - 1).tolist()
    assert bits.rank(np.arange(1000)).tolist() == [int((ends <= n + 1).sum()) for n in range(1000)]
    assert alignment._ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_large_groups_count_all_links(monkeypatch):
    """Groups that are counted by their distinct ids give what listing gives."""
    text = ["ab " * 50 + "日本語🖍 " * 30]
    pair = alignment.load(BYTES, PIECES)
    listed = alignment._aligned(pair, text)
    monkeypatch.setattr(alignment, "LARGE", 0)
    counted = alignment._aligned(pair, text)
    for a, b in zip(listed[5:], counted[5:], strict=True):
        assert a[0].tolist() == b[0].tolist()
