"""Each stage of the pipeline against a brute-force version, on the smallest table with odd rows added."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402
from folioscope.llm import toxicity  # noqa: E402

from .test_operators import brute_links, check_packing  # noqa: E402

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def brute_base(text):
    """The patterns of the contract as they stand there."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(int(p) for p in m[0].split(".")) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def brute_terms(texts):
    """Term to action, from PMI over distinct texts."""
    def words(text):
        base = brute_base(text)
        return {m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", text) if all(m.end() <= a or m.start() >= b for _, a, b in base)}

    distinct = sorted({t or "" for t in texts})
    docs, contexts, both = Counter(), Counter(), Counter()
    for t in distinct:
        own, entities = words(t), {(k, t[a:b].lower()) for k, a, b in brute_base(t)}
        docs.update(own)
        contexts.update(entities)
        both.update((e, w) for e in entities for w in own)
    n, out = len(distinct), {}
    for (e, w), k in both.items():
        d = docs[w]
        bound = (k / d + 1 / (2 * d) - math.sqrt(k / d * (1 - k / d) / d + 1 / (4 * d * d))) / (1 + 1 / d)
        if d < 2 or bound * n < 4 * contexts[e] or -math.log2(bound) > 2.3:
            continue
        out[w] = max(out.get(w, ""), "remove" if -math.log2(bound) <= 0.7 else "generalise")
    return out


def brute_clean(text, terms):
    if text is None:
        return None
    base = brute_base(text)
    marks = [(a, b, k) for k, a, b in base]
    marks += [(m.start(), m.end(), terms[m[0].lower()]) for m in re.finditer(r"[^\W\d_]{3,}", text) if m[0].lower() in terms and all(m.end() <= a or m.start() >= b for _, a, b in base)]
    out, at = "", 0
    merged = []
    for a, b, k in sorted(marks, key=lambda m: (m[0], -m[1])):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += text[at:a] + {"remove": "", "generalise": "[TERM]"}.get(k, f"[{k.upper()}]")
        at = b
    return out + text[at:]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rnd = random.Random(3)
    long = " ".join("".join(rnd.choice("aeiklmnorst") for _ in range(rnd.randrange(2, 9))) for _ in range(20_000))
    near = long.replace(" a", " the a", 40)
    extra = [None, "", " \n", "one", "ONE", long, near, "mail a.b@c.example or +49 30 1234567 to Kestrelford", "mail a.b@c.example  or +49 30 1234567 to Kestrelford", "10.0.0.1 4539 1488 0343 6467"]
    rows += [(5000 + i, t, None, None, len(t or "")) for i, t in enumerate(extra)] + [(5000, None, None, None, 0), (5003, "one", "en", "s", 3)]
    clash = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' token", "doc_id h", "doc_id `__id`", "text terms", "1 name", "2 row")
    return clash


def kept_of(stage, spark, frame):
    out = stage(spark, frame, SMALL)
    assert out.dtypes == frame.dtypes
    return Counter((r["doc_id"], r["text"]) for r in out.collect())


def test_stages_and_their_order(spark):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "privacy", "packing"] and pipeline.ORACLE_SQL is None


def test_toxic_documents_go_and_no_others(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    chain = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    bad = chain.probabilities(chain.rows([t or "" for _, t in rows]))[:, -1] >= chain.threshold
    assert 0 < sum(bad) < 30
    assert kept_of(pipeline.drop_toxic, spark, docs) == Counter(r for r, b in zip(rows, bad, strict=True) if not b)


def test_one_of_equal_texts_stays(spark, docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append((r["doc_id"], r["text"]))
    got = kept_of(pipeline.drop_copies, spark, docs)
    assert sum(got.values()) == len(groups)
    assert {d for d, _ in got} == {min(g, key=lambda x: x[0])[0] for g in groups.values()}
    assert all(any(r in g for g in groups.values()) for r in got)


def test_one_of_near_copies_stays(spark, docs):
    """Rows of one id are told apart: each is a document of its own, linked or not."""
    rows = sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in docs.collect())
    more = [(5003, "k l m n o p q r"), (5007, "one two three four five six"), (5007, "another text that no other row resembles"), (None, "no id at all here"), (None, "No Id at all here")]
    frame = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    rows = [(d, t) for _, d, t in rows] + more
    _, want = brute_links({k: t for k, (_, t) in enumerate(rows)}, 5, 80)
    groups = defaultdict(list)
    for k, top in want.items():
        groups[top].append(rows[k])
    got = kept_of(pipeline.drop_near_copies, spark, frame)
    assert sum(got.values()) == len(groups)
    least = Counter(min((d is None, d or 0) for d, _ in g) for g in groups.values())
    assert Counter({k: n for k, n in least.items()}) == sum((Counter({(d is None, d or 0): n}) for (d, _), n in got.items()), Counter())
    assert all(any(r in g for g in groups.values()) for r in got)
    assert all(got[r] for r in more[:3]) and got[more[3]] + got[more[4]] == 1
    once = docs.dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in once.collect()}
    _, want = brute_links(texts, 5, 80)
    assert kept_of(pipeline.drop_near_copies, spark, once) == Counter((d, t) for d, t in texts.items() if want[d] == d)
    assert want[5006] == 5005


def test_personal_data_goes(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    terms = brute_terms([t for _, t in rows])
    assert kept_of(pipeline.sanitise, spark, docs) == Counter((d, brute_clean(t, terms)) for d, t in rows)
    lengths = pipeline.sanitise(spark, docs, SMALL).where("n_chars != length(text)").count()
    assert lengths == 0


def test_spans_equal_brute_force(spark):
    from folioscope.llm import privacy

    rnd = random.Random(8)
    made = ["".join(rnd.choice(["a@", "@b.c", "x.y", "@", ".", "-", " ", "+1", "4539 1488", "0343 6467", "1.2.3.4", "256", "+49 (30) 123-4567", "é"]) for _ in range(14)) for _ in range(4000)]
    for text in [*made, "4539148803436467" * 3, "+1234567890123456 7", "1234-5678 9012-3", "+1 2.3-4(5)6 7890", "a" * 5000 + "@b.c"]:
        assert privacy.base_spans(text) == sorted(brute_base(text), key=lambda s: (KINDS.index(s[0]), s[1]))


def test_packing_stage(spark, docs):
    once = docs.dropDuplicates(["doc_id"])
    check_packing(pipeline.pack(spark, once, SMALL).collect(), {r["doc_id"]: r["text"] or "" for r in once.collect()})


def test_empty_tables_pass_through(spark, docs):
    none = docs.where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0


def test_whole_run(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in pipeline.STAGES:
        frame = stage(spark, frame, SMALL)
    got = pipeline.run(spark, SMALL)
    assert got.columns == frame.columns
    assert {tuple(r) for r in got.select("doc_id", "start", "length", "ids_crc32").collect()} == {tuple(r) for r in frame.select("doc_id", "start", "length", "ids_crc32").collect()}
