"""Language, personal data, toxicity, quality, decontamination, tokens: brute force, held-out accuracy and edge cases."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import boosting, bpe, decontaminate, language, pii, quality_rules, registry, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 30_000 + "x" * 50_000
ODD = [None, "", " ", "\n\n", "é" * 100, "日本語 テスト", "a\x00b", "<|endoftext|> x", "𝒳𝒴 😀 👩‍👩‍👧", LONG]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def real(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").limit(400).collect()]


# quality


def quality_brute(t):
    t = t or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(covered)


def test_quality_counts(spark):
    texts = [*real(spark), *ODD, "a b c d e a b c d e f", "x\nx\n\n \nx", "# % | <"]
    rows = quality_rules.measures(docs(spark, texts)).orderBy("doc_id").select("quality.*").collect()
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["lines"]["n_dup"], r["n_repeat_words"]) for r in rows] == [quality_brute(t) for t in texts]


def test_quality_plan_is_native(spark):
    plan = quality_rules.quality_rules(docs(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_empty_and_clashing(spark):
    out = quality_rules.quality_rules(docs(spark, []).withColumn("kept", F.lit(1)))
    assert out.count() == 0 and dict(out.dtypes)["kept"] == "boolean"


# decontamination


def contamination_brute(texts, items, n=13):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = {}
    for i, t in items:
        w = split(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= got
        out.append((len(w), len(hit), sorted(found)))
    return out


ITEMS = [(1, " ".join(f"w{i}" for i in range(20))), (2, "Short item, three"), (3, None), (4, "!!"), (2, "Short item, three"), (5, "É zwölf")]


@pytest.mark.parametrize("block", [1 << 24, 30])
def test_contamination(spark, block):
    rng = random.Random(1)
    texts = [*ODD, "SHORT-item three", "short item", "x w0 " + " ".join(f"W{i}" for i in range(1, 14)) + " short ITEM three é zwölf"]
    texts += [" ".join(rng.choice(["w1", "w2", "short", "item", "three", "w3", "q"]) for _ in range(60)) for _ in range(50)]
    bench = spark.createDataFrame([*ITEMS, (None, "w1 w2")], "item_id bigint, text string")
    df = docs(spark, texts).withColumns({"contamination": F.lit("own"), "row": F.lit(1), "_row": F.lit(2), "hits": F.lit(3)})
    found = decontaminate.find_contamination(df, bench, block_bytes=block).orderBy("doc_id").collect()
    assert {(r["row"], r["_row"], r["hits"]) for r in found} == {(1, 2, 3)}
    got = [(r["contamination"]["n_words"], sum(x["end"] - x["start"] for x in r["contamination"]["hits"]), r["contamination"]["items"]) for r in found]
    assert got == contamination_brute(texts, ITEMS)


def test_contaminated_documents_and_spans_go(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    df = docs(spark, ["a one, two three b", "clean " * 100, "clean " * 99 + "one two three", None])
    kept = decontaminate.drop_contaminated(df.withColumn("_contamination", F.lit("own")), bench).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["_contamination"]) for r in kept] == [(1, "own"), (2, "own"), (3, "own")]
    assert [r["text"] for r in decontaminate.remove_spans(df, bench).orderBy("doc_id").collect()][0] == "a  b"
    assert decontaminate.drop_contaminated(df, bench.filter("item_id < 0")).count() == 4
    assert decontaminate.drop_contaminated(df.filter("doc_id < 0"), bench).count() == 0


def test_the_index_is_small():
    rng = random.Random(0)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(20_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=100))) for i in range(3_000)]
    size = sum(len(t) for _, t in items)
    index = decontaminate.WindowIndex(items)
    held = index.flat.nbytes + sum(x.nbytes for w in index.windows.values() for x in w)
    assert held < 6 * size  # 16 MB of items are held in 100 MB and their vocabulary


# tokens


def test_token_counts_and_ids_are_the_librarys(spark):
    rng = np.random.default_rng(0)
    texts = [*real(spark)[:150], *ODD[:-1], "it's ''s 'S   x　　y DON'T <|startoftext|>", "ΑΣ ß ǅ İ \x1c\x1d\x85\xa0 º ª ² ½ ٣", *["".join(map(chr, rng.integers(0, 0x300, 200))) for _ in range(60)]]
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.WholeTokenCounter(public_tokenizers.path("byte_bpe_50k.json"))(texts) == [len(e.ids) for e in one.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    two = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = bpe.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    want = [np.array(e.ids, "<u2").tobytes() for e in two.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids(texts) == want
    assert ids(texts[::-1]) == want[::-1]


def test_token_query_columns_and_odd_tables(spark, sf_dir):
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in registry.QUERIES["op9_token_counts"](spark, sf_dir).collect():
        t = texts.pop(r["doc_id"])
        n = len(one.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)
    assert not texts


def test_whole_tokens_are_proved():
    c = bpe.WholeTokenCounter(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(len(c.library.encode(t, add_special_tokens=False).ids) == 1 for t in random.Random(0).sample(c.whole, 500))


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(x) if i % 2 == 0 else (2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) for i, x in enumerate(reversed(d))) % 10 == 0


def pii_brute(t):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_base_spans_and_their_superset(spark):
    rng = random.Random(3)
    made = ["".join(rng.choice(["1", "23", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "255", "4111111111111111", "é"]) for _ in range(60)) for _ in range(150)]
    texts = [*real(spark), *ODD, *made, "a@b.c+d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255", "1" * 3000, "." * 3000 + "1.1.1.1" * 500]
    rows = pii.find_pii(docs(spark, texts)).orderBy("doc_id").select("pii").collect()
    for t, r in zip(texts, rows, strict=True):
        base = [tuple(s) for s in r["pii"]["base"]]
        assert base == pii_brute(t)
        assert not [s for s in r["pii"]["added"] for b in base if b[0] < s["end"] and s["start"] < b[2]]


def test_wide_patterns_and_look_alikes(spark):
    yes = ["call (509) 555-6973 now", "joe [at] mail dot com", "api_key: 4f9a0c77d1e2b35590aa71c3"]
    no = ["released on 2024-01-15 12:30:45", "plain words only", "at 10:20:30 we met", "looked at trees. and went"]
    found = [len(r["pii"]["added"]) for r in pii.find_pii(docs(spark, yes + no)).orderBy("doc_id").collect()]
    assert found == [1] * len(yes) + [0] * len(no)


def test_whole_secrets_and_short_forms_are_redacted(spark):
    rng = random.Random(5)
    jwt = "eyJ" + "".join(rng.choice("ABCDEFabcdef0123456789_-.") for _ in range(399)) + "x"
    cases = {
        f"Authorization: Bearer {jwt} end": ("secret", jwt), "api_key: " + "a1" * 300: ("secret", "a1" * 300),
        **{f"host {x} is up": ("ip", x) for x in ("fe80::1", "::1", "fe80::1ff:fe23:4567:890a", "2001:db8:85a3::8a2e:370:7334", "2001:db8::ff00:42:8329")},
        "mobile 0171 2345678 now": ("phone", "0171 2345678"), "tel 030 12345678 now": ("phone", "030 12345678"), "call 01712345678 now": ("phone", "01712345678"),
    }
    df = docs(spark, list(cases))
    found = df.select("doc_id", F.struct(*[c.alias(k) for k, c in pii.candidates(F.col("text")).items()]).alias("c")).orderBy("doc_id").collect()
    for (t, (kind, x)), r in zip(cases.items(), found, strict=True):
        assert [(s["start"], s["end"]) for s in r["c"][kind] if s["start"] <= t.index(x)][-1:] == [(t.index("Bearer" if x is jwt else "api_key" if kind == "secret" else x), t.index(x) + len(x))], t
    left = [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()]
    assert not [(t, out) for (t, (kind, x)), out in zip(cases.items(), left, strict=True) if x[-4:] in out or f"[{kind.upper()}]" not in out]


def test_prose_with_dots_is_no_address(spark):
    texts = ["growth peaked at the dot com boom", "mail joe at example dot com today"]
    assert [[x["kind"] for x in r["pii"]["added"]] for r in pii.find_pii(docs(spark, texts)).orderBy("doc_id").collect()] == [[], ["email"]]


def test_a_kind_without_both_classes_fails(spark, monkeypatch):
    made = [x for x in pii.examples([]) if x.kind != "email" or x.personal]
    monkeypatch.setattr(pii, "examples", lambda carriers: made)
    with pytest.raises(ValueError, match="email"):
        pii.fit(spark, [])


def test_trees_decide_on_formats_they_did_not_see(spark):
    model = pii.fit(spark, [t for t in real(spark) if t])
    for kind, (precision, recall, n) in model.unseen.items():
        trees, threshold = model.kinds[kind]
        assert n >= 400 and precision >= 0.9 and recall >= 0.8, (kind, precision, recall)
        assert sum(isinstance(t, tuple) for t in trees) >= 8 and np.isfinite(threshold)
    made = pii.examples([], seed=11, each=4)
    found = pii.find_pii(docs(spark, [e.text for e in made]), model=model).orderBy("doc_id").collect()
    for kind in pii.KINDS:
        near = [any(s["kind"] == kind and s["start"] < e.end and s["end"] > e.start for s in r["pii"]["added"]) for e, r in zip(made, found, strict=True) if e.kind == kind]
        assert 0.1 < np.mean(near) < 0.9  # some are kept, some rejected


def test_spans_planted_in_whole_documents(spark):
    """Other spans of the known formats, in the middle of documents that the trees took no prose from."""
    texts = [t for t in real(spark) if t and len(t.split()) > 60]
    model = pii.fit(spark, texts[:60])
    made = pii.examples([], seed=23, each=3)
    planted, at = [], []
    for k, e in enumerate(made):
        body = texts[60 + k % (len(texts) - 60)]
        cut = body.index(" ", len(body) // 2) if " " in body[len(body) // 2 :] else len(body)
        planted.append(f"{body[:cut]} {e.text} {body[cut:]}")
        at.append((cut + 1 + e.start, cut + 1 + e.end))
    found = pii.find_pii(docs(spark, planted), model=model).orderBy("doc_id").collect()
    for kind in pii.KINDS:
        hits = [(e.personal, any(s["kind"] == kind and s["start"] < b and s["end"] > a for s in [*r["pii"]["added"], *r["pii"]["base"]])) for e, (a, b), r in zip(made, at, found, strict=True) if e.kind == kind]
        kept = [personal for personal, hit in hits if hit]
        assert np.mean(kept) >= 0.9 and np.mean([hit for personal, hit in hits if personal]) >= 0.8, (kind, np.mean(kept), np.mean([hit for personal, hit in hits if personal]))


def test_trees_in_sql_are_those_in_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosting.boost(x, y, rounds=6)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    got = np.array([r[0] for r in df.selectExpr(boosting.as_sql(trees, ["a", "b", "c", "d"])).collect()])
    assert np.allclose(1 / (1 + np.exp(-got)), boosting.predict(trees, x)) and np.mean((got > 0) == y) > 0.9


def test_running_values(spark):
    rng = random.Random(0)
    rows = [([rng.randint(-9, 9) for _ in range(n)],) for n in (0, 1, 127, 128, 129, 1000)]
    df = spark.createDataFrame(rows, "x array<bigint>").select("x", pii.running(F.col("x"), lambda a, b: a + b, 0).alias("s"), pii.running(F.col("x"), lambda a, b: F.greatest(a, b), -100).alias("m"))
    for r in df.collect():
        assert r["s"] == np.cumsum(r["x"]).tolist() and r["m"] == np.maximum.accumulate(r["x"]).tolist()


def test_pii_query_columns(spark, sf_dir):
    rows = {r["doc_id"]: r for r in pii.op2_pii(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        base, r = pii_brute(d["text"]), rows.pop(d["doc_id"])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[3] == k for s in base) for k in PATTERNS]
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert [(int(a), pii.KINDS.index(k)) for k, a, _ in spans] == sorted((int(a), pii.KINDS.index(k)) for k, a, _ in spans)
        assert {f"{k}:{a}:{b}" for a, _, b, k in base} <= set(r["spans"].split(","))
    assert not rows


def test_long_lists_of_addresses(spark):
    text = "joe.doe@mail.com; " * 3000 + "joe (at) mail dot com; " * 1500 + "ä"
    df = docs(spark, [text])
    out = pii.redact(df).first()["text"]
    assert out == "[EMAIL]; " * 4500 + "ä"


def test_redaction(spark):
    texts = ["mail a@b.com or +1 (509) 555-6973.", None, "", "x +4111111111111111 y", "nothing"]
    clash = pii.redact(docs(spark, texts).withColumn("_pii", F.lit(7)))
    assert {r["_pii"] for r in clash.collect()} == {7}
    assert [r["text"] for r in clash.orderBy("doc_id").collect()] == ["mail [EMAIL] or [PHONE].", None, "", "x +[CARD] y", "nothing"]


def test_pii_plan_is_native(spark):
    plan = pii.redact(docs(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# language and toxicity


def test_language_on_held_out_rows(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    m = registry.QUERIES["op1_language"](spark, SF).join(truth, "doc_id").filter("held_out and lang is not null")
    assert m.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_toxic_statistics_are_of_all_rows(spark):
    df = docs(spark, ["bad word", "bad", None, "good word word"]).repartition(3)
    got = {r["k"]: r["n"] for r in toxicity.document_frequencies(df, "text").collect()}
    levels = len(toxicity.LEVELS)
    want = Counter(k for t in ("bad word", "bad", None, "good word word") for k in toxicity.Lookup().levels(t).tolist())
    assert got == dict(want) and all(0 <= k < toxicity.HASHED * levels for k in got)


def test_language_edges(spark):
    train = spark.createDataFrame([(i, t, lang) for i in range(20) for lang, t in (("en", "the of and that"), ("de", "der die und nicht"))], "doc_id bigint, text string, lang string")
    model = language.fit(train)
    rows = language.identify(docs(spark, [None, "", "123 !?", "the and of", "UND DIE NICHT", LONG, "𝒳"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows[:5]] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r["score"] <= 1 for r in rows)
    nothing = language.fit(train.filter("doc_id < 0"))
    assert language.identify(docs(spark, ["the"]), nothing).first()["lang_pred"] == "und"
    assert language.identify(docs(spark, []), model).count() == 0


def test_toxicity_on_held_out_rows(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    truth = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    m = registry.QUERIES["op3_toxicity"](spark, SF).join(truth, "doc_id").filter("held_out").toPandas()
    tp = ((m.predicted == 1) & (m.toxic == 1)).sum()
    assert tp / max(1, (m.predicted == 1).sum()) > 0.8
    assert tp / max(1, (m.toxic == 1).sum()) > 0.6


def test_risk_and_gradient(monkeypatch):
    """One step of the training against finite differences of the risk, on both sides of the correction."""
    rng = np.random.default_rng(3)
    rows = [(bool(k < 30), np.unique(rng.integers(0, 5, 3))) for k in range(90)]
    x = np.zeros((90, 6))
    for k, (_, f) in enumerate(rows):
        x[k, f], x[k, 5] = 1, 1
    pos = np.array([p for p, _ in rows])

    def parts(w, prior):
        g = x @ w
        return prior * np.logaddexp(0, -g[pos]).mean(), np.logaddexp(0, g[~pos]).mean() - prior * np.logaddexp(0, g[pos]).mean()

    monkeypatch.setattr(toxicity, "DECAY", 0.0)
    for prior in (0.1, 0.999):
        w = np.zeros(6)
        up, negative = parts(w, prior)
        risk = (lambda v: sum(parts(v, prior))) if negative >= 0 else (lambda v: -parts(v, prior)[1])
        want = np.array([(risk(w + 1e-6 * e) - risk(w - 1e-6 * e)) / 2e-6 for e in np.eye(6)])
        got, bias = toxicity.train(rows, 5, prior, rounds=1)  # the first step of Adam goes by the sign of the gradient
        moved = np.append(got, bias)
        big = np.abs(want) > 1e-5
        assert np.allclose(moved[big], -toxicity.RATE * np.sign(want[big]), rtol=1e-2)


def test_the_mixture_does_not_depend_on_the_bounds(spark):
    """The share of toxic text among unlabelled rows is that of the corpus, whatever part of the confirmed rows is drawn."""
    rng = random.Random(6)
    toxic = [k % 10 < 3 for k in range(1200)]
    texts = [" ".join(rng.choices(["fine", "day", "walk", "tree", "house"], k=12)) + (" " + rng.choice(["vile", "rotten", "foul"]) if t else "") for t in toxic]
    labels = spark.createDataFrame([(k, int(t)) for k, t in enumerate(toxic) if k % 3 == 0], "doc_id bigint, toxic int")
    seen = {}

    def train(rows, size, prior, rounds=0):
        rows = list(rows)
        seen["prior"], seen["share"] = prior, np.mean([len(f) > 0 for p, f in rows if not p])
        return np.zeros(size), 0.0

    original, toxicity.train = toxicity.train, train
    try:
        for positives in (10**6, 60):
            toxicity.fit(docs(spark, texts), labels, positives=positives, unlabelled=10**6)
            assert abs(seen["prior"] - 0.3) < 0.02 and abs(seen["share"] - 0.3) < 0.02
    finally:
        toxicity.train = original


def test_non_negative_risk_learns_from_positives_and_mixture():
    rng = np.random.default_rng(0)
    toxic = lambda: np.array([0, *([1] if rng.random() < 0.5 else [])], np.int64)
    clean = lambda: np.array([2] if rng.random() < 0.5 else [], np.int64)
    rows = [(True, toxic()) for _ in range(200)] + [(False, toxic() if rng.random() < 0.1 else clean()) for _ in range(800)]
    w, b = toxicity.train(rows, 3, 0.1)
    assert w[0] + b > 1 and b < 0 and w[2] + b < 0


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    train = docs(spark, [("awful " if i % 2 else "fine ") * 3 + f"w{i}" for i in range(40)])
    model = toxicity.fit(train, labels)
    out = [r["toxicity"] for r in toxicity.toxicity(docs(spark, [None, "", "awful thing", "fine thing", LONG]), model).orderBy("doc_id").collect()]
    assert all(0 <= s <= 1 for s in out) and out[2] > out[3] and out[0] == out[1]
    assert toxicity.toxicity(docs(spark, []), model).count() == 0
    none = toxicity.fit(train, labels.filter("doc_id < 0"))
    assert toxicity.toxicity(docs(spark, ["awful"]), none).first()["toxicity"] < 0.5


def test_fingerprint_is_as_defined():
    from tessera.llm.simhash import fingerprint

    def brute(t):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)}))) if w]
        if not words:
            return 0
        k = min(4, len(words))
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in [*ODD, "A b", "one two three four five ÀÉ x"]:
        assert fingerprint(t) == brute(t)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_are_those_of_sql(spark, name):
    import duckdb

    small = "/root/testdata/sf0.001"
    if not Path(small).is_dir():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = registry.QUERIES[name](spark, small)
    found = c.execute(registry.ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(x) for x in df.columns]
    assert sorted(tuple(map(str, r)) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())
