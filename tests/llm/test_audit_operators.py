"""Divergence of sources, Merkle manifests, byte-level BPE: brute force, the library, and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tessera.llm import codec, divergence, manifest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(3, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (None, "x", "en", None, 1), (7, "Ab é", "en", "s", 4), (7, "Zz", "en", "s", 2)]


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


# --- divergence -------------------------------------------------------------------------------------------------------


def divergence_brute(rows, min_docs, top):
    cut = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, count, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lowered = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
        terms = [m.decode() for m in cut.findall(lowered)]
        docs.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    kept = defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= min_docs:
            kept[lang].append(t)
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    p, q = {}, {}
    for lang, source in groups:
        v = len(kept[lang])
        total = sum(count[lang, source, t] for t in kept[lang])
        p[lang, source] = {t: share(count[lang, source, t], total, v) for t in kept[lang]}
    for lang in kept:
        by = {t: sum(count[lang, s, t] for x, s in groups if x == lang) for t in kept[lang]}
        q[lang] = {t: share(n, sum(by.values()), len(by)) for t, n in by.items()}
    out = set()
    for lang, source in groups:
        own = p[lang, source]
        pairs = [(-sum(abs(own[t] - p[lang, s][t]) for t in own), s.encode()) for x, s in groups if x == lang and s != source]
        terms = [(-(own[t] - q[lang][t]), t.encode()) for t in own if count[lang, source, t] and own[t] > q[lang][t]]
        for part, found, most in (("pair", pairs, 10**9), ("term", terms, top)):
            out |= {(lang, source, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(found)[:most])}
    return out


def audit_rows(seed):
    rng = random.Random(seed)
    rows = [(words(rng, "abCé" if s % 3 else "abx1- ", rng.randint(0, 40)), rng.choice(["en", "de", None]), f"s{s}") for s in (rng.randint(0, 6) for _ in range(150))]
    return [*rows, (None, "en", None), (None, "solo", "s0"), ("a b c", "solo", "s1"), ("Ünïcode 日本", "", ""), *rows[:3], ("b " * 4000, "en", "s1"), ("x" * 70000, "de", "s2")]


@pytest.mark.parametrize(("min_docs", "top", "block"), [(30, 50, 500_000), (5, 3, 7), (1, 50, 90)])
def test_divergence_against_brute_force(spark, monkeypatch, min_docs, top, block):
    monkeypatch.setattr(divergence, "BLOCK_COUNTS", block)
    rows = audit_rows(min_docs)
    df = spark.createDataFrame([(*r, k, k) for k, r in enumerate(rows)], "text string, lang string, source string, value bigint, rank int").repartition(5)
    got = divergence.divergence(df, min_docs=min_docs, top=top).collect()
    assert {tuple(r) for r in got} == divergence_brute(rows, min_docs, top)
    assert len(got) == len({tuple(r) for r in got})


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0
    one = divergence.divergence(spark.createDataFrame([(1, None, None, None, 0), (2, None, None, "b", 0)], DOCS)).collect()
    assert {tuple(r) for r in one} == {("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)}


def test_hash_is_the_library_s():
    rng = np.random.default_rng(1)
    for size in (*range(1, 40), 100):
        rows = rng.integers(0, 256, (20, size), dtype=np.uint8)
        assert divergence.xxh64(rows).tolist() == [xxhash.xxh64_intdigest(r.tobytes()) for r in rows]


def test_slices_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence, "xxh64", lambda rows: np.zeros(len(rows), np.uint64))
    rows = np.frombuffer(b"abcdabefabcdxyab", np.uint8).reshape(-1, 4)
    kinds, of = divergence.same_slices(rows)
    assert [kinds[k].tobytes() for k in of] == [r.tobytes() for r in rows] and len(kinds) == 3


@pytest.mark.parametrize("bound", [7, 64, 1 << 22])
def test_counts_at_any_bounds(monkeypatch, bound):
    """Texts cut in many goes, and memory handed on early, change nothing."""
    monkeypatch.setattr(divergence, "RANGE_BYTES", bound)
    monkeypatch.setattr(divergence, "HELD_TERMS", bound)
    monkeypatch.setattr(divergence, "HELD_COUNTS", bound)
    import pyarrow as pa

    rows = [r for r in audit_rows(4) if len(r[0] or "") < 3000]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[a : a + 40], strict=True)], names=["text", "lang", "source"]) for a in range(0, len(rows), 40)]
    got = Counter()
    for b in divergence._counted(iter(batches)):
        for r in b.to_pylist():
            got[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
            got[r["lang"], r["source"], r["term"], "n"] += r["n"]
    want = Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        want[lang, source, None, "docs"] += 1
        want.update((lang, source, t, "docs") for t in set(terms))
        want.update((lang, source, t, "n") for t in terms)
    assert +got == +want


# --- manifest ---------------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_brute(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_brute(nodes, fanout):
    """(root, for each node the siblings of its way up with its place)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // fanout * fanout : i // fanout * fanout + fanout]
            ways[k].append((i % fanout, "".join(run[: i % fanout] + run[i % fanout + 1 :])))
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], ways


def manifest_brute(rows, fanout=8):
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        trees[lang].append((doc_id is not None, doc_id or 0, leaf_brute((doc_id, source, lang, n_chars, text)), doc_id))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        trees[g].sort(key=lambda r: r[:3])
        subs[g] = tree_brute([r[2] for r in trees[g]], fanout)
    root, above = tree_brute([subs[g][0] for g in order], fanout)
    return Counter((r[3], g, r[2], subs[g][0], root, tuple(w + above[k])) for k, g in enumerate(order) for r, w in zip(trees[g], subs[g][1], strict=True))


@pytest.mark.parametrize(("fanout", "levels", "langs", "n"), [(8, 4, 3, 120), (2, 1, 5, 40), (2, 2, 11, 90), (3, 2, 1, 60), (8, 1, 70, 80), (8, 4, 1, 1)])
def test_manifest_against_brute_force(spark, fanout, levels, langs, n):
    rng = random.Random(n)
    rows = [(rng.randint(0, n), words(rng, "aB ", 3), rng.choice([None, "", *[f"l{k}é" for k in range(langs)]]) if langs > 1 else "x", "s", k) for k in range(n)]
    rows += [(*r[:2], rows[0][2], *r[3:]) for r in ODD] if langs > 1 else []
    df = spark.createDataFrame([(*r, "h", "t") for r in rows], DOCS + ", hash string, tree string").repartition(3)
    got = manifest.manifest(df, carry=["hash"], fanout=fanout, levels=levels)
    assert got.columns == ["doc_id", "lang", "leaf", "subroot", "root", "proof", "hash"]
    ways = Counter((r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], tuple((s["place"], s["siblings"]) for s in r["proof"])) for r in got.collect())
    assert ways == manifest_brute(rows, fanout)
    assert got.filter(manifest.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert got.filter(manifest.folded(F.sha2(F.lit("other"), 256), F.col("proof")) == F.col("root")).count() == 0


def test_manifest_of_nothing_and_of_clashing_names(spark):
    empty = spark.createDataFrame([], DOCS)
    assert manifest.manifest(empty).count() == 0
    with pytest.raises(ValueError, match="root"):
        manifest.manifest(empty.withColumnRenamed("doc_id", "root"), columns=["root"], key="root")
    one = spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS).withColumn("leaf", F.lit("mine"))
    assert manifest.manifest(one, carry=["leaf"]).columns == ["doc_id", "lang", "leaf", "subroot", "root", "proof"]


def test_manifest_query_finds_tampering(spark, sf_dir):
    low = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in manifest.op12_manifest(spark, sf_dir).collect():
        text = low[r["doc_id"]]
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None and re.search("[A-Z]", text)
        assert r["verified"] == (not changed)


# --- byte-level BPE ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(codec.VOCABULARY))


@pytest.fixture
def bpe():
    return codec.Codec(public_tokenizers.path(codec.VOCABULARY))


def texts_for_bpe():
    rng = random.Random(5)
    out = ["", None, "a", "a" * 1000, "ab" * 500, "<|endoftext|>", "x<|endoftext|> <|endoftext|>y  z\n\n", "don't I'LL we've", "՘ \x1c\x85​", "é" * 999, "\U0001f600" * 50, "a՘b a՘", " \t\n "]
    for letters in ("ab", "acgt", "abcdefghijklmnopqrstuvwxyz", "日本語テキスト漢字", "aé\U0001f600 \n1", "etaoin shrdlu"):
        out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(40)]
        out += ["".join(rng.choice(letters) for _ in range(n)) for n in (300, 3000)]
    return out


@pytest.mark.parametrize(("group", "remembered", "long"), [(1_000_000, 600_000, 256), (500, 40, 256), (50, 600_000, 2)])
def test_codec_is_the_library_s(monkeypatch, library, bpe, group, remembered, long):
    monkeypatch.setattr(codec, "GROUP_CHARS", group)
    monkeypatch.setattr(codec, "REMEMBERED", remembered)
    monkeypatch.setattr(codec, "LONG", long)
    monkeypatch.setattr(codec, "STEP", group)
    texts = texts_for_bpe()
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)] == want
    flat = np.array([i for x in want for i in x])
    assert bpe.decode(flat, np.cumsum([len(x) for x in want])) == library.decode_batch(want, skip_special_tokens=False)


def test_parts_of_characters_are_decoded_as_by_the_library(library, bpe):
    ids = [i for e in library.encode_batch(["日本語", "é\U0001f600"], add_special_tokens=False) for i in e.ids]
    runs = [ids[a:b] for a in range(len(ids)) for b in range(a, len(ids) + 1)]
    assert bpe.decode(np.array([i for r in runs for i in r]), np.cumsum([len(r) for r in runs])) == library.decode_batch(runs, skip_special_tokens=False)


def test_encode_and_decode_tables(spark, library):
    texts = texts_for_bpe()[:40]
    df = spark.createDataFrame([(k, t, "kept", {"a": k}) for k, t in enumerate(texts)] * 2, "doc_id bigint, text string, ids string, m map<string, int>").repartition(3)
    want = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    coded = codec.encode(df)
    assert coded.columns == ["doc_id", "text", "m", "ids"]
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in coded.collect()) == sorted((k, tuple(i)) for k, i in want.items() for _ in (0, 1))
    for back in (codec.decode(coded, into="text"), codec.decode(codec.encode(df, packed=True, into="b"), ids="b", into="text")):
        assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(k, library.decode(i, skip_special_tokens=False)) for k, i in want.items()}
    assert codec.encode(df.limit(0)).count() == 0 and codec.decode(coded.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [64, None, 10**6, -1, 65])], "k int, ids array<int>")
    assert {r["k"]: r["decoded"] for r in codec.decode(odd).collect()} == {1: "", 2: library.decode([64, 65])}


def test_bpe_query_columns(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in codec.op13_bpe(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert tuple(got[k])[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


# --- queries and odd tables of earlier operators ------------------------------------------------------------------------


def test_token_counts_of_odd_texts_and_tables(spark, library):
    from tessera.llm.token_counts import token_counts

    texts = [*texts_for_bpe(), "a՘b a՘ 1", "\U00010940\U00010941 x"]
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "k int, text string, n_tokens string").repartition(3)
    counted = token_counts(df)
    assert counted.columns == ["k", "text", "n_tokens"] and token_counts(df.limit(0)).count() == 0
    assert {r["k"]: r["n_tokens"] for r in counted.collect()} == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_chat_query_columns(spark, sf_dir):
    from tessera.llm.chat import op8_chat

    said = "</s>[INST] ok [/INST]"
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    got = {r["conv_id"]: r for r in op8_chat(spark, sf_dir).collect()}
    assert got.keys() == turns.keys()
    for c, rows in turns.items():
        rows.sort()
        target = "".join(t for _, role, t in rows if role == "assistant")
        told = hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in rows).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(rows), told, len(target), hashlib.sha256(target.encode()).hexdigest())
        assert got[c]["formatted_chars"] >= sum(len(t) for *_, t in rows)


def test_a_conversation_column_called_like_a_made_one(spark):
    from tessera.llm.chat import format_chat

    df = spark.createDataFrame([("c", 1, "user", "hi"), ("c", 2, "assistant", None), (None, 1, None, "x")], "window string, turn int, role string, text string")
    out = format_chat(df, conversation="window")
    assert out.columns == ["window", "_window", "text", "loss", "n_repeated", "n_turns", "n_tokens"]
    assert sorted((r["window"] or "", r["_window"], r["n_turns"]) for r in out.collect()) == [("", 0, 1), ("c", 0, 2)]
