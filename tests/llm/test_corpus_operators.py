"""Near-duplicates, sharding, packing, chat windows, the pipeline: brute force, round trips and edge cases."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, components, packing, sharding, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def components_brute(prints, distance=4):
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= distance and root(a) != root(b):
                parent[root(b)] = root(a)
    return [root(p) for p in prints]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("parts", [2, 3, 5])
def test_links_are_complete(spark, parts):
    rng = random.Random(parts)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    centres = [rng.getrandbits(64) for _ in range(30)]
    prints = list({flip(c, rng.randint(0, 6)) for c in centres for _ in range(25)} | {0, (1 << 64) - 1})
    nodes = spark.createDataFrame([(signed(p), signed(p)) for p in prints], "print bigint, part_of bigint")
    got = {(r["a"], r["b"]) for r in simhash.links(nodes, 4, parts).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 4}
    assert got == want


def test_long_lists_are_split(spark):
    """Thousands of fingerprints that share a half and lie three to six bits apart."""
    rng = np.random.default_rng(6)
    half = rng.integers(0, 1 << 32, 1)[0]
    centres = rng.integers(0, 1 << 32, 60)
    low = {int(c) ^ sum(1 << int(b) for b in rng.choice(32, rng.integers(1, 4), replace=False)) for c in centres for _ in range(90)}
    prints = [(int(half) << 32) | x for x in low][:5000]
    nodes = spark.createDataFrame([(signed(p), signed(p)) for p in prints], "print bigint, part_of bigint")
    x = np.array(prints, np.uint64)
    want = {tuple(sorted((signed(int(x[i])), signed(int(x[j]))))) for i in range(len(x)) for j in (np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= 4) + i + 1).tolist()}
    for long, block in ((700, 300), (10**9, 1)):
        assert {(r["a"], r["b"]) for r in simhash.links(nodes, 4, 2, long, block).collect()} == want
    one = nodes.withColumn("part_of", F.lit(7).cast("long"))
    assert simhash.links(one, 4, 2, 700, 300).count() == 0


def test_hubs_are_not_gathered(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 900)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(300)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {v: root(v) for v in list(parent)}
    for hub in (10_000, 20, 0):
        monkeypatch.setattr(components, "HUB", hub)
        df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(6)
        assert {r["node"]: r["root"] for r in components.connected_components(df).collect()} == want


def test_simhash_query_columns(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in simhash.op6_simhash(spark, sf_dir).collect()}
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = sorted(texts)
    roots = components_brute([prints[i] for i in ids])
    least = {}
    for i, r in zip(ids, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    assert {i: got[i]["component_id"] for i in ids} == {i: least[r] for i, r in zip(ids, roots, strict=True)}


def test_dense_groups_and_components(spark):
    rng = random.Random(9)
    centre = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(300)).split()
    texts = []
    for _ in range(150):
        words = list(centre)
        for k in rng.sample(range(len(words)), rng.randint(0, 12)):
            words[k] = f"v{rng.randint(0, 9)}"
        texts.append(" ".join(words))
    texts += texts[:20] + [None, "", " \n", "a", "A", "b c", "alone in here with words"]
    rows = simhash.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect()
    prints = [r["fingerprint"] % (1 << 64) for r in rows]
    assert prints == [simhash.fingerprint(t) for t in texts]
    first = {}
    roots = components_brute(prints)
    for i, r in enumerate(roots):
        first.setdefault(r, i)
    assert [r["component_id"] for r in rows] == [first[r] for r in roots]


def test_thresholds_sum_as_the_principle_asks():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (1000, 64)).astype(float)
    bits[:, :8] = bits[:, :1]
    both = bits.T @ bits
    for parts in (2, 3, 4, 5):
        groups = simhash.group_bits(1000, both, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(simhash.allocate(10**6, both * 1000, groups, 4)) == 4 - parts + 1
    assert any(set(range(8)) <= set(g) for g in simhash.group_bits(1000, both, 2))


def test_one_of_each_group_stays(spark):
    texts = ["one two three four five six"] * 3 + [None, "", "other text entirely of its own", "other text entirely of its own"]
    df = docs(spark, texts, [5, 3, 3, 9, None, None, None]).withColumns({"print": F.lit(1), "_h": F.lit("own")})
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and {r["_h"] for r in kept.collect()} == {"own"}
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.select("doc_id", "text").fillna({"text": "~"}).collect()) == [(-1, "other text entirely of its own"), (3, texts[0]), (9, "~")]
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(-5, 700)]
    out = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {out[i] for i in range(61)} == {0} and {out[i] for i in range(100, 300)} == {100} and out[700] == -5
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# sharding


def one_by_one(classes, shards):
    """Loads after longest processing time through a heap, group by group."""
    loads, out = [(0, k) for k in range(shards)], []
    for size, many in sorted(classes, reverse=True):
        taken = Counter()
        for _ in range(many):
            load, k = heapq.heappop(loads)
            heapq.heappush(loads, (load + size, k))
            taken[k] += 1
        out.append(sorted(taken.items()))
    return out


def test_schedule_is_longest_first():
    rng = random.Random(1)
    assert list(sharding.schedule([(7, 1), (6, 1), (5, 1), (4, 2), (2, 1)], 2)) == one_by_one([(7, 1), (6, 1), (5, 1), (4, 2), (2, 1)], 2)
    for shards in (1, 3, 40):
        sizes = rng.sample(range(0, 3000), 60)
        classes = [(s, rng.choice([1, 2, 7, 170, 900, 5000])) for s in sizes] + [(10**6, 3)]
        assert list(sharding.schedule(sorted(classes, reverse=True), shards)) == one_by_one(classes, shards)


def test_shards_keep_groups_and_balance(spark, monkeypatch):
    rng = random.Random(0)
    texts = ["x" * rng.randint(1, 400) + str(i) for i in range(600)] + ["hot copy"] * 300 + [None, None, ""]
    df = docs(spark, texts).withColumns({"shard": F.lit("clash"), "_s_size": F.lit("own"), "g": F.lit("own"), "piece": F.lit(2)})
    for hot, classes in ((10_000, 100_000), (2, 0)):  # with and without broadcasts
        monkeypatch.setattr(sharding, "HOT", hot)
        monkeypatch.setattr(sharding, "BROADCAST_CLASSES", classes)
        out = sharding.assign_shards(df, F.octet_length(F.coalesce("text", F.lit(""))) + 16, F.col("text"), shards=8)
        assert sorted(out.columns) == sorted([*df.columns, "slot"])
        rows = out.collect()
        assert len(rows) == len(texts) and {(r["_s_size"], r["g"], r["piece"]) for r in rows} == {("own", "own", 2)}
        where, loads, slots = defaultdict(set), Counter(), defaultdict(list)
        for r in rows:
            where[r["text"]].add(r["shard"])
            loads[r["shard"]] += len(r["text"] or "") + 16
            slots[r["shard"]].append(r["slot"])
        assert all(len(s) == 1 for s in where.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        by_group = Counter()
        for t in texts:
            by_group[t] += len(t or "") + 16
        want = Counter()
        for (size, _), x in zip(sorted(Counter(by_group.values()).items(), reverse=True), one_by_one(list(Counter(by_group.values()).items()), 8), strict=True):
            for k, n in x:
                want[k] += size * n
        assert loads == want
    assert sharding.assign_shards(df.limit(0), F.lit(1), F.col("text"), shards=3).count() == 0


def test_sharding_query_columns(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in sharding.op4_sharding(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        data = (r["text"] or "").encode()
        assert (got[r["doc_id"]]["size"], got[r["doc_id"]]["text_crc32"], got[r["doc_id"]]["law"], got[r["doc_id"]]["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)


# packing


def check_pieces(rows, ids, window=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d])
            assert r["ids_crc32"] == zlib.crc32(ids[d][at : at + r["length"]].astype("<u4").tobytes())
            at += r["length"]
        assert at == len(ids[d])
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        lengths.append(at)
    return lengths


def test_every_token_is_in_one_piece(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 900))) for _ in range(60)] + [None, "", "same", "same", "y " * 9000]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in enumerate(texts)}
    for shard_tokens, task_bytes in ((1 << 20, 1 << 30), (9_000, 1 << 30), (9_000, 20_000)):
        rows = packing.pack_documents(docs(spark, texts), shard_tokens=shard_tokens, task_bytes=task_bytes).collect()
        lengths = check_pieces(rows, ids)
        assert sum(n < 2048 for n in lengths) <= len(texts) // 2 if shard_tokens < 1 << 20 else sum(n < 2048 for n in lengths) <= 1
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_packing_does_not_depend_on_the_partitioning(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(90)], k=rng.randint(0, 400))) for _ in range(80)] + ["same"] * 30
    df = docs(spark, texts)
    for tasks in ((1 << 30,) * 2, (1 << 30, 8_000), (8_000,) * 2):
        found = [sorted(map(tuple, packing.pack_documents(x, shard_tokens=2_000, task_bytes=n).collect())) for x, n in zip((df.coalesce(1), df.repartition(7, "n_chars")), tasks, strict=True)]
        assert found[0] == found[1]


def test_shards_are_equal_stretches_of_the_order(spark):
    rows = [(i, np.array([i % 7 + 2, 1], "<u2").tobytes(), 5_000 if i % 3 == 0 else i % 600, 92) for i in range(3_000)]  # a third under one key
    shards, n = packing.in_shards(spark.createDataFrame(rows, "_id bigint, _ids binary, _key bigint, _n bigint").repartition(5), 20_000)
    found = [(r["_shard"], r["_key"]) for r in shards.select("_shard", "_key").collect()]
    sizes = Counter(s for s, _ in found)
    assert len(found) == 3_000 and n == 15 and set(sizes) == set(range(15)) and max(sizes.values()) < 1.5 * 200
    by_key = defaultdict(set)
    for s, k in found:
        by_key[k].add(s)
    ends = [(min(by_key[k]), max(by_key[k])) for k in sorted(by_key)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False)) and len(by_key[5_000]) >= 5


def test_packing_odd_tables(spark):
    df = spark.createDataFrame([(None, None, 1), (None, "", 1), (3, "a b", 1), (3, "a b", 1)], "doc_id bigint, text string, start bigint").withColumns({"_ids": F.lit("x"), "_key": F.lit("y"), "length": F.lit(0)})
    rows = packing.pack_documents(df).collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in rows) == [(-1, 1), (-1, 1), (3, 3), (3, 3)]


def test_neighbours_share_terms():
    rng = np.random.default_rng(0)
    groups = [rng.choice(np.arange(100 * g + 2, 100 * g + 60), 40) for g in range(5)]
    found = [rng.permutation(groups[k % 5]) for k in range(50)]
    index = packing.ShardIndex(found)
    free = np.ones(50, np.float32)
    near = list(index.neighbours(7, free))
    assert sorted(near) == list(range(2, 50, 5))
    free[near[:4]] = 0
    assert list(index.neighbours(7, free)) == near[4:]


def test_scores_and_order_are_those_of_bm25():
    rng = np.random.default_rng(1)
    found = [np.append(rng.choice(np.minimum(rng.zipf(1.3, 400), 900) + 1, rng.integers(3, 300)), 1) for _ in range(300)]
    found += [found[0]] * 150  # a third of the rows are copies
    index = packing.ShardIndex(found)
    n, mean = len(found), np.mean([len(d) for d in found])
    df = Counter(t for d in found for t in set(d.tolist()))
    free = (rng.random(n) < 0.7).astype(np.float32)

    def brute(seed, doc):
        tf, total = Counter(found[doc].tolist()), 0.0
        for t in set(found[seed].tolist()) & set(tf):
            total += np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(found[doc]) / mean))
        return total

    for seed in (0, 1, 17, 320, 449):
        assert np.allclose(index.scores(seed), [brute(seed, index.members[k]) for k in index.member_at[:-1]], rtol=1e-4)
        got = list(index.neighbours(seed, free))  # all of them, in order
        assert sorted(got) == [d for d in np.flatnonzero(free) if brute(seed, d) > 0]
        scores = [brute(seed, d) for d in got]
        assert np.allclose(scores, sorted(scores, reverse=True), rtol=1e-4)


def test_close_documents_lie_together():
    rng = np.random.default_rng(4)
    topics = [rng.choice(np.arange(2, 900), 60, replace=False) for _ in range(8)]
    found = [np.append(rng.choice(topics[i % 8], 80), 1) for i in range(480)]
    keys = packing.Closeness.learned(found[:200], 1000).keys(found)
    order = np.argsort(keys, kind="stable")
    near = [np.mean([j % 8 == i % 8 for j in order[max(0, k - 20) : k + 20]]) for k, i in enumerate(order)]
    assert np.mean(near) > 0.6
    assert len(set(packing.Closeness.learned(found[:200], 1000).keys([found[3]] * 9))) == 1
    assert packing.Closeness.learned([], 1000).keys(found[:2]).tolist() == [2048, 2048]


def test_statistics_are_of_the_whole_corpus(spark):
    ids = spark.createDataFrame([(np.array(x, "<u2").tobytes(),) for x in ([5, 6, 1], [5, 1], [5, 7, 7, 1], [1])], "_ids binary").repartition(3)
    corpus = packing.corpus_statistics(ids, "<u2")
    assert np.allclose(corpus.idf[[1, 5, 6, 7]], np.log1p((4 - np.array([4, 3, 1, 1]) + 0.5) / (np.array([4, 3, 1, 1]) + 0.5))) and corpus.mean == 10 / 4


# chat


def test_escaping_is_reversible():
    rng = random.Random(0)
    parts = ["<", "|", "\\", "s>", "/", "[", "INST]", "<SYS>>", "x", "\n", ">", "<|end|>\n", "<|turn|>", "</s>"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(8))
        assert chat.unescape(chat.escape(t)) == t
        assert "<|" not in chat.escape(t)
        assert list(chat.parse("".join(chat.turn_parts(t, t)))) == [(t, t)]


CHAT = "conv_id bigint, turn bigint, role string, text string"


def test_windows_say_what_the_conversations_say(spark):
    rng = random.Random(5)
    rows = []
    for c in [None, *range(30)]:
        n = 400 if c == 3 else rng.randint(1, 12)
        for k in range(n):
            role = "system" if k == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", None])
            rows.append((c, k if rng.random() < 0.9 else 0, role, rng.choice([None, "", "</s>[INST] ok", "word " * rng.randint(1, 400), "é<|end|>\n"])))
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame(rows, CHAT)
    windows = chat.format_chat(df, budget=300, history=80)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    by = defaultdict(list)
    for c, k, role, text in rows:
        by[c].append((k, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for w in windows.collect():
        over = w["n_tokens"] > 300
        assert not over or w["n_turns"] == 1
        assert w["n_turns"] + w["n_repeated"] == len(list(chat.parse(w["text"])))
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


def test_the_system_turn_is_repeated(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", f"turn {k} " + "word " * 60) for k in range(1, 12)]
    windows = chat.format_chat(spark.createDataFrame(rows, CHAT), budget=260, history=110).orderBy("window").collect()
    assert len(windows) > 2
    assert all(next(chat.parse(w["text"])) == ("system", "be kind") for w in windows)
    assert all(w["n_repeated"] == 2 for w in windows[1:])


# pipeline


def test_pipeline_on_planted_documents(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        rows.append((i, prose(80) + (" scumbag vermin scumbag" if toxic else ""), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    item = " ".join(vocabulary[:40])
    near = prose(200)
    rows += [(1000, f"{prose(50)} {item}", "en", "s", 0), (1001, near, "en", "s", 0), (1002, near, "en", "s", 0), (1003, near.replace(near.split()[100], "changed", 1), "en", "s", 0), (1004, prose(60) + " write to ann@mail.example.com", "en", "s", 0), (1005, None, "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r["doc_id"] for r in df.select("doc_id").collect()})
    clean = {i for i in range(300) if i % 5}
    assert left[0] == clean | set(range(1000, 1006))
    assert left[1] == left[0] - {1002, 1003} or left[1] == left[0] - {1002}
    assert left[2] == left[1] - {1000} and left[3] == left[2]
    assert "[EMAIL]" in df.filter("doc_id = 1004").first()["text"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in df.collect()}
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect(), ids)
    check_pieces(corpus_pipeline.run(spark, str(tmp_path)).collect(), ids)


def test_ids_and_columns_of_any_type(spark):
    """String ids, null ids, and columns with maps, in the pipeline's filters and in sharding."""
    from tessera.llm import decontaminate

    long = " ".join(f"w{k}" for k in range(40))
    rows = [("b", long, {"k": 1}), ("a", long, {"k": 2}), (None, long + " x", {"k": 1}), ("c", "other words stand here alone", None), (None, None, None), (None, None, None), ("d", "", {"z": 0})]
    df = spark.createDataFrame(rows, "doc_id string, text string, m map<string, int>").repartition(3)
    kept = simhash.keep_first(df).collect()
    assert sorted((r["doc_id"], r["m"]["k"] if r["doc_id"] == "a" else None) for r in kept) == [("a", 2), ("c", None), ("d", None)]
    placed = sharding.assign_shards(df, F.length("text"), F.col("text"), 3)
    assert placed.columns == ["doc_id", "text", "m", "shard", "slot"] and placed.count() == 7
    bench = spark.createDataFrame([("q-1", long), ("q-2", "nothing of it"), (None, long)], "item_id string, text string")
    for options in ({}, {"block_bytes": 0, "filter_bits": 12}):
        found = {(r["doc_id"], tuple(r["contamination"]["items"])) for r in decontaminate.find_contamination(df, bench, **options).filter("text is not null").collect()}
        assert found == {("a", ("q-1",)), ("b", ("q-1",)), (None, ("q-1",)), ("c", ()), ("d", ())}


def test_a_schedule_is_written_in_parts(spark, monkeypatch):
    rows = [(k, k % 97 + 1) for k in range(2000)]
    df = spark.createDataFrame(rows, "g long, size long")
    whole = {(r["g"], r["shard"]) for r in sharding.assign_shards(df, F.col("size"), F.col("g"), 7).collect()}
    monkeypatch.setattr(sharding, "PART_CLASSES", 10)
    parts = sharding.assign_shards(df, F.col("size"), F.col("g"), 7)
    loads = sorted(r["s"] for r in parts.groupBy("shard").agg(F.sum("size").alias("s")).collect())
    assert len(whole) == 2000 and loads[-1] - loads[0] <= 1
