"""Packing, the prefix trie and the alignment of tokenizers against brute force and the libraries, and on odd input."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import queries as Q
from ledgerlens.llm.alignment import align_tokenizers
from ledgerlens.llm.packing import combinations, pack_documents, plan_windows, repeat_counts, whole_counts
from ledgerlens.llm.prefix_trie import TernaryTree, conversation_trie

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  \n\t ", "one", "<|endoftext|>", "a<|endoftext|>b <s> </s> <0x41>", "y" * 9000, "漢字 😀 é " * 900, "a▁b", "\x00 \x1c x", "tab\tand  two", "ﬁ ² ½ Ⅳ", "same text", "same text", " " * 3_000_000]


def odd(spark, with_long=True):
    rng = random.Random(4)
    texts = [t for t in ODD if with_long or len(t or "") < 100_000] + [" ".join(rng.choice(["the", "of", "Ünï", "x1", "thing,"]) for _ in range(rng.randrange(2500))) for _ in range(40)]
    rows = [(k, t, "x", 1, 2) for k, t in enumerate(texts)] + [(None, "no id", "x", 1, 2), (3, texts[3], "x", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, block int, n int").repartition(3)


@pytest.fixture(scope="module")
def paths():
    tokens = pytest.importorskip("public_tokenizers")
    return tokens.path("byte_bpe_50k.json"), tokens.path("piece_bpe_32k.model")


def covered(plan, histogram, window):
    """The plan places each id of each rest once and fills each sequence from 0 on; returns the sequences' sizes."""
    ids, sizes = collections.Counter(), collections.defaultdict(list)
    for length, start, low, high, n, sequence, offset in plan.tolist():
        for k in range(low, high):
            ids[length, k] += n
            sizes[sequence + k - low].append((offset, n))
    assert ids == {(length, k): length for length in range(1, window) for k in range(histogram[length])}
    for parts in sizes.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    return {s: sum(n for _, n in parts) for s, parts in sizes.items()}


def test_plans_fill_windows():
    rng = np.random.default_rng(1)
    for window, lengths in ((64, rng.integers(1, 64, 3000)), (64, np.full(50, 43)), (64, []), (32, [1, 3]), (128, rng.integers(100, 128, 400)), (1024, rng.integers(1, 1024, 5000))):
        histogram = np.bincount(np.array(lengths, int), minlength=window)
        plan, n = plan_windows(histogram, window)
        sizes = covered(plan, histogram, window)
        assert sorted(sizes) == list(range(n))
        assert all(s & (s - 1) == 0 for s in sizes.values()) and sum(s != window for s in sizes.values()) <= window.bit_length()


def test_repeat_counts_are_least_squares():
    combos = combinations(12)
    assert {tuple(sorted(c[c > 0])) for c in combos} == {(a, 12 - a) for a in range(1, 7)} | {tuple(sorted((a, b, 12 - a - b))) for a in range(1, 11) for b in range(1, 12 - a)}
    histogram = np.random.default_rng(3).integers(0, 50, 12).astype(float)
    histogram[0] = 0
    x = repeat_counts(histogram, combos, steps=20_000, tolerance=0)
    a = np.zeros((12, len(combos)))
    for k, c in enumerate(combos):
        np.add.at(a[:, k], c[c > 0], 1)
    slope = a.T @ (a @ x - histogram)
    # The conditions of a least square under x >= 0: no slope where x > 0, none downwards where x = 0.
    assert (x >= 0).all() and np.abs(slope[x > 1e-3]).max(initial=0) < 1e-2 and slope.min() > -1e-2
    counts = whole_counts(x, combos, histogram)
    assert (a @ counts <= histogram).all() and counts.sum() >= 0.7 * x.sum()


def test_packing(spark, paths):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(paths[0])
    docs = odd(spark)
    texts = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    text_of = {r.k: r.text for r in docs.select(F.xxhash64("text").alias("k"), "text").collect()}
    for window in (1024, 64):
        pieces = pack_documents(docs.withColumn("k", F.xxhash64("text")), window=window, keep=["doc_id", "k"], with_ids=True).collect()
        sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
        for p in pieces:
            assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
            sequences[p.sequence_id].append((p.offset, p.length))
            documents[p.doc_id, text_of[p.k]].append((p.start, p.length, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
        for parts in sequences.values():
            parts.sort()
            total = sum(n for _, n in parts)
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and (total == window or total & (total - 1) == 0)
        assert sum(sum(n for _, n in parts) != window for parts in sequences.values()) <= window.bit_length()
        assert documents.keys() == texts.keys()
        for (doc, text), parts in documents.items():
            want = [*library.encode(text or "", add_special_tokens=False).ids, 0]
            parts.sort()
            copies = texts[doc, text]
            assert {p[3] for p in parts} == {len(want)} and sum(p[1] for p in parts) == copies * len(want)
            assert all(want[s : s + n] == ids for s, n, ids, _ in parts)
    assert pack_documents(docs.limit(0)).count() == 0


def test_packing_of_one_length(spark):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("the " * 699).alias("text")).repartition(5)
    pieces = pack_documents(docs)
    assert pieces.agg(F.sum("length")).first()[0] == pieces.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
    sizes = [r.n for r in pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).filter("n = end").collect()]
    assert len(sizes) == pieces.select("sequence_id").distinct().count() and all(n & (n - 1) == 0 for n in sizes)


def brute_trie(rows):
    conversations = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        conversations[conv].append((turn is not None, turn or 0, digest, role, text))
    lists = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in conversations.items() if c is not None}
    rebuilt = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = lists.get(first, [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, below = collections.Counter(k[:-1] for k in members if k), collections.defaultdict(lambda: [0, 0])
    for k, got in members.items():
        for d in range(len(k) + 1):
            below[k[:d]][0] += not kids[k]
            below[k[:d]][1] += (len(got) - 1) * (len(k[-1][1].encode()) if k else 0)
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if len(rebuilt[c]) == len(k)))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], *below[k], digest(k)) for k, m in members.items())


def trie_rows(kind):
    rng = random.Random(kind)
    if kind == "shared":  # one conversation again and again, and long ones that part late
        rows = [(5 * c, t, "user", f"t{t}") for c in range(60) for t in range(12)]
        return rows + [(5 * c + 1, t, "user", f"t{t}" if t < 8 + c % 30 else f"own{c % 7}") for c in range(60) for t in range(40)]
    rows = [(rng.randrange(-30, 90), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", None, ""]), rng.choice([None, "", "a", "ä", "b c", "1:x"])) for _ in range(700)]
    return rows + [(None, 1, "user", "no conversation"), rows[0], rows[0]]


@pytest.mark.parametrize("kind", ["odd", "shared"])
@pytest.mark.parametrize("shard", [200_000, 40, 1])
def test_trie(spark, monkeypatch, kind, shard):
    monkeypatch.setattr("ledgerlens.llm.prefix_trie.RUN", 2)
    rows = trie_rows(kind)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int").repartition(5)
    got = conversation_trie(df, shard_turns=shard).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(brute_trie(rows), key=lambda r: r[:2])
    assert conversation_trie(df.limit(0)).count() == 0


def test_ternary_trees():
    rng = random.Random(7)
    sequences = sorted({tuple(rng.randrange(9) for _ in range(rng.randrange(6))) for _ in range(400)} | {(1,) * 5000})
    tree = TernaryTree.balanced([list(s) for s in sequences])
    nodes, parents, depths = tree.walk()
    assert len(nodes) == len({s[:d] for s in sequences for d in range(len(s) + 1)})
    found = {tree.end[x]: d for x, d in zip(nodes, depths) if tree.end[x] >= 0}
    assert found == {i: len(s) for i, s in enumerate(sequences)} and all(p < i for i, p in enumerate(parents))


def brute_alignment(rows, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    from ledgerlens.llm.bpe import byte_symbols

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    byte_of = {s: k for k, s in enumerate(byte_symbols())}
    shown = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    docs, linked = [], collections.Counter()
    for text in rows:
        ids, ends = ([], []), ([], [])
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            data = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]], [shown(b.id_to_piece(i)) for i in ids[1]]
            if not b"".join(data[0]) == b"".join(data[1]) == (" " + text).encode():
                ids = ([], [])
            else:
                ends = [np.cumsum([len(x) for x in d]).tolist() for d in data]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        for cut in cuts:
            to = [e.index(cut) + 1 for e in ends]
            groups.append((ids[0][at[0] : to[0]], ids[1][at[1] : to[1]]))
            at = to
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        linked.update(set(links))
        docs.append((ids, groups, links))
    most = collections.defaultdict(int)
    for (x, _), n in linked.items():
        most[x] = max(most[x], n)
    out = []
    for ids, groups, links in docs:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(ids[0]), len(ids[1]), len(groups), len(links), sum(linked[p] == most[p[0]] for p in links), sum(linked[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return out


@pytest.mark.parametrize(("block", "wide"), [(16 << 20, 1 << 14), (5000, 2)])
def test_alignment(spark, paths, monkeypatch, block, wide):
    monkeypatch.setattr("ledgerlens.llm.alignment.BLOCK", block)
    monkeypatch.setattr("ledgerlens.llm.alignment.SLICE", block // 8)
    monkeypatch.setattr("ledgerlens.llm.alignment.WIDE", wide)
    docs = odd(spark, with_long=False).unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(50).select("doc_id", "text", F.lit("x").alias("start"), F.lit(1).alias("block"), F.lit(2).alias("n")))
    rows = docs.collect()
    got = collections.Counter((r.kept.doc_id, r.kept.block, *r[1:7], r.groups_sha256) for r in align_tokenizers(docs, keep=["doc_id", "block"]).collect())
    assert got == collections.Counter((r.doc_id, r.block, *want) for r, want in zip(rows, brute_alignment([r.text for r in rows], paths)))
    told = align_tokenizers(docs, with_groups=True).filter("n_groups > 0").collect()
    assert told and all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in told)
    assert align_tokenizers(docs.limit(0)).count() == 0 and align_tokenizers(docs.filter("text is null")).count() == 1


def test_queries_return_their_columns(spark):
    assert Q.op11_packing(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert Q.op13_alignment(spark, SF).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Q.op12_prefix_trie(spark, SF).columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
