"""The training-data operators against brute force, libraries and round trips, and on odd input."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import queries as Q
from ledgerlens.llm.bpe import Vocabulary, encode_decode
from ledgerlens.llm.chat import format_conversations, loss_text, read_back
from ledgerlens.llm.common import PRIME, text_hashes, text_sums, times_mod
from ledgerlens.llm.components import connected_components
from ledgerlens.llm.media import header, media_columns, padded
from ledgerlens.llm.mixing import mix_sources
from ledgerlens.llm.near_dedup import bands_and_sketches, bands_for, most_bits, near_duplicates, sketch_miss
from ledgerlens.llm.quality import fit_quality, rate_quality
from ledgerlens.llm.shards import Leaf, assign_shards, layout, shard_of
from ledgerlens.llm.suffix_dedup import BlindTrie, multikey_quicksort, remove_repeats
from ledgerlens.llm.token_counts import PrefixCounter, count_tokens
from ledgerlens.llm.toxicity import fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, size string, quality string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"wort{k * 7919 % 1000}" for k in range(60))


def odd_rows():
    rng = random.Random(5)
    words = ["the", "Ünï", "x", "a1", "漢字", "😀", "ing", "</s>", "<|endoftext|>", "&amp;"]
    long = " ".join(rng.choice(words) + str(rng.randrange(3000)) for _ in range(20_000))
    one = "y" * 50_000
    texts = [None, "", " \n\t ", "one", "two words", long, one, PASSAGE, f"before {PASSAGE} after", f"other\n{PASSAGE}", "\x00 nul \x1c x", "line\nline\nline\n", PASSAGE + " tail"]
    base = [f"w{k}" for k in range(300)]
    for k in range(6):
        near = list(base)
        near[k * 20] = f"changed{k}"
        texts.append(" ".join(near))
    texts += ["same text of some words that comes again and again"] * 4
    sources = ["b", None, "a", "é"]
    rows = [(i, t, None if i % 5 == 0 else "en", sources[i % 4], None, "k", "s", "q", "z") for i, t in enumerate(texts)]
    return rows + [rows[7], (None, "no id here at all", "en", "b", 1, "k", "s", "q", "z")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, None), (3, None, 1), (3, 1, 0), (7, 1, 1), (8, 1, 0), (9, 0, 0), (None, 1, 1), (10, 0, 1), (11, 0, 0), (12, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", [q for q in Q.QUERIES if q in Q.ORACLES])
def test_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours = Q.QUERIES[name](spark, SF)
    theirs = con.execute(Q.ORACLES[name])
    at = [[c[0] for c in theirs.description].index(x) for x in ours.columns]
    assert sorted(tuple(map(str, r)) for r in ours.collect()) == sorted(tuple(str(r[i]) for i in at) for r in theirs.fetchall())


def test_toxicity_learns_and_survives(spark, odd, nothing, labels):
    rows = [(k, f"plain text number {k} of nothing much" + (" idiot moron" if k % 3 == 0 else ""), None, None, None, "", "", "", "") for k in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA)
    toxic = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    got = score_toxicity(docs, fit_toxicity(docs, toxic)).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got)
    model = fit_toxicity(odd, labels)
    assert score_toxicity(odd, model).count() == len(odd_rows()) and score_toxicity(nothing, model).count() == 0
    empty = fit_toxicity(nothing, labels)
    assert all(0 <= r.score <= 1 for r in score_toxicity(odd, empty).collect())


def test_shards(spark, odd, nothing):
    got = assign_shards(odd).collect()
    assert len(got) == len(odd_rows()) and all(r.grown_shard in (r.shard, 16) for r in got)
    for shard, rows in collections.defaultdict(list, {s: [r.slot for r in got if r.shard == s] for s in {r.shard for r in got}}).items():
        assert sorted(rows) == list(range(len(rows))), shard
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    sizes = [r["count"] for r in assign_shards(many).groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.2 * min(sizes)
    assert assign_shards(nothing).count() == 0 and len(layout(19)) == 19
    with pytest.raises(ValueError):
        assign_shards(many, shards=7)
    for planned, shards in ((3, 3), (7, 7), (16, 17)):
        assert assign_shards(many, shards, planned).filter(f"grown_shard not in (shard, {shards})").count() == 0
    # A changed weight moves rows only into or out of the region that has it.
    tree = layout(16)
    heavier = [Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree]
    moved = many.select(shard_of(F.col("doc_id").cast("string"), tree).alias("a"), shard_of(F.col("doc_id").cast("string"), heavier).alias("b")).filter("a <> b").distinct().collect()
    assert moved and all(1 in (tree[r.a].region, tree[r.b].region) for r in moved)


@pytest.fixture(scope="module")
def library():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def test_tokens_equal_the_library(odd, nothing, library):
    path, tokenizer = library
    counts = {r.doc_id: r for r in count_tokens(odd, path=path, budget=5).collect()}
    coded = {r.doc_id: r for r in encode_decode(odd, path=path, with_ids=True).collect()}
    for row in odd.collect():
        want = tokenizer.encode(row.text or "", add_special_tokens=False).ids
        assert counts[row.doc_id].n_tokens == coded[row.doc_id].n_tokens == len(want)
        assert coded[row.doc_id].ids == want
        assert coded[row.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert coded[row.doc_id].decoded_sha256 == hashlib.sha256(tokenizer.decode(want, skip_special_tokens=False).encode()).hexdigest()
        cut = (row.text or "")[: counts[row.doc_id].prefix_chars]
        n = [len(tokenizer.encode((row.text or "")[:i], add_special_tokens=False).ids) for i in range(min(len(cut) + 40, len(row.text or "")) + 1)]
        assert max(i for i, x in enumerate(n) if x <= 5) == len(cut)
    copies = odd.select("doc_id", F.explode(F.array_repeat(F.coalesce("text", F.lit("")), 3)).alias("text"))
    again = encode_decode(copies, path=path, with_ids=True, with_decoded=True).groupBy("doc_id").agg(F.collect_set("ids_sha256").alias("x"), F.count_if(F.sha2("decoded", 256) != F.col("decoded_sha256")).alias("bad"))
    assert all(r.x == [coded[r.doc_id].ids_sha256] and not r.bad for r in again.collect())
    assert count_tokens(nothing, path=path).count() == 0 and encode_decode(nothing, path=path).count() == 0


def test_prefix_counts_and_streams(library):
    path, tokenizer = library
    vocab = Vocabulary(path)
    counter, rng = PrefixCounter(vocab), random.Random(1)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(60):
        word = "".join(rng.choice("aehnorstiz") for _ in range(rng.randrange(1, 30)))
        assert counter.prefix_counts(word) == [len(ids(word[:i])) for i in range(len(word) + 1)]
    for letters in ("a", "ab", "the", "tion"):
        word = "".join(rng.choice(letters) for _ in range(8 * vocab.lookahead))
        assert [vocab.ids[t] for t in vocab.stream(word)] == ids(word)


def test_every_prefix_without_encoding_again(library):
    path, tokenizer = library
    counter = PrefixCounter(Vocabulary(path))
    ids = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    for text in ("say<|endoftext|>it's don't<|startoftext|><|endoftext|>end", "x" * 120 + "é" * 60, "e\u0301 a<|endoftext", "漢字'll 12", "İ<|endoftext|>ß", "a<b <| |> <|endoftext|>"):
        table = counter.table(text)
        assert table.every() == [ids(text[:i]) for i in range(len(text) + 1)]
        for budget in range(table.total + 1):
            assert table.longest_prefix(budget) == max(i for i in range(len(text) + 1) if ids(text[:i]) <= budget)
    began = time.time()
    word = "".join(random.Random(3).choice("etaoin") for _ in range(50_000))
    assert counter.table(word).every()[-1] == ids(word) and time.time() - began < 60


def test_chat_reads_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<sep>", "&lt;", "", None, "a\nb", "<s user>x</s>"]
    roles = ["user", "assistant", "assistant", "user", None, "sys<>&", "assistant"]
    rows = [(c, t, roles[(c + t) % 7], texts[(2 * c + t) % 7]) for c in range(8) for t in range(7)] + [(None, None, "user", "x"), (1, 3, "user", "tie"), (1, 3, "user", "tie")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, t int").repartition(4)
    back = read_back(format_conversations(df)).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_runs"))).collect()
    for r in back:
        want = sorted([x for x in rows if x[0] == r.conv_id], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in want]
        assert r.loss == "".join(x[3] or "" for x in want if x[2] == "assistant")
    assert format_conversations(df.limit(0)).count() == 0


def counted(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(spark, odd, nothing, labels):
    model = fit_quality(odd, labels)
    docs = odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rate_quality(docs, model).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert rate_quality(nothing, model).count() == 0
    assert "quality" in rate_quality(odd, fit_quality(nothing, labels), keep_text=True).columns


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def linked(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[find(k)].append(i)
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd, nothing, n, percent):
    rows = [(r.doc_id, r.text) for r in odd.filter("doc_id is not null").collect()]
    want = linked(rows, n, percent)
    for r in near_duplicates(odd.filter("doc_id is not null"), n, percent).collect():
        assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert near_duplicates(odd).count() == len(odd_rows()) and near_duplicates(nothing).count() == 0


def test_near_duplicates_without_ids_and_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("ledgerlens.llm.near_dedup.BLOCK", 3)
    monkeypatch.setattr("ledgerlens.llm.near_dedup.BLOCK_SETS", 3)
    base = [f"w{k}" for k in range(200)]
    near = [(None if k == 3 else 50 - k, " ".join([*base[:k], "other", *base[k + 1 :]])) for k in range(20)]
    rows = spark.createDataFrame([*near, (None, "alone here with some words"), (None, None), (60, None)], "doc_id long, text string")
    for salted in (50_000, -1):
        monkeypatch.setattr("ledgerlens.llm.common.BROADCAST_KEYS", salted)
        got = near_duplicates(rows).collect()
        assert sorted(r.component_id for r in got if r.n_shingles > 100) == [31] * 20 and sum(r.kept for r in got if r.n_shingles > 100) == 1
        assert all(r.kept and r.component_id == r.doc_id for r in got if r.n_shingles < 100)


def test_sketches_lose_no_link():
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        lost = 0
        for _ in range(300):
            both, n = 400, 400 * 100 // percent - 400
            shared, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (both, n // 2, n - n // 2))
            sets = [np.unique(np.concatenate([shared, x])) for x in (a, b)]
            h, offsets = np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
            keys, sketches = bands_and_sketches(h, offsets, bands_for(percent))
            lost += not (keys[0] == keys[1]).any() or int(np.bitwise_count(sketches[0] ^ sketches[1]).sum()) > most_bits(percent)
        assert lost == 0 and sketch_miss(percent) < 3e-6


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(60)] + [(None, 5), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(61)} == {0} and all(got[got[k]] == got[k] <= k for k in got)


def stripped(texts, length):
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = collections.Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        out[i] = (sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    groups = np.sort(rng.integers(0, 20, 500))
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order, start = multikey_quicksort(groups, words, np.zeros(500, np.int64), np.full(500, 4))
    rows = [(int(groups[i]), *words[i].tolist()) for i in order]
    assert rows == sorted(rows) and all((rows[i] == rows[i - 1]) == (start[i] == start[i - 1]) for i in range(1, 500))


@pytest.mark.parametrize(("block", "hot"), [(4096, 2000), (64, 20)])
def test_repeats(spark, odd, nothing, monkeypatch, block, hot):
    monkeypatch.setattr("ledgerlens.llm.suffix_dedup.BLOCK", block)
    monkeypatch.setattr("ledgerlens.llm.suffix_dedup.HOT", hot)
    docs = odd.filter("doc_id is not null").select("doc_id", F.when(F.length("text") < 60_000, F.col("text")).alias("text"), "k1")
    want = stripped([(r.doc_id, r.text) for r in docs.collect()], 200)
    for r in remove_repeats(docs).collect():
        assert (r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert remove_repeats(nothing).count() == 0


def test_blind_trie():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    trie = BlindTrie()
    for s in strings:
        trie.add(s)
    assert [strings[i] for i in trie.ordered()] == sorted(strings)


def test_media(odd, nothing):
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    got = media_columns(odd).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        payload = padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.payload_bytes % 192 == 0
        assert r.media_sha256 == hashlib.sha256(header(len(payload)) + payload).hexdigest()
    assert media_columns(nothing).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_texts_that_collide_modulo_powers_of_two(spark):
    """A Thue-Morse string and its complement have the same sum of codes times powers of any odd number, modulo 2**64."""
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((a + b).encode(), np.uint8)
    sums = text_sums(data)
    for n in (1024, 2048):
        got = text_hashes(sums, np.array([0, 2048]), np.array([n, 2048 + n]))
        assert got[0] != got[1]
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, PRIME, 300, dtype=np.uint64), rng.integers(0, PRIME, 300, dtype=np.uint64)
    assert times_mod(x, y).tolist() == [int(p) * int(q) % PRIME for p, q in zip(x, y)]
    docs = spark.createDataFrame([(1, f"{a} one two"), (2, f"{b} one two"), (3, f"{a}\n{b}"), (4, a), (5, b)], "doc_id long, text string")
    assert all(r.kept for r in near_duplicates(docs).collect())
    model = fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r.n_dup_lines == 0 for r in rate_quality(docs, model).collect())


def targets(sizes, share=1.5, cap=2):
    """Weights 3, 1, 2 in code-point order, nulls last; the excess over cap times a source's size is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / max(sum(weight[s] for s in left), 1)
        over = [s for s in left if level * weight[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in left}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixture(spark, odd, nothing):
    hot = spark.createDataFrame([(1, "a b c", "x")] * 400 + [(k, "w " * (k % 7), "y") for k in range(200)], "doc_id long, text string, source string")
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet"), hot):
        rows = mix_sources(docs).collect()
        assert len(rows) == docs.count()
        sizes = collections.Counter()
        for r in rows:
            sizes[r.source] += r.size
        want = targets(sizes)
        for source in sizes:
            own = [r for r in rows if r.source == source]
            assert abs(own[0].target - want[source]) < 1e-6 * (1 + want[source]) and own[0].source_size == sizes[source]
            assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= max(r.size for r in own)
            assert all(0 <= r.copies <= 2 for r in own)
    again = mix_sources(hot.repartition(7)).groupBy("kept.doc_id", "size").agg(F.sum("copies").alias("n"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mix_sources(hot).groupBy("kept.doc_id", "size").agg(F.sum("copies").alias("n")).collect()))
    assert mix_sources(nothing).count() == 0


def test_mixture_of_sources_without_words(spark):
    rows = [(1, "a b c", "x"), (2, "", "y"), (3, None, "z"), (4, " \n", None), (5, "d", "x")]
    for some in (rows, rows[1:4], rows[2:3]):
        got = mix_sources(spark.createDataFrame(some, "doc_id long, text string, source string")).collect()
        assert len(got) == len(some) and all((r.copies == 0) == (r.size == 0) and (r.target > 0) == (r.size > 0) for r in got)


def run_stages(spark, docs, sf_dir, where):
    """(name, input, output) of every stage, each output written and read again."""
    for name, stage in corpus_pipeline.STAGES:
        path = f"{where}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        yield name, docs, out
        docs = out


def test_pipeline(spark, tmp_path):
    for name, before, out in run_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF, tmp_path):
        assert name == "encoding" or out.columns == corpus_pipeline.COLUMNS
        if name == "near duplicates":
            rows = [(i, r.text) for i, r in enumerate(before.collect())]
            assert out.count() == len(set(linked(rows, 5, 80).values()))
        if name == "repeated passages":
            want = {i: v[0] for i, v in stripped([(r.doc_id, r.text) for r in before.collect()], 200).items()}
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(0 <= len(texts[r.doc_id].encode()) - want[r.doc_id] - len(r.text.encode()) <= 6 * want[r.doc_id] for r in out.collect())
    assert out.count() > 0 and out.filter("n_tokens <> size(ids)").count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, odd, nothing, tmp_path, empty):
    docs = nothing if empty else odd.filter("doc_id is null or doc_id <> 5").unionByName(odd.filter("doc_id is null"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, SF)
        if empty:
            assert out.count() == 0
        elif name == "near duplicates":
            rows = docs.collect()
            # One row of each group stays, ids or not; texts without words all stay.
            assert out.count() == len(set(linked([(i, r.text) for i, r in enumerate(rows)], 5, 80).values()))
        elif name == "mixture":
            n = collections.Counter((r.doc_id, r.text) for r in out.collect())
            want = collections.Counter()
            for r in mix_sources(docs, keep=["doc_id", "text"]).collect():
                want[r.kept.doc_id, r.kept.text] += r.copies
            assert n == +want
        elif name == "repeated passages":
            assert out.count() == docs.count()
