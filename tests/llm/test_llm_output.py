"""Sharding, mixing, token records, packing and the pipeline."""

import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import mixing, packing, sharding, token_records
from loomgraph.llm.common import Scratch
from loomgraph.llm.tokens import encoder, tokenizer_file

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(name))


ODD_TEXTS = [
    "", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "Hello, World! it's 3.14", "é́ ñ İstanbul ΣΑΣ ς", "日本語 テスト 中文", "\x01 \x0b x\x0by", "<|endoftext|> a<|endoftext|>b",
    "foo.\nBar baz\n", "\nfoo bar", "x " * 50, "naïve café x", "🙂🙃 ok", "  a b", "a\x1cb \x1c c", "don't can't we'll", "1234567890 12,345", "\t\tindent  two",
]


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_ids_are_the_librarys(spark, sf_dir, name):
    texts = ODD_TEXTS + [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rng = random.Random(3)
    for _ in range(300):
        texts.append("".join(rng.choice([" ", " ", "\n", "a", "b'", "é", "1", ".", "S", "\x0b", "　", "́", "日"]) for _ in range(rng.randrange(1, 30))))
    enc, lib = encoder(tokenizer_file(name)), library(name)
    assert enc.kind is not None
    for at in range(0, len(texts), 64):
        part = texts[at : at + 64]
        want = [e.ids for e in lib.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(part)] == want


def test_generations_change_nothing(monkeypatch):
    from loomgraph.llm import tokens

    monkeypatch.setattr(tokens, "GENERATION", 20)
    enc, lib = tokens.Encoder(tokenizer_file(BYTE)), library(BYTE)
    rng = random.Random(5)
    for _ in range(30):
        part = [" ".join(f"w{rng.randrange(60)}" for _ in range(8)) for _ in range(4)]
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(part)] == [e.ids for e in lib.encode_batch(part, add_special_tokens=False)]


# Token records


def test_records_round_trip(spark, sf_dir):
    lib, start = library(WORD), 0
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in token_records.op9_token_records(spark, sf_dir).collect()} == want


def test_frames_and_damage():
    ids = np.array([1, 2, 49407], "<u4").tobytes()
    content = b"".join(token_records.frame(i, ids, w) + b"\n" for i, w in ((5, 2), (None, 4), (-3, 4)))
    got = list(token_records.frames(content))
    assert [(g[2], g[3]) for g in got] == [(5, ids), (None, ids), (-3, ids)]
    assert sum(g[1] for g in got) == len(content) and [g[0] for g in got][0] == 0
    for at in range(len(content)):
        bad = bytearray(content)
        bad[at] ^= 0x10
        with pytest.raises((ValueError, struct.error)):
            list(token_records.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(token_records.frames(content[:-1]))


def test_records_of_odd_rows(spark):
    scratch = Scratch(spark, "test-records")
    docs = spark.createDataFrame([(2, "b"), (None, "n"), (1, None), (2, "a"), (2, "b")], "doc_id long, text string").selectExpr("*", "1 AS frame", "2 AS start")
    folder = scratch.path("records")
    token_records.write_records(docs, folder, tokenizer_file(WORD), 1)
    index = token_records.build_index(spark, folder, scratch.path("index"))
    rows = index.orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 2]
    assert [r.start for r in rows] == list(itertools.accumulate([r.n_tokens for r in rows], initial=0))[:-1]
    shuffled = token_records.shuffled_reads(index, 1).collect()
    assert len(shuffled) == 5
    content = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").load(folder).select("path", "content").collect()}
    for r in shuffled:  # a record is read by its place alone
        (one,) = token_records.frames(content[r.file][r.offset : r.offset + r.length])
        assert one[2] == r.doc_id and len(one[3]) == 4 * r.n_tokens
    empty = scratch.path("empty")
    token_records.write_records(docs.limit(0), empty, tokenizer_file(WORD), 1)
    assert token_records.build_index(spark, empty, scratch.path("empty-index")).count() == 0


# Packing


def check_packed(rows, texts, capacity=2048):
    lib = library(BYTE)
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, text in texts.items():
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert len(parts) == math.ceil(len(ids) / capacity)
        for k, p in enumerate(parts):
            assert (p.piece, p.start) == (k, at) and (k == 0 or p.length == capacity)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_packing_on_the_table(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = packing.op10_best_fit_packing(spark, sf_dir).collect()
    n_bins, total = check_packed(rows, texts), sum(r.length for r in rows)
    assert n_bins <= math.ceil(total / 2048) * 1.02 + 1


def test_packing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 5000)], "doc_id long, text string").selectExpr("*", "1 AS rank", "2 AS length")
    rows = packing.pack(docs, tokenizer_file(BYTE), 0).collect()
    assert len(rows) == 4 + math.ceil(len([*library(BYTE).encode("word " * 5000, add_special_tokens=False).ids, 0]) / 2048)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(docs.limit(0), tokenizer_file(BYTE), 0).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_the_fullest(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randrange(1, 25) for _ in range(9))
    room = rng.randrange(1, 60)
    lengths = sorted(counts, reverse=True)
    chosen = packing.fullest(lengths, counts, room)
    assert all(k <= counts[n] for n, k in chosen.items())
    pool = list(counts.elements())
    best = max(s for r in range(len(pool) + 1) for c in itertools.combinations(pool, r) if (s := sum(c)) <= room)
    assert sum(n * k for n, k in chosen.items()) == best


def test_places_hold_each_piece_once():
    rng = random.Random(2)
    histogram = dict(Counter(rng.randrange(1, 65) for _ in range(3000)))
    ranks, bins = defaultdict(list), defaultdict(list)
    for n, low, high, per_bin, first, at in packing.places(histogram, 64):
        for rank in range(low, high):
            ranks[n].append(rank)
            bins[first + (rank - low) // per_bin].append((at + (rank - low) % per_bin * n, n))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for places in bins.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 64


# Mixing


def test_exponent_against_brute_force(spark):
    tokens = [1000, 400, 30, 7, 1]
    sources = spark.createDataFrame(list(zip("abcde", tokens)), "key string, tokens long")
    p = np.array(tokens) / sum(tokens)

    def entropy(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum()

    for share in (0.6, 0.8, 0.98):
        a = mixing.exponent(sources, mixing.Target(share, None))
        assert entropy(a) == pytest.approx(share * np.log(5), abs=1e-4)
    a = mixing.exponent(sources, mixing.Target(0.98, 4.0))
    w = p**a / (p**a).sum()
    assert (w / p).max() == pytest.approx(4.0, abs=1e-3)
    assert mixing.exponent(sources, mixing.Target(0.1, None)) == 1.0
    assert mixing.exponent(sources.limit(0), mixing.Target()) == 1.0


def test_mix_meets_budgets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mix = mixing.decide(docs, Scratch(spark, "test-mix"))
    rows = mixing.realise(docs, mix).select("doc_id", "_key", "_tokens", "_epoch").toPandas()
    longest = docs.select(F.max(mixing.token_count(F.col("text")))).first()[0]
    for s in mix.sources.collect():
        here = rows[rows._key == s.key]
        got = here._tokens.sum()
        assert s.budget - longest <= got <= s.budget
        per_doc = here.groupby("doc_id").size()
        assert s.epochs <= per_doc.max() <= s.epochs + 1
    again = mixing.realise(docs, mix).select("doc_id", "_key", "_tokens", "_epoch").toPandas()
    assert sorted(map(tuple, rows.to_numpy())) == sorted(map(tuple, again.to_numpy()))


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "a", ""), (2, "a", ""), (None, "b", "x y"), (5, "null", "z")], "doc_id long, source string, text string").selectExpr("*", "1 AS block", "2 AS key", "3 AS tokens")
    out = mixing.temperature_mix(docs)
    assert out.columns == docs.columns and out.count() >= 1
    assert mixing.temperature_mix(docs.limit(0)).count() == 0
    one = mixing.temperature_mix(docs.where("source = 'a'")).collect()
    assert [r.doc_id for r in one] == [2, 2]


def test_each_epoch_has_an_order_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 20)
    docs = spark.createDataFrame([(i, "a" if i < 40 else "b", "x y z") for i in range(400)], "doc_id long, source string, text string")
    mix = mixing.decide(docs, Scratch(spark, "test-epochs"), mixing.Target(1.0, None))
    rows = mixing.realise(docs, mix).select("doc_id", "_key", "_epoch", "_block", "_nth").collect()
    orders = defaultdict(dict)
    for r in rows:
        if r._key == "=a":
            orders[r._epoch][r._block] = r._nth
    whole = {e: tuple(sorted(o, key=o.get)) for e, o in orders.items() if len(o) == max(map(len, orders.values()))}
    assert len(whole) >= 4 and len(set(whole.values())) == len(whole)
    for e, blocks in whole.items():
        assert sorted(orders[e].values()) == list(range(1, len(blocks) + 1))
    assert len({r.doc_id for r in rows if r._key == "=a"}) == 40


def test_rows_without_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    docs = spark.createDataFrame([(None, "a", f"text {i}") for i in range(300)] + [(-1, "a", "text")], "doc_id long, source string, text string")
    mix = mixing.decide(docs, Scratch(spark, "test-no-ids"), mixing.Target(None, 1.0))
    blocks = Counter(r._block for r in mixing.realise(docs, mix).collect())
    assert len(blocks) >= 12 and max(blocks.values()) < 60 and sum(blocks.values()) == 301


def brute_mix(rows, target, exponent, seed=0):
    """Which rows (place in ``rows``, key, tokens, epoch, block, nth) a mix has."""
    from tests.llm.test_llm_search import spark_hash

    facts, of = [], defaultdict(int)
    for at, (doc_id, source, text) in enumerate(rows):
        none = (int(doc_id is None),)
        key, n = "null" if source is None else "=" + source, len(re.findall("[^\x20\x09-\x0d]+", text or "")) + 1
        row_id = doc_id if doc_id is not None else spark_hash(text) if text is not None else 42
        facts.append((at, key, n, spark_hash(row_id, none, (seed,)), spark_hash((seed,), none, row_id), row_id))
        of[key] += n
    total, raw = sum(of.values()), {k: (n / sum(of.values())) ** exponent for k, n in of.items()}
    out = []
    for key, n in of.items():
        budget = math.floor(raw[key] / sum(raw.values()) * (target.tokens or total) + 1e-6)
        budget = min(budget, math.floor(n * target.repeats)) if target.repeats is not None else budget
        epochs, rest, n_blocks = budget // n, budget % n, math.ceil(n / mixing.BLOCK_TOKENS)
        blocks = defaultdict(list)
        for f in facts:
            if f[1] == key:
                blocks[f[3] % n_blocks].append(f)
        for epoch in range(epochs + 1):
            ahead = 0
            for nth, b in enumerate(sorted(blocks, key=lambda b: (spark_hash((seed,), key, b, epoch), b)), 1):
                size, room = sum(f[2] for f in blocks[b]), rest - ahead
                if epoch < epochs or size <= room:
                    taken = blocks[b]
                else:
                    inner = sorted({(f[4], f[5]) for f in blocks[b]})
                    upto = {x: sum(f[2] for f in blocks[b] if (f[4], f[5]) <= x) for x in inner}
                    taken = [f for f in blocks[b] if 0 < room >= upto[f[4], f[5]]]
                out += [(f[0], key, f[2], epoch, b, nth) for f in taken]
                ahead += size
    return out


@pytest.mark.parametrize("target", [mixing.Target(), mixing.Target(1.0, None), mixing.Target(None, 1.5, 4000), mixing.Target(0.9, 2.0, 900)])
def test_mix_against_brute_force(spark, monkeypatch, target):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 60)
    rng = random.Random(4)
    rows = [(rng.choice([i, i, i, None, 3]), rng.choice(["a"] * 8 + ["b", "c", None, "null"]), rng.choice([None, "", "x", f"w{i} " * rng.randint(1, 25)])) for i in range(260)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, source string, text string, at long")
    mix = mixing.decide(docs, Scratch(spark, "test-brute-mix"), target)
    got = mixing.realise(docs, mix).select("at", "_key", "_tokens", "_epoch", "_block", "_nth").collect()
    assert Counter(map(tuple, got)) == Counter(brute_mix(rows, target, mix.exponent))


def test_mix_leaves_the_callers_columns(spark):
    rows = [(i, "ab"[i % 2], f"t{i} " * (i % 9), "mine", i, [i], 1, 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _key string, _TOKENS long, _epochs array<long>, __nth int, `a b.c` int")
    assert min(mixing.names_of(docs).values()).startswith("___")
    plain = mixing.temperature_mix(docs.select("doc_id", "source", "text"), mixing.Target(1.0, None))
    out = mixing.temperature_mix(docs, mixing.Target(1.0, None))
    assert out.columns == docs.columns
    assert set(map(str, out.collect())) <= set(map(str, docs.collect()))
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in plain.collect())


def test_token_counts(spark):
    rows = spark.createDataFrame([(None,), ("",), (" \x0b",), ("a",), (" a\tb\n",)], "t string")
    assert [r[0] for r in rows.select(mixing.token_count(F.col("t"))).collect()] == [1, 1, 1, 2, 3]


# Sharding


def test_sharding_keeps_every_row(spark, sf_dir):
    docs = {r.doc_id: r.sha for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("sha")).collect()}
    rows = sharding.op5_sharding(spark, sf_dir).collect()
    assert {r.doc_id: r.text_sha256 for r in rows} == docs and len(rows) == len(docs)
    sizes = Counter(r.shard for r in rows)
    assert all(sizes[r.shard] == r.shard_rows for r in rows) and len({r.version for r in rows}) == 1


def test_versions_and_conflicts(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=1 << 20, fanout=3, smallest=1 << 12)
    with pytest.raises(ValueError):
        store.read()
    rows = lambda a, b: spark.range(a, b).selectExpr("id AS doc_id", "id AS file", "'x' AS bytes").coalesce(1)
    for k in range(2):
        assert store.append(rows(10 * k, 10 * k + 10)) == k + 1
    assert store.compact() == 2  # fewer than the fanout: nothing to merge
    version = store.append(rows(20, 30))
    assert store.manifest()[1].count() == 3
    assert store.compact() == version + 1 and store.manifest()[1].count() == 1
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(30))
    assert sorted(r.doc_id for r in store.read(2).collect()) == list(range(20))  # older versions stay readable
    with pytest.raises(sharding.Conflict):
        store.commit(2, store.manifest(2)[1])
    store.append(rows(0, 0))
    store.vacuum()
    assert store.read().count() == 30
    with pytest.raises(ValueError):
        store.manifest(99)


def test_a_writer_that_dies_leaves_no_version(spark, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=1 << 20)
    store.append(spark.range(10).coalesce(1))
    with monkeypatch.context() as m:
        m.setattr(sharding.os, "link", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.append(spark.range(10, 20).coalesce(1))
    assert [v for v, _ in store.versions()] == [1] and store.read().count() == 10
    assert store.append(spark.range(20, 25).coalesce(1)) == 2
    assert sorted(r.id for r in store.read().collect()) == [*range(10), *range(20, 25)]


def test_two_writers_at_once(spark, tmp_path):
    """Both runs are there in the end, whoever is first."""
    from concurrent.futures import ThreadPoolExecutor

    at = f"file://{tmp_path}/store"
    stores = [sharding.ShardStore(spark, at, target=1 << 20) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda k: stores[k].append(spark.range(100 * k, 100 * k + 50).coalesce(1)), range(4)))
    assert sorted(made) == [1, 2, 3, 4]
    assert sorted(r.id for r in stores[0].read().collect()) == [100 * k + i for k in range(4) for i in range(50)]


def test_a_merge_gives_up_on_shards_that_are_gone(spark, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=1 << 20, fanout=2, smallest=1 << 12)
    for k in range(2):
        store.append(spark.range(10 * k, 10 * k + 10).coalesce(1))
    commit, other = sharding.ShardStore.commit, []

    def raced(self, after, files):
        if not other:  # another writer merges the same shards first
            other.append(sharding.ShardStore(spark, store.path, target=1 << 20, fanout=2, smallest=1 << 12))
            other[0].compact()
        return commit(self, after, files)

    monkeypatch.setattr(sharding.ShardStore, "commit", raced)
    store.compact()
    assert sorted(r.id for r in store.read().collect()) == list(range(20)) and store.manifest()[1].count() == 1


def brute_merges(sizes, target, fanout, smallest):
    """Which sizes each merge takes, in order."""
    tier = lambda n: max(0, math.ceil(math.log(max(n, 1) / smallest, fanout)))
    sizes, merges = dict(sizes), []
    while True:
        by = defaultdict(list)
        for f, n in sizes.items():
            if n < target * 3 // 4:
                by[tier(n)].append(f)
        due = sorted(t for t, fs in by.items() if len(fs) >= fanout)
        if not due:
            return merges
        merges.append(set(by[due[0]]))
        for f in by[due[0]]:
            del sizes[f]
        return merges  # sizes of merged files are only known once they are written


def test_merges_are_those_of_the_lowest_due_tier(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=200_000, fanout=3, smallest=1000)
    rng = random.Random(1)
    for rows in (10, 3000, 20, 9000, 15, 5000, 30_000, 4000):
        store.append(spark.createDataFrame([(rng.random(),) for _ in range(rows)], "x double").coalesce(1))
    for _ in range(20):
        before = {r.file: r.bytes for r in store.manifest()[1].collect()}
        want = brute_merges(before, store.target, store.fanout, store.smallest)
        tiers = store.tiers(store.manifest()[1])
        due = tiers.groupBy("tier").count().where(f"count >= {store.fanout}").orderBy("tier").first()
        if due is None:
            assert want == []
            break
        assert {r.file for r in tiers.where(F.col("tier") == due.tier).collect()} == want[0]
        store.compact()
    after = {r.file: r.bytes for r in store.manifest()[1].collect()}
    assert brute_merges(after, store.target, store.fanout, store.smallest) == []
    assert store.read().count() == sum((10, 3000, 20, 9000, 15, 5000, 30_000, 4000))


def test_sharding_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, file string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op5_sharding(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "text_sha256", "shard", "shard_rows", "shard_bytes", "version"]


def test_sharding_of_odd_rows(spark, tmp_path):
    rows = [(None, None, "f"), (None, "a", "f"), (1, "b", None), (1, "b", None), (2, "", "f")]
    spark.createDataFrame(rows, "doc_id long, text string, file string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op5_sharding(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text_sha256 is None) for r in out) == Counter((i, t is None) for i, t, _ in rows)


def test_full_shards_stay(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=1000, fanout=2, smallest=100)
    for _ in range(3):
        store.append(spark.range(500).coalesce(1))
    before = {r.file for r in store.manifest()[1].collect()}
    store.compact()
    assert {r.file for r in store.manifest()[1].collect()} == before  # each is beyond the target


def _steps(monkeypatch, store, each):
    """Calls ``each`` before and after every step of a writer that a vacuum can
    come between: what it declares, writes, reads and names."""

    def wrap(owner, name):
        before, busy = getattr(owner, name), []

        def run(*args, **kw):
            if busy:
                return before(*args, **kw)
            busy.append(1)
            try:
                each()
                out = before(*args, **kw)
                each()
                return out
            finally:
                busy.pop()

        monkeypatch.setattr(owner, name, run)

    for name in ("_begin", "_written", "manifest", "_check", "_named", "_end"):
        wrap(type(store), name)


def test_vacuum_between_all_steps_of_a_writer(spark, tmp_path, monkeypatch):
    """Whatever step of an append or a merge a vacuum comes between, all rows
    that were appended are there, and nothing else is left."""
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=1 << 20, fanout=2, smallest=1 << 12)
    store.append(spark.range(10).coalesce(1))
    plain, calls = sharding.ShardStore.vacuum, []
    other = sharding.ShardStore(spark, store.path, target=1 << 20, fanout=2, smallest=1 << 12)

    def vacuum():
        if not calls or calls[-1] != "in":
            calls.append("in")
            plain(other)
            calls.append("out")

    with monkeypatch.context() as m:
        _steps(m, store, vacuum)
        store.append(spark.range(10, 20).coalesce(1))
        store.compact()
        assert sorted(r.id for r in store.read().collect()) == list(range(20))
    assert calls.count("in") > 20
    store.vacuum()
    files = {r.file for r in store.manifest()[1].collect()}
    left = {str(p) for p in tmp_path.rglob("data/*/*.parquet")}
    assert left == {re.sub("^file:/+", "/", f) for f in files} and len(store.versions()) == 1
    assert len(list(tmp_path.glob("store/_manifests/*"))) == 1 and not list(tmp_path.glob("store/_open/*"))


def test_vacuum_keeps_versions_and_says_what_is_gone(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=1 << 20, fanout=2, smallest=1 << 12)
    for k in range(4):
        store.append(spark.range(10 * k, 10 * k + 10).coalesce(1))
        store.compact()
    numbers = [v for v, _ in store.versions()]
    rows = {v: sorted(r.id for r in store.read(v).collect()) for v in numbers}
    store.vacuum(keep=3)
    assert [v for v, _ in store.versions()] == numbers[-3:]
    assert {v: sorted(r.id for r in store.read(v).collect()) for v in numbers[-3:]} == {v: rows[v] for v in numbers[-3:]}
    with pytest.raises(ValueError, match="not kept"):
        store.read(numbers[0])
    with pytest.raises(ValueError, match="no version"):
        store.read(numbers[-1] + 1)
    with pytest.raises(ValueError):
        store.vacuum(keep=0)
    assert store.append(spark.range(40, 45).coalesce(1)) == numbers[-1] + 1  # numbers are not given out again
    assert sorted(r.id for r in store.read().collect()) == list(range(45))


def test_a_dead_run_goes_after_the_grace_and_its_writer_is_told(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=1 << 20)
    store.append(spark.range(10).coalesce(1))
    run = store._begin()
    spark.range(5).coalesce(1).write.parquet(f"{store.path}/data/{run}")
    (tmp_path / "store/_versions/draft-x").write_text("half")
    store.vacuum()
    assert list(tmp_path.glob(f"store/data/{run}/*.parquet")) and (tmp_path / "store/_versions/draft-x").exists()
    store.vacuum(grace=-1)
    assert not (tmp_path / f"store/data/{run}").exists() and not (tmp_path / "store/_versions/draft-x").exists()
    with pytest.raises(sharding.Expired):
        store._committed(run, lambda version, files: files)
    assert store.read().count() == 10 and len(store.versions()) == 1


def test_random_appends_merges_and_vacuums(spark, tmp_path):
    """The store against a list of what was appended, and each kept version
    against what it held when it was made."""
    rng, rows, seen = random.Random(11), [], {}
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=40_000, fanout=3, smallest=1000)
    for step in range(24):
        what = rng.choice(["append", "append", "append", "compact", "vacuum"])
        if what == "append":
            more = [(step, rng.random(), None if rng.random() < 0.1 else "x") for _ in range(rng.choice([0, 1, 40, 2000]))]
            rows += more
            store.append(spark.createDataFrame(more, "doc_id long, x double, file string").coalesce(rng.choice([1, 2])))
        elif what == "compact":
            store.compact()
        else:
            store.vacuum(keep=rng.choice([1, 2, 5]))
        kept = [v for v, _ in store.versions()]
        if kept:
            seen[kept[-1]] = len(rows)
    for v in [v for v, _ in store.versions()][-3:]:
        if seen.get(v):
            assert store.read(v).count() == seen[v]
    assert Counter(map(tuple, store.read().collect())) == Counter(rows)


# Pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, columns = Scratch(spark, "test-pipeline"), docs.columns
    out, at = {}, docs
    for name, stage in P.STAGES:
        at = scratch.store(stage(spark, at, sf_dir), name)
        out[name] = at
    for name, _ in P.STAGES[:-1]:
        assert out[name].columns == columns
    from loomgraph.llm import exact_dedup, ngram_join, quality_rules

    good = {r.doc_id for r in quality_rules.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in out["quality_rules"].collect()} == good
    texts = defaultdict(list)
    for r in out["quality_rules"].collect():
        texts["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")].append(r.doc_id)
    exact = {max(ids) for ids in texts.values()}
    assert {r.doc_id for r in out["exact_dedup"].collect()} == exact
    from tests.llm.test_llm_pairs import brute_components

    rows = [(r.doc_id, r.text) for r in out["exact_dedup"].collect()]
    near = {i for i, _, c in brute_components(rows) if i == c}
    assert {r.doc_id for r in out["ngram_jaccard_join"].collect()} == near
    assert {r.doc_id for r in out["temperature_mixing"].collect()} <= near
    mixed = Counter(r.doc_id for r in out["temperature_mixing"].collect())
    packed = Counter(r.doc_id for r in out["best_fit_packing"].where("piece = 0").collect())
    assert packed == mixed
    assert exact_dedup and ngram_join


def test_pipeline_of_odd_rows(spark, sf_dir):
    """Rows without anything, and each row twice: of every text that the stages
    keep one stays, as if the table had none of them."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(30).withColumn("component_id", F.lit(1))
    docs = Scratch(spark, "test-odd").store(docs)
    none = docs.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    kept = []
    for at in (docs, none.union(docs).union(docs)):
        kept.append([])
        for name, stage in P.STAGES[:3]:
            at = Scratch(spark, "test-odd").store(stage(spark, at, sf_dir))
            kept[-1].append(Counter(r.doc_id for r in at.collect()))
    plain, odd = kept
    assert plain[0] and set(plain[0].values()) == {1}
    assert odd[0] == Counter({i: 2 for i in plain[0]})  # quality: both copies stay, rows without text go
    assert odd[1] == plain[1] and odd[2] == plain[2]
    for name, stage in P.STAGES[3:]:
        at = Scratch(spark, "test-odd").store(stage(spark, at, sf_dir))
    assert {r.doc_id for r in at.collect()} <= set(plain[2])
    at = docs.limit(0)
    for _, stage in P.STAGES:
        at = Scratch(spark, "test-odd").store(stage(spark, at, sf_dir))
        assert at.count() == 0
