"""Each corpus operator on awkward rows, on an empty table, and against a plain version of its rule."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stepwright.llm import common, decontaminate, line_dedup, mixing, ngram_lm, pieces, quality, rules, sharding, simhash, token_counts, token_files

SF = "/root/testdata/sf0.001"
WORDS = "the of and in to a is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which".split()


def text(seed, n, end=" "):
    r = np.random.default_rng(seed)
    return end.join(WORDS[i] + str(r.integers(0, 60)) for i in r.integers(0, len(WORDS), n))


ROWS = [
    (0, text(1, 80), "en", "b", 5),
    (1, text(1, 80), "en", "b", 5),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (4, " \n\t ", "en", "a", 4),
    (5, text(2, 60) + "\n" + text(3, 60), "de", "a", 1),
    (5, text(2, 60) + "\n" + text(3, 60), "de", "a", 1),
    (None, text(4, 30), "fr", None, 1),
    (7, text(5, 20_000), "fr", "c", 1),
    (8, "\n".join([text(6, 25), text(3, 60), text(7, 5)]), "es", "c", 1),
    (9, "one", "es", "é", 1),
    (10, "A-Z ÀÉ ß \x0b x\x1cy <|endoftext|> don't 漢字", "es", "é", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns.
CLASHES = ["row_number", "copy_number", "bad_id", "t1", "t2", "first", "n_lines", "number", "group_id", "__id", "__n", "__copy", "__key", "__row", "__part", "size", "row", "line", "rank", "key", "keys", "shard", "slot", "weight", "target", "node", "component", "features", "score", "n", "dropped", "digest", "words", "copy", "h", "seg"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i != 9), 0) for i in (0, 1, 3, 5, 7, 8, 9)] + [(5, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    changed = ROWS[5][1].split("\n")[1].split()
    changed[7] = "zzz"
    rows = [(0, " ".join(changed[:30])), (1, None), (2, ""), (3, "of the"), (4, text(99, 30)), (4, text(99, 30)), (5, " ".join(ROWS[0][1].split()[10:16]))]
    return spark.createDataFrame(rows, "item_id long, text string")


def words(t):
    return (t or "").encode().split()


# ---------------------------------------------------------------- 1
def test_mix_near_targets_and_bounded(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["size"] == len(words(t)) for r, t in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), [x[1] for x in sorted(ROWS, key=lambda x: (x[0] is None, x[0] or 0))]))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_mix_targets_of_sources(spark):
    rows = [(i, "w " * n, "en", s, 1) for i, (s, n) in enumerate([("a", 10), ("a", 10), ("b", 30), ("c", 400), (None, 50)] * 20)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    t = {r[0]: (r[1], r[2], r[3]) for r in got.groupBy("source").agg(F.first("target"), F.first("source_size"), F.sum("taken")).collect()}
    # weights 5, 2, 1, 5; a, b and the null source stop at three times their size, c takes the rest
    assert t["a"][0] == 1200 and t["b"][0] == 1800 and t[None][0] == 3000 and t["c"][0] == 10_000 - 6000
    assert all(abs(v[2] - v[0]) <= 400 for v in t.values())
    assert sum(v[0] for v in t.values()) == sum(v[1] for v in t.values())


def test_mixed_documents_repeat_whole_rows(spark, docs):
    copies = collections.Counter()
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    out = mixing.mixed_documents(docs)
    got = out.collect()
    assert collections.Counter(r["doc_id"] for r in got) == +copies
    assert out.columns == docs.columns and {r["row_number"] for r in got} == {"x"}


def test_mix_of_repeated_rows(spark):
    rows = [(i % 100 if i % 3 else None, "w " * (i % 5 + 1), "en", "ab"[i % 2], 1) for i in range(300) for _ in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = mixing.mix(docs).agg(F.sum("copies"), F.sum("taken"), F.sum("size")).first()
    assert mixing.mixed_documents(docs).count() == taken[0] and abs(taken[1] - taken[2]) <= 5


def test_mix_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing.cut_of, "__defaults__", (20,))  # range-sorted more than once
    r = np.random.default_rng(12)
    rows = [(i, "w " * int(r.integers(0, 40)), "en", [None, "a", "b", "c"][int(r.integers(4)) * int(r.integers(2))], 1) for i in range(400)]
    got = {x["doc_id"]: x for x in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = sorted({x[3] for x in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, queue = collections.Counter(), []
    key = lambda i: hashlib.md5(f"17:{i}".encode()).hexdigest()
    for x in rows:
        total[x[3]] += len(words(x[1]))
    for s in order:
        through = 0
        for i, t, *_ in sorted((x for x in rows if x[3] == s), key=lambda x: (key(x[0]), x[0])):
            through += (n := len(words(t)))
            queue += [((c * total[s] + through) / weight[s], s is None, s or "", key(i), i, c, n) for c in range(3) if n]
    taken, spent = collections.Counter(), 0
    for *_, i, _, n in sorted(queue):
        spent += n
        if spent > sum(total.values()):
            break
        taken[i] += 1
    assert {i: x["copies"] for i, x in got.items() if x["copies"]} == dict(taken)


def test_mix_of_nothing(empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


# ---------------------------------------------------------------- 2
def plain_fingerprint(t, n=3):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(prints))]


def test_simhash_components_equal_brute_force(spark, docs):
    got = simhash.simhash_components(docs).collect()
    rows = sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0])
    prints = [plain_fingerprint(r[1]) for r in rows]
    root = reachable(prints, 3)
    want = {r[0]: (f"{p:016x}", rows[k][0]) for r, p, k in zip(rows, prints, root)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert len(got) == len(ROWS)


@pytest.mark.parametrize("large", [4096, 8])
def test_linked_fingerprints_equal_brute_force(spark, large, monkeypatch):
    monkeypatch.setattr(simhash.split_large, "__defaults__", (large,))
    r = np.random.default_rng(5)
    centres = [int(x) for x in r.integers(0, 1 << 63, 6)]
    prints = sorted({centres[r.integers(6)] ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False)) for _ in range(400)})
    rows = [(i, p.to_bytes(8, "little"), p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "node long, fp binary, fp_long long")
    got = dict(simhash.component_of_fingerprints(nodes, 3).collect())
    assert [got.get(i, i) for i in range(len(prints))] == reachable(prints, 3)


def test_carry_save_distances():
    r = np.random.default_rng(1)
    a, b = (r.bytes(8 * 200) for _ in range(2))
    near = [bytes(x ^ (1 << r.integers(8) if r.random() < 0.3 else 0) for x in a[8 * i : 8 * i + 8]) for i in range(200)]
    far = [b[8 * i : 8 * i + 8] for i in range(200)]
    for other in (near, far):
        p, q = simhash.planes_of([a[8 * i : 8 * i + 8] for i in range(200)]), simhash.planes_of(other)
        live = np.packbits(np.r_[np.ones(200, np.uint8), np.zeros(56, np.uint8)], bitorder="little").view(np.uint64)
        for radius in (0, 1, 3, 6):
            want = [i for i in range(200) if (int.from_bytes(a[8 * i : 8 * i + 8], "big") ^ int.from_bytes(other[i], "big")).bit_count() <= radius]
            assert simhash.positions(simhash.within(p[:, :4], q[:, :4], live, radius)).tolist() == want


def test_near_copies_of_five_word_shingles(spark):
    one = text(11, 400).split()
    near = [*one[:200], "changed", *one[201:]]
    rows = [(3, " ".join(one)), (4, " ".join(near)), (5, " ".join(one).upper()), (6, text(12, 400)), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    group = dict(simhash.near_groups(df).collect())
    assert group == {3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 7}
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(df).collect()) == [3, 6, 7]


def five_word_sets(rows):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    return sets


def linked_by_brute_force(rows):
    sets = five_word_sets(rows)
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return group


def test_near_copies_count_repeated_lines_once(spark):
    rows = []
    for k in range(12):
        lines = [text(3000 + k * 20 + i, 20) for i in range(10)]
        rows += [(2 * k, "\n".join(lines)), (2 * k + 1, "\n".join([*lines, *[lines[3]] * (5 + 5 * k)]))]
    got = dict(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == linked_by_brute_force(rows) and got[1] == 0 and got[23] == 22


def test_near_copies_above_and_below_the_share(spark):
    rows = []
    for k in range(60):
        words = text(4000 + k, 100).split()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[: 100 - k // 2], *text(5000 + k, k // 2).split()]))]
    got = dict(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == linked_by_brute_force(rows)
    assert 10 < sum(i != g for i, g in got.items()) < 50


def test_large_groups_lose_no_pair(spark):
    passage = text(6000, 40)
    rows = [(i, f"{passage} {text(6100 + i // 2, 110 + i // 2)}" + (f" {text(6900 + i, 10)}" if i % 2 else "")) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = linked_by_brute_force(rows)
    assert sum(i != g for i, g in want.items()) == 40
    assert dict(simhash.near_groups(df, large=8).collect()) == want == dict(simhash.near_groups(df).collect())
    pairs = spark.createDataFrame([(1, i, bytes([i])) for i in range(50)], "key long, node long, fp binary")
    dealt = simhash.in_blocks(pairs, 8).groupBy("key").agg(F.collect_list("node").alias("x")).collect()
    assert {(a, b) for r in dealt for a in r["x"] for b in r["x"] if a < b} == set(itertools.combinations(range(50), 2))
    assert max(len(r["x"]) for r in dealt) < 25


def test_simhash_of_nothing(empty):
    assert simhash.simhash_components(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got.get(i, i) for i in range(41)} == {0} and {got.get(i, i) for i in range(100, 160)} == {100}


# ---------------------------------------------------------------- 3 and 10
def library(name):
    import public_tokenizers

    return common.tokenizer(public_tokenizers.path(name)), public_tokenizers.path(name)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_the_library(spark, name):
    lib, path = library(name)
    own = pieces.PieceEncoder(path)
    assert own.chunk is not None
    odd = [r[1] or "" for r in ROWS] + ["  ", "a  b\n\n c\t\td ", "don't we'll I'm x's  ", "<|startoftext|>a", "1a2b ½ ²", "a.b, c. d.. e,", "\n\n\nfoo\r\n bar  ", "éè. ÀB, ñ", "x y", "é", "İ ΣΣ"]
    documents = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in odd + documents:
        assert np.frombuffer(own.ids(t), np.uint32).tolist() == lib.encode(t, add_special_tokens=False).ids, t[:80]


def test_piece_memory_is_bounded(monkeypatch):
    _, path = library("word_bpe_49k.json")
    monkeypatch.setattr(pieces, "MOST_CHUNKS", 50)
    own = pieces.PieceEncoder(path)
    lib, _ = library("word_bpe_49k.json")
    t = text(20, 3000)
    assert np.frombuffer(own.ids(t), np.uint32).tolist() == lib.encode(t, add_special_tokens=False).ids
    assert len(own.chunks) <= 51 and len(own.older) <= 51


def test_counts_and_cache(spark, docs, empty, tmp_path, monkeypatch):
    lib, path = library("byte_bpe_50k.json")
    cache = f"file://{tmp_path}/cache"
    got = token_counts.token_counts(docs, cache, path).collect()
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in ROWS})
    assert not any(r["cached"] for r in got)
    assert all(r["cached"] for r in token_counts.token_counts(docs, cache, path).collect())  # nothing is missing now
    assert spark.read.parquet(cache).count() == stored.count()
    more = spark.createDataFrame([(1, "new text"), (2, ROWS[0][1])], "doc_id long, text string")
    assert sorted((r["doc_id"], r["cached"]) for r in token_counts.token_counts(more, cache, path).collect()) == [(1, False), (2, True)]
    assert spark.read.parquet(cache).count() == len({r[1] or "" for r in ROWS}) + 1
    assert token_counts.token_counts(empty, f"file://{tmp_path}/none", path).count() == 0


def test_a_full_cache_reads_no_text_again(spark, docs, tmp_path, monkeypatch):
    _, path = library("byte_bpe_50k.json")
    cache, calls = f"file://{tmp_path}/cache", []
    whole = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *a, **k: calls.append(1) or whole(*a, **k))
    rows, counts = token_counts.looked_up(docs, cache, path)
    assert len(calls) == 1 and counts.where("NOT cached").count() == rows.select("digest").distinct().count()
    rows, counts = token_counts.looked_up(docs, cache, path)
    assert len(calls) == 1 and counts.where("cached").count() == rows.select("digest").distinct().count()


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(i if i % 3 else 0, i) for i in range(6000)], "k long, v long")
    right = spark.range(1500).select(F.col("id").alias("r"), (F.col("id") * 2).alias("w"))
    got = sorted(map(tuple, common.join_hot(rows, ["k"], right, ["r"]).select("v", "w").collect()))
    assert got == sorted((i, 2 * (i if i % 3 else 0)) for i in range(6000) if (i if i % 3 else 0) < 1500)


def test_running_sums_by_range(spark):
    rows = spark.createDataFrame([(i % 3 or None, i * 7 % 101, 1) for i in range(300)], "g long, o long, n long").withColumn("id", F.monotonically_increasing_id())
    got = common.running(rows, ["g"], ["o", "id"], "n", "upto").collect()
    for g in (1, 2, None):
        own = sorted((r["o"], r["id"], r["upto"]) for r in got if r["g"] == g)
        assert [x[2] for x in own] == list(range(1, 101))


def test_wavelet_matrix():
    r = np.random.default_rng(2)
    for values in (r.integers(0, 3000, 5000), r.integers(0, 2, 65), np.array([7]), np.array([], np.int64), np.array([70_000, 3, 70_000])):
        v = values.astype(np.uint32)
        ids, lengths, m = token_files.from_bytes(token_files.to_bytes([1, None], np.array([len(v), 0]), token_files.WaveletMatrix.of(v)))
        assert ids == [1, None] and lengths.tolist() == [len(v), 0]
        assert m.access(np.arange(len(v))).tolist() == v.tolist() == m.span(0, len(v)).tolist()
        for x in v[:40].tolist():
            at = np.flatnonzero(v == x)
            assert m.count(x) == len(at) and [m.find(x, k) for k in range(min(3, len(at)))] == at[:3].tolist()
            assert m.find(x, len(at)) is None
        assert m.count(1 << 30) == 0
        if len(v) > 100:
            begin, end = np.arange(0, 100), np.arange(0, 100) * 20 + 100
            assert m.counts(int(v[5]), begin, end).tolist() == [int((v[a:b] == v[5]).sum()) for a, b in zip(begin, end)]


def test_token_files_are_compressed_and_read_by_ranges():
    r = np.random.default_rng(6)
    v = np.minimum(r.zipf(1.3, 1_000_000), 48_999).astype(np.uint32)
    data = token_files.to_bytes([1], np.array([len(v)]), token_files.WaveletMatrix.of(v))
    assert len(data) < 2 * len(v) * 0.7
    reads = []

    def read(offset, size):
        reads.append(size)
        return data[offset : offset + size]

    _, _, m = token_files.opened(read)
    assert m.access(np.array([777_777, 3])).tolist() == v[[777_777, 3]].tolist()
    assert sum(reads) < 0.5 * len(data)
    assert m.count(1, 1000, 900_000) == int((v[1000:900_000] == 1).sum())
    at = np.flatnonzero(v == 5)
    assert [m.find(5, k) for k in (0, 1000, len(at) - 1)] == at[[0, 1000, len(at) - 1]].tolist()
    assert m.access(np.arange(len(v))).tolist() == v.tolist()
    for a, b in ((0, len(v)), (5, 6), (777, 300_123), (999_990, len(v)), (63, 64), (7, 7)):
        assert m.span(a, b).tolist() == v[a:b].tolist()


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    lib, path = library("word_bpe_49k.json")
    folder = f"file://{tmp_path}/wm"
    manifest = token_files.write_token_files(docs, path, folder, shard_tokens=200)
    got = token_files.read_token_files(manifest, folder).orderBy("start").collect()
    want = collections.Counter()
    for r in ROWS:
        ids = np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in ROWS), key=lambda x: -1 if x is None else x)
    assert token_files.read_token_files(token_files.write_token_files(empty, path, f"{folder}-0"), f"{folder}-0").count() == 0


# ---------------------------------------------------------------- 4
def test_classifier_rows_and_folds(docs, empty, labels):
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).count() == len(ROWS)
    assert quality.drop_rejected(docs, labels).columns == docs.columns


def test_classifier_on_held_out_rows(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(d, l).join(l, "doc_id").where("held_out").toPandas()
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert (rows.predicted == rows.quality).mean() >= 0.95
    assert np.mean([g > b for g in good for b in bad]) >= 0.97


def test_labels_do_not_reach_the_score(spark, docs, labels):
    model = quality.fit(docs, labels)
    swapped = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q"), "doc_id": F.col("doc_id") + 1000})
    a, b = (sorted(r["score"] for r in quality.scores(x, model, ["doc_id"]).collect()) for x in (docs, swapped))
    assert a == b


def test_risk_estimator_finds_the_negatives():
    r = np.random.default_rng(3)
    p = r.normal(1, 1, (500, 2))
    u = np.concatenate([r.normal(1, 1, (700, 2)), r.normal(-3, 1, (300, 2))])
    m = quality.fit_pu(p, u, 0.7)
    s = m.score(u) >= 0.5
    assert s[:700].mean() > 0.95 and s[700:].mean() < 0.1


def test_risk_and_its_gradient_equal_brute_force():
    r = np.random.default_rng(8)
    p, u, w, prior = r.normal(1, 1, (40, 3)), r.normal(0, 2, (60, 3)), r.normal(0, 1, 3), 0.6
    loss = lambda z, y: math.log1p(math.exp(-y * z))

    def parts(w):
        up = prior * sum(loss(float(x @ w), 1) for x in p) / len(p)
        down = sum(loss(float(x @ w), -1) for x in u) / len(u) - prior * sum(loss(float(x @ w), -1) for x in p) / len(p)
        return up, down

    for case in (w, w * 0.1, np.array([9.0, 9.0, 9.0]), np.array([-9.0, 0.0, 0.0])):
        up, down = parts(case)
        assert quality.risks(p @ case, u @ case, prior) == pytest.approx((up, down))
        g, negative = quality.gradient(case, p, u, prior)
        assert negative == pytest.approx(down)
        whole = (lambda w: sum(parts(w))) if down >= 0 else (lambda w: -parts(w)[1])
        steps = np.eye(3) * 1e-5
        assert g == pytest.approx([(whole(case + e) - whole(case - e)) / 2e-5 for e in steps], abs=1e-6)
    small = quality.fit_pu(p, u, prior, rounds=400, decay=0.0)
    z = lambda x: small.raw(x)
    at = sum(quality.risks(z(p), z(u), prior))
    for k in range(4):  # no small step makes the risk much less
        for sign in (-0.05, 0.05):
            other = quality.Model(small.mean, small.scale, small.weights + sign * np.eye(4)[k], prior)
            up, down = quality.risks(other.raw(p), other.raw(u), prior)
            assert up + max(0.0, down) > at - 2e-3


def test_rounds_are_chosen_on_rows_set_aside():
    r = np.random.default_rng(9)
    make = lambda n, share: np.concatenate([r.normal(1, 1, (round(n * share), 2)), r.normal(-2, 1, (n - round(n * share), 2))])
    rounds = quality.rounds_by_risk(make(300, 1), make(600, 0.6), make(100, 1), make(200, 0.6), 0.6)
    assert rounds in quality.ROUNDS


def test_prior_is_estimated_from_unlabelled_rows():
    r = np.random.default_rng(4)
    for share in (0.3, 0.7):
        u = np.concatenate([r.normal(1, 1, (round(4000 * share), 2)), r.normal(-3, 1, (4000 - round(4000 * share), 2))])
        assert abs(quality.share_of_positives(r.normal(1, 1, (1000, 2)), u) - share) < 0.06


def test_negative_labels_are_not_read(spark):
    d, l = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a, b = quality.fit(d, l), quality.fit(d, l.where("quality = 1"))
    assert a.prior == b.prior and np.array_equal(a.weights, b.weights)


# ---------------------------------------------------------------- 5
def plain_line_dedup(rows, least):
    lines = [(d, i, x) for d, t in rows for i, x in enumerate(t.split("\n"))]
    by = {d: t.split("\n") for d, t in rows}
    order = {(d, i): k for k, (d, i, _) in enumerate(lines)}
    gone = set()
    for d, i, _ in lines:
        for e, j, _ in lines:
            if order[e, j] < order[d, i]:
                n = 0
                while i + n < len(by[d]) and j + n < len(by[e]) and by[d][i + n] == by[e][j + n]:
                    n += 1
                if sum(len(words(x)) for x in by[d][i : i + n]) >= least:
                    gone |= {(d, i + k) for k in range(n)}
    return {d: "\n".join(x for i, x in enumerate(by[d]) if (d, i) not in gone) for d in by}


def test_line_dedup_equals_brute_force(spark):
    r = np.random.default_rng(7)
    for least in (1, 3, 8):
        rows = [(d, "\n".join("w" * 1 + " x" * int(k) + f" {k}" for k in r.integers(0, 3, r.integers(1, 9)))) for d in range(25)]
        got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()}
        assert got == plain_line_dedup(rows, least)


def test_suffix_array_orders_suffixes(spark):
    r = np.random.default_rng(17)
    rows = [(d, "\n".join(str(k) for k in r.integers(0, 3, r.integers(1, 12)))) for d in range(30)]
    active = line_dedup.repeated_lines(line_dedup.distinct_texts(spark.createDataFrame(rows, "doc_id long, text string")))
    array, levels = line_dedup.suffix_array(active)
    lines = {tuple(t.split("\n")) for _, t in rows}
    count = collections.Counter(x for t in lines for x in t)
    place = {r["doc_id"]: r for r in active.select("first.doc_id", "t1", "t2").distinct().collect()}
    own = {(place[d]["t1"], place[d]["t2"]): t.split("\n") for d, t in rows if d in place}
    got = array.collect()
    assert len(got) == sum(n for n in count.values() if n > 1)
    suffix = {(x["t1"], x["t2"], x["line"]): tuple(own[x["t1"], x["t2"]][x["line"] :]) for x in got}
    by_rank = sorted((x["rank"], suffix[x["t1"], x["t2"], x["line"]]) for x in got)
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for (i, a), (j, b) in zip(by_rank, by_rank[1:]):
        assert (i == j) == (a == b)
    # neighbours share as much as any pair across them: suffixes with a common prefix stand together
    for i, (_, a) in enumerate(by_rank):
        for _, b in by_rank[i + 1 :]:
            k = shared(a, b)
            assert all(shared(a, c) >= k for _, c in by_rank[i : by_rank.index((_, b)) + 1])
    for x in levels.collect():
        n = 1 << x["k"]
        run = suffix[x["t1"], x["t2"], x["line"]][:n]
        assert len(run) == n and sum(s[:n] == run for s in suffix.values()) > 1


def test_line_dedup_of_repeated_and_blank_lines(spark):
    rows = [(0, "a b c\n\n\nd e f\nx"), (1, "y\na b c\n\n\nd e f\nz"), (2, "a b c\n\n\nd e f\nx"), (3, "q\nd e f\n\n\n\n"), (4, "a b c\na b c\na b c\na b c"), (5, "one"), (6, "one"), (7, "\n" * 40 + "a b c d e f\n" * 2)]
    for least in (3, 6, 7, 12):
        got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()}
        assert got == plain_line_dedup(rows, least), least


def test_line_dedup_of_awkward_rows(docs, empty):
    out = line_dedup.dedup_lines(docs)
    got = out.collect()
    assert len(got) == len(ROWS)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    text_of = {r["doc_id"]: r["text"] for r in got}
    assert text_of[1] == "" and text_of[0] == ROWS[0][1] and text_of[2] is None and text_of[8].count("\n") == 1
    assert line_dedup.dedup_lines(empty).count() == 0


# ---------------------------------------------------------------- 6
def test_elias_fano():
    r = np.random.default_rng(0)
    for top in (40, 10**6, 2**62):
        v = np.unique(r.integers(0, top, 3000)).astype(np.uint64)
        e = ngram_lm.EliasFano(*ngram_lm.EliasFano.parts(v))
        zero = np.zeros(len(v), int)
        assert (e.get(np.arange(len(v))) == v).all()
        assert (e.find(v, zero, zero + len(v)) == np.arange(len(v))).all()
        other = np.setdiff1d(r.integers(0, top + 9, 300).astype(np.uint64), v)
        zero = np.zeros(len(other), int)
        assert (e.find(other, zero, zero + len(v)) == -1).all()


def plain_model(rows, held):
    """Counts of the training rows and p(w | u, v) in plain Python, without quantisation."""
    uni, bi, tri = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            w = [b"\r", *(t or "").encode().lower().split(), b"\n"]
            uni.update(w)
            bi.update(zip(w, w[1:]))
            tri.update(zip(w, w[1:], w[2:]))
    n, v = sum(uni.values()) - uni[b"\r"], len(set(uni) - {b"\r"})
    after, after2 = collections.defaultdict(list), collections.defaultdict(list)
    for a, b in bi:
        after[a].append(bi[a, b])
    for a, b, c in tri:
        after2[a, b].append(tri[a, b, c])
    d = ngram_lm.DISCOUNT

    def p1(w):
        return ((uni[w] if w != b"\r" else 0) + 1) / (n + v + 1)

    def p2(w, a):
        if not after[a]:
            return p1(w)
        c = sum(after[a])
        return max(bi[a, w] - d, 0) / c + (1 - sum(x - d for x in after[a]) / c) * p1(w)

    def p3(w, a, b):
        if not bi[a, b]:
            return p2(w, b)
        c = bi[a, b]
        return max(tri[a, b, w] - d, 0) / c + (1 - sum(x - d for x in after2[a, b]) / c) * p2(w, b)

    return uni, n, v, p1, p2, p3


HELD = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_language_model_equals_brute_force(spark, docs, empty):
    r = np.random.default_rng(21)
    more = [(100 + i, " ".join(f"w{k}" for k in r.integers(0, 1 + r.integers(1, 25), r.integers(0, 40)))) for i in range(150)]
    rows = [*((i, t) for i, t, *_ in ROWS), *more]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in ngram_lm.score_documents(table).collect()}
    uni, n, v, p1, p2, p3 = plain_model(rows, HELD)
    for i, t in rows:
        w, x = [b"\r", *(t or "").encode().lower().split(), b"\n"], got[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (HELD(i), len(w) - 1, sum(uni[y] > 0 for y in w[1:]), n)
        assert x["base_score"] == pytest.approx(sum(math.log10(p1(y)) for y in w[1:]))
        score = math.log10(p2(w[1], w[0])) + sum(math.log10(p3(c, a, b)) for a, b, c in zip(w, w[1:], w[2:]))
        assert abs(x["score"] - score) <= 0.05 * (len(w) - 1)  # steps of an eighth of an octave: log10(2) / 8 = 0.04
    assert ngram_lm.score_documents(empty).count() == 0 and len(ngram_lm.score_documents(docs).collect()) == len(ROWS)
    pruned = {x["doc_id"]: x["score"] for x in ngram_lm.score_documents(table, (2, 2)).collect()}
    assert all(math.isfinite(x) for x in pruned.values()) and pruned[0] < got[0]["score"]


def test_probabilities_sum_to_one(spark):
    r = np.random.default_rng(22)
    rows = [(i, " ".join(f"w{k}" for k in r.integers(0, 12, 30))) for i in range(60)]
    model = ngram_lm.train(spark.createDataFrame(rows, "doc_id long, text string").select("text"))
    vocabulary = [f"w{k}" for k in range(12)]
    for context in (["w1"], ["w1", "w2"], ["w3", "w3"], ["new", "w5"], ["w5", "new"]):
        before = model.scored([" ".join(context).encode()])[3][0]
        end = model.scored([" ".join(context[:-1]).encode()])[3][0] if len(context) > 1 else model.scored([b""])[3][0]
        texts = [" ".join([*context, w]).encode() for w in vocabulary]
        # p(context, w, END) / p(END | context, w) for each w; the rest is END and unknown words
        total = 0.0
        for t, w in zip(texts, vocabulary):
            longer = model.scored([t + b" zz zz"])[3][0] - model.scored([t.rsplit(b" ", 1)[1] + b" zz zz"])[3][0]
            total += 10**longer if math.isfinite(longer) else 0.0
        assert math.isfinite(before) and math.isfinite(end) and total > 0
    cells = ngram_lm.trie_bytes(*(np.array(x) for x in ([5, 5, 5, 9], np.array([1, 1, 2, 1], np.uint64) << np.uint64(24), np.array([0, 3, 4, 0], np.uint64) << np.uint64(32), [1, 3, 2, 7])))
    trie = ngram_lm.Trie(np.frombuffer(cells[0], np.uint8))
    at, count = trie.bigrams(np.array([5, 5, 9, 7], np.uint64), np.array([1, 2, 1, 1], np.uint64) << np.uint64(24))
    assert (at >= 0).tolist() == [True, True, True, False] and cells[2].tolist() == [6, 7]
    assert count[0] <= 4 - 0.6 and count[0] > (4 - 0.6) * 0.91 and count[2] > 6.4 * 0.91
    stored = trie.trigrams(trie.spans(at[:2]), np.array([3, 4], np.uint64) << np.uint64(32))
    assert 0.91 * (3 - 0.6) / 4 < stored[0] <= (3 - 0.6) / 4 and abs(stored[0] + trie.rests[at[0]] / 65535 - 1) < 2e-5


def test_steps_never_exceed_the_probability():
    p = np.random.default_rng(1).random(5000) ** 6
    q = ngram_lm.probability(ngram_lm.code_of(p))
    assert (q <= p + 1e-12).all() and (q[p > 1e-9] > p[p > 1e-9] * 0.91).all() and ngram_lm.probability(ngram_lm.code_of(np.array([1e-12, 1.0]))).tolist() == [0.0, 1.0]


def test_longer_blocks_and_many_words(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK_TOKENS", 50)
    rows = [(i, text(7000 + i, 30)) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    number = ngram_lm.Numbering()
    ids = np.concatenate([ngram_lm.numbered(t.encode(), number) for _, t in rows])
    few = ngram_lm.counted(ids, number)
    monkeypatch.setattr(ngram_lm, "NUMBERS", 1)  # as if the words were too many for one key
    assert [sorted(x) for x in zip(*map(lambda y: y.tolist(), ngram_lm.counted(ids, number)))].sort() == [sorted(x) for x in zip(*map(lambda y: y.tolist(), few))].sort()
    assert int(few[3].sum()) == sum(len(t.split()) + 1 for _, t in rows) and ngram_lm.train(table.select("text")).tokens == int(few[3].sum())


# ---------------------------------------------------------------- 7
def test_contaminated_documents(docs, empty, benchmark):
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(5, 0), (8, 0), (0, 5), (1, 5)}
    assert sorted({r[0] for r in ROWS} - {r["doc_id"] for r in decontaminate.drop_contaminated(docs, benchmark).collect()}) == [0, 1, 5, 8]
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, benchmark.limit(0)).count() == len(ROWS)


def test_short_items_as_they_are_and_crowded_seeds(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SALTED", 5)
    items = [(1, "alpha"), (2, "beta gamma"), (3, "delta beta gamma eta"), (4, "Beta, gamma!"), (5, text(77, 20))]
    rows = [(0, "an ALPHA."), (1, "beta gamma"), (2, "beta x gamma"), (3, "so delta beta gamma eta"), (4, "delta beta x eta"), *((10 + i, f"{text(800 + i, 5)} {text(77, 20)} {text(850 + i, 5)}") for i in range(40))]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(0, 1), (1, 2), (1, 4), (3, 2), (3, 3), (3, 4), *((10 + i, 5) for i in range(40))}


def overlaps(doc, item):
    """The rule in plain Python: 16 of 20 aligned tokens, 80 % of a shorter item."""
    d, i = decontaminate.tokens(doc.encode()), decontaminate.tokens(item.encode())
    width = min(20, len(i))
    for shift in range(-len(i) + width, len(d) - width + 1):
        same = [0 <= k < len(i) and d[shift + k] == i[k] if 0 <= shift + k < len(d) else False for k in range(len(i))]
        if any(sum(same[a : a + width]) >= 0.8 * width for a in range(len(i) - width + 1) if 0 <= shift + a and shift + a + width <= len(d)):
            return True
    return False


def test_contamination_equals_brute_force(spark):
    r = np.random.default_rng(31)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [(i, " ".join(vocabulary[k] for k in r.integers(0, 400, n))) for i, n in enumerate([5, 8, 12, 15, 19, 20, 27, 40] * 2)]
    rows = []
    for d in range(150):
        w = [vocabulary[k] for k in r.integers(0, 400, 60)]
        piece = items[r.integers(len(items))][1].split()
        piece = [x if r.random() > 0.17 else "zz" for x in piece]
        at = int(r.integers(0, 50))
        rows.append((d, " ".join([*w[:at], *piece[int(r.integers(0, 3)) * (len(piece) > 25) :], *w[at:]])))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i) for d, t in rows for i, x in items if overlaps(t, x)}
    assert got == want and 60 < len(want) < 150


def test_substitutions_are_tolerated(spark):
    base = text(40, 40).split()
    r = np.random.default_rng(9)
    rows, want = [], 0
    for i in range(60):
        w = list(base)
        for k in r.choice(40, 4, replace=False):
            w[k] = f"sub{k}"
        rows.append((i, " ".join([text(1000 + i, 50), *w, text(2000 + i, 50)])))
        want += 1
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(base))], "item_id long, text string"))
    assert got.count() == want


def test_seeds_leave_out_no_pattern_of_substitutions():
    for n in range(1, 21):
        masks = [[i for i, c in enumerate(m) if c == "1"] for _, m in decontaminate.seeds_of(decontaminate.least_of(n))]
        for gone in itertools.combinations(range(n), n // 5):
            assert any(not {i + o for i in m} & set(gone) for m in masks for o in range(n - m[-1])), (n, gone)


def test_short_items_with_every_fifth_word_changed(spark):
    items, rows, want = [], [], set()
    for n in (5, 9, 10, 13, 14, 15, 16, 19, 20):
        words = text(500 + n, n).split()
        items.append((n, " ".join(words)))
        for k, gone in enumerate(itertools.combinations(range(n), n // 5)):
            if k % 37 == 0 or n < 13:
                changed = " ".join("zz" if i in gone else w for i, w in enumerate(words))
                rows.append((n * 1000 + k, f"{text(900 + k, 30)} {changed} {text(1900 + k, 30)}"))
                want.add((n * 1000 + k, n))
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


# ---------------------------------------------------------------- 8
def plain_shard(key, leaves):
    """Weighted draws down the tree: the least -ln(u) / weight, u from an MD5 of the key and the path."""

    def drawn(label, weights):
        u = lambda c: (int(hashlib.md5(f"{key}|{label}{c}".encode()).hexdigest()[:13], 16) + 1) / 2**52
        return min(weights, key=lambda c: (-math.log(u(c)) / weights[c], c))

    region = drawn("g", {x.region: sum(y.weight for y in leaves if y.region == x.region) for x in leaves})
    inside = [x for x in leaves if x.region == region]
    rack = drawn(f"g{region}k", {x.rack: sum(y.weight for y in inside if y.rack == x.rack) for x in inside})
    return drawn(f"g{region}k{rack}s", {x.number: x.weight for x in inside if x.rack == rack})


def test_every_shard_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text_of = {r["doc_id"]: r["text"] for r in docs.collect()}
    leaves = sharding.tree(16)
    for r in sharding.shard(docs, leaves).collect():
        data = (text_of[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), plain_shard(str(r["doc_id"]), leaves), plain_shard(str(r["doc_id"]), sharding.grown(leaves)))


def test_a_shard_inside_a_rack_moves_rows_only_into_its_subtrees(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    leaves = sharding.tree(16)
    more = sharding.grown(leaves, region=1, rack=0)
    where = {x.number: (x.region, x.rack) for x in more}
    rows = sharding.with_shard(sharding.with_shard(ids, F.col("k"), leaves, "a"), F.col("k"), more, "b").collect()
    moved = [(where[r["a"]], where[r["b"]], r["b"]) for r in rows if r["a"] != r["b"]]
    assert moved and all(b[0] == 1 for a, b, _ in moved)  # only into the region
    assert all(b == (1, 0) for a, b, _ in moved if a[0] == 1)  # within it only into the rack
    assert all(n == 16 for a, b, n in moved if a == (1, 0) == b)  # within that only into the shard


def test_shards(docs, empty):
    got = sharding.shard(docs, sharding.tree(16)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r["grown_shard"] in (r["shard"], 16)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    plain = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS}
    assert all((r["size"], r["text_crc32"], r["law"]) == (*plain[r["doc_id"]], "key") for r in got)
    for r in got:
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (plain_shard(key, sharding.tree(16)), plain_shard(key, sharding.grown(sharding.tree(16))))
    assert sharding.shard(empty, sharding.tree(16)).count() == 0


def test_growth_moves_only_into_the_new_shard_and_weights_hold(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    leaves = sharding.tree(16)
    heavier = [sharding.Shard(x.region, x.rack, x.number, 3.0 if x.number == 5 else 1.0) for x in leaves]
    rows = sharding.with_shard(sharding.with_shard(sharding.with_shard(ids, F.col("k"), leaves, "a"), F.col("k"), sharding.grown(leaves), "b"), F.col("k"), heavier, "c").collect()
    moved = [r for r in rows if r["a"] != r["b"]]
    assert {r["b"] for r in moved} == {16} and 0.04 < len(moved) / len(rows) < 0.08
    counts = collections.Counter(r["a"] for r in rows)
    assert len(counts) == 16 and max(counts.values()) < 1.15 * 1250
    share = collections.Counter(r["c"] for r in rows)[5] / len(rows)
    assert 0.14 < share < 0.19
    assert all(r["c"] // 4 == 1 for r in rows if r["a"] // 4 != r["c"] // 4)  # regions that did not change receive nothing


# ---------------------------------------------------------------- 9
def plain_measures(t):
    w = (t or "").encode().split()
    lines = [x for x in (t or "").encode().split(b"\n") if x.split()]
    seen = collections.defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
    chars = sum(len(x.decode()) for x in w)
    return (len(w), chars, sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))


def test_ledger_measures(spark, docs, empty):
    more = [(24, "- a\n* b\n\u2022 c\n-d\n", "", "", 0), (25, "so on...\nand\u2026\nend.", "", "", 0), (20, "a b c a b c a b", "", "", 0), (21, "x\nx\n x\n\n\nx y", "", "", 0), (22, "a a a a", "", "", 0), (23, "##| <b> é", "", "", 0)]
    rows = rules.ledger(docs.select("doc_id", "text").union(spark.createDataFrame(more, SCHEMA).select("doc_id", "text"))).collect()
    want = {r[0]: plain_measures(r[1]) for r in [*ROWS, *more]}
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[r["doc_id"]]
        assert (r["n_bullets"], r["n_cut_lines"]) == {24: (3, 0), 25: (0, 2)}.get(r["doc_id"], (0, 0))
    assert len(rows) == len(ROWS) + len(more)
    assert rules.ledger(empty).count() == 0


def test_policies_and_ablations_come_from_the_bits(spark):
    t = spark.createDataFrame([(0b000011,), (0b000001,), (0,), (0b010000,), (0b010000,)], "failed int").select(F.col("failed").cast("long").alias("failed"))
    assert [r["kept"] for r in rules.decide(t, "base").collect()] == [False, False, True, True, True]
    assert sum(r["kept"] for r in rules.decide(t, "v1").collect()) == 1
    got = {r["rule"]: (r["failed_rows"], r["only_this_rule"]) for r in rules.ablations(t, "v1").collect()}
    assert got["few_words"] == (2, 1) and got["repeated_words"] == (1, 0) and got["symbols"] == (2, 2) and got["long_words"] == (0, 0)
