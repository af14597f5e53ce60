"""Tokenizer alignment, ranked search and nearest neighbours against plain Python, on awkward rows and on whole small tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stepwright.llm import alignment, decontaminate, lexical, neighbours

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a", "a  b ", "\nfoo\n\n bar", "a▁b", "don't. Stop, 3.5 ok..", "x\r\ny", "tab\tq", "<|endoftext|> hi </s> <s>", "漢字 かな", "é ü ß", "a　b", "\xa0x", "İstanbul", " \n \n", "foo.\n.bar ,"]
CLASHES = ["block", "pairs", "links", "shard", "term", "query", "rank", "score", "size", "digest", "v", "ids", "dim", "__term", "__pair", "count", "best", "upto", "sizes"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHES}).repartition(3)


# ---------------------------------------------------------------- 11
def plain_alignment(texts):
    """Rows by byte ranges of all tokens, from the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    from stepwright.llm.pieces import printable_bytes

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp, inverse = sentencepiece.SentencePieceProcessor(model_file=B), {c: b for b, c in printable_bytes().items()}
    rows, links = [], []
    for x in texts:
        row, own = [0, 0, 0, 0, ""], []
        if x:
            whole = " " + x
            a, b = t.encode(whole, add_special_tokens=False).ids, sp.encode(x)
            data_a = [bytes(inverse[c] for c in t.id_to_token(i)) for i in a]
            data_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(data_a) == whole.encode() == b"".join(data_b):
                ends_a, ends_b = np.cumsum([len(z) for z in data_a]), np.cumsum([len(z) for z in data_b])
                begin_a, begin_b = ends_a - [len(z) for z in data_a], ends_b - [len(z) for z in data_b]
                own = [(a[i], b[j]) for i in range(len(a)) for j in np.flatnonzero((begin_b < ends_a[i]) & (ends_b > begin_a[i]))]
                groups, last = [], 0
                for cut in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
                    of = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends) if last < e <= cut)  # noqa: B023, E731
                    groups.append(f"{of(a, ends_a)}|{of(b, ends_b)}")
                    last = cut
                row = [len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()]
        rows.append(row)
        links.append(own)
    held = collections.Counter(p for own in links for p in set(own))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    return [(*r[:4], sum(held[p] == best[p[0]] for p in own), sum(held[p] for p in own), r[4]) for r, own in zip(rows, links)]


def test_alignment_of_awkward_texts(spark):
    draw = random.Random(1)
    texts = [*ODD, *("".join(draw.choice(" \n\tabcdeéñ.,'3!<>|{}_²") for _ in range(50)) for _ in range(150)), "long word. " * 200, ODD[7], ODD[7]]
    got = sorted(map(tuple, alignment.alignment(documents(spark, texts), A, B).collect()))
    assert [r[1:] for r in got] == [tuple(r) for r in plain_alignment(texts)]


def test_alignment_in_many_blocks_of_a_whole_table(spark, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)  # a block for each part
    got = sorted(map(tuple, alignment.alignment(docs, A, B).collect()))
    assert [r[1:] for r in got] == [tuple(r) for r in plain_alignment(texts)]


def test_alignment_of_nothing(spark):
    assert alignment.alignment(documents(spark, ["x"]).limit(0), A, B).collect() == []
    rows = alignment.alignment(spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string"), A, B).collect()
    assert sorted((r["doc_id"], r["n_a"]) for r in rows) == [(None, 0), (None, 1)]


def test_links_of_a_group_are_the_overlaps():
    size = [1, 2, 3, 4]
    groups, links = alignment.align([3, 0, 1], [1, 2, 1], size, size)  # ends 4 5 7 and 2 5 7
    assert groups == [(0, 2, 0, 2), (2, 3, 2, 3)]
    assert links == [3 << 32 | 1, 3 << 32 | 2, 0 << 32 | 2, 1 << 32 | 1]


# ---------------------------------------------------------------- 12
def plain_search(texts, queries, top=10):
    bag = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [collections.Counter(bag(t)) for t in texts]
    n_docs, n_terms = sum(bool(d) for d in docs), sum(d.total() for d in docs)
    df = collections.Counter(t for d in docs for t in d)
    out = []
    for item, text in queries:
        scores = []
        for i, d in enumerate(docs):
            m = 25 + 75 * d.total() * n_docs // n_terms if n_terms else 0
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * d[t] // (1000 * d[t] + 8 * m)) for t, n in collections.Counter(bag(text)).items() if d[t])
            scores += [(-s, i)] if s > 0 else []
        out += [(item, k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def awkward_search(spark):
    draw = random.Random(2)
    words = ["alpha", "Beta", "gamma", "d1", "é", "naïve", "x", "the", "the", "the"]
    texts = [*ODD, *(" ".join(draw.choice(words) for _ in range(draw.randrange(1, 40))) for _ in range(300)), "the alpha " * 30_000, *["beta x gamma"] * 120]
    queries = [(0, "alpha BETA the"), (1, "x x gamma, naïve"), (1, "é"), (1, "é"), (2, None), (3, ""), (4, "nowhere"), (5, "the " * 50 + "d1"), (6, " ".join(set(words)))]
    return texts, queries, spark.createDataFrame(queries, "item_id long, text string").withColumn("rank", F.lit("x"))


@pytest.mark.parametrize(("shard_docs", "block_bytes"), [(16_384, 8 << 20), (20, 8 << 20), (50, 40)])
def test_search_with_ties_in_shards_and_blocks(spark, shard_docs, block_bytes):
    texts, queries, frame = awkward_search(spark)
    got = lexical.search(documents(spark, texts), frame, 10, shard_docs, block_bytes).collect()
    assert sorted(map(tuple, got)) == plain_search(texts, queries)


def test_search_of_nothing(spark):
    texts, _, frame = awkward_search(spark)
    assert lexical.search(documents(spark, texts).limit(0), frame).collect() == []
    assert lexical.search(documents(spark, texts), frame.limit(0)).collect() == []
    assert lexical.search(documents(spark, [None, "", "-"]), frame).collect() == []


def test_lists_are_read_no_further_than_needed():
    """A document far ahead of all others closes the search before the long list is read to its end; ties keep it open."""
    n = 10_000
    ahead = lambda: [lexical.Postings(np.arange(n), np.r_[10**6, np.full(n - 1, 5)]), lexical.Postings(np.array([0]), np.array([10**6]))]
    lists = ahead()
    places, scores = lexical.resolved(lists, n, 1)
    assert (places.tolist(), scores.tolist()) == ([0], [2 * 10**6]) and lists[0].read < n / 10
    lists = ahead()
    places, scores = lexical.resolved(lists, n, 2)
    assert len(places) == n and lists[0].read == n and scores.tolist()[:2] == [2 * 10**6, 5]


# ---------------------------------------------------------------- 13
def plain_neighbours(rows, every, top):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, v) in enumerate(good):
        if i is not None and i % every == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), j is None, j or 0) for m, (j, w) in enumerate(good) if m != n and len(w) == len(v))
            out += [(i, k, None if no else j, d) for k, (d, no, j) in enumerate(near[:top], 1)]
    return out


def recall(got, want):
    got, want = ({(r[0], r[2]) for r in rows} for rows in (got, want))
    return len(got & want) / len(want)


@pytest.mark.parametrize("shard_nodes", [8192, 90])
def test_neighbours_of_awkward_vectors(spark, shard_nodes):
    draw = np.random.default_rng(3)
    hot = draw.normal(size=4).tolist()
    rows = [(i, hot if i % 3 == 0 else draw.normal(size=4).tolist()) for i in range(900)]
    rows += [(5, None), (100, [0.0] * 4), (200, [1.0, None, 2.0, 3.0]), (300, [float("nan")] * 4), (400, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(100, hot), (100, hot), (None, hot), (None, [1.0, 2.0, 3.0, 4.0]), (0, [1.0, 2.0]), (7, [1.0, 3.0]), (500, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in CLASHES}).repartition(5)
    got = sorted(map(str, map(tuple, neighbours.nearest_neighbours(frame, shard_nodes=shard_nodes).collect())))
    assert got == sorted(map(str, plain_neighbours(rows, 100, 10)))


def test_neighbours_of_a_whole_table_in_one_graph_and_in_many(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = plain_neighbours([(r["vec_id"], r["embedding"]) for r in table.collect()], 20, 10)
    for shard_nodes, beam in ((8192, 48), (300, 48)):
        assert recall(neighbours.nearest_neighbours(table, 20, 10, shard_nodes, beam).collect(), want) >= 0.95


def test_neighbours_of_nothing_and_of_few(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [3.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest_neighbours(few.limit(0)).collect() == []
    assert list(map(tuple, neighbours.nearest_neighbours(few).collect())) == [(0, 1, 1, 2.0)]


def test_graph_of_one_cluster_in_another_scale():
    """Clusters far apart and vectors of unlike length keep the graph in one piece."""
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(size=(400, 8)) + c * 1e3 for c in range(5)] + [draw.normal(size=(400, 8)) * 1e-3])
    graph = neighbours.Graph(x[draw.permutation(len(x))], neighbours.draw_levels(len(x), 1), [])
    graph.build()
    found = graph.nearest(graph.x[::40], 64)
    hits = [len(set(np.argsort(((graph.x - q) ** 2).sum(1))[:10]) & set(row.tolist())) for q, row in zip(graph.x[::40], found)]
    assert sum(hits) / (10 * len(hits)) >= 0.95


# ---------------------------------------------------------------- 7
def test_only_rows_that_leak_go_though_ids_are_shared(spark):
    leak = " ".join(f"leak{i}" for i in range(30))
    clean = [" ".join(f"clean{i}w{k}" for i in range(30)) for k in range(3)]
    docs = spark.createDataFrame([(None, leak), (None, clean[0]), (4, clean[1]), (4, f"{clean[0]} {leak}"), (4, clean[2])], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert sorted(r["text"] for r in decontaminate.drop_contaminated(docs, benchmark).collect()) == sorted(clean)
