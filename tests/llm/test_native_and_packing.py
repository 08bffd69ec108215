import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import common, linededup, packing, queries, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, _mark int, fp string, component_id string"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "f", "c") for i, t in enumerate(texts, start)], DOCS)


LINES = ["Shared line number one", "shared LINE number one \t", "short", "Only here, long enough", "", " \x0b", "a much longer shared line"]


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    held = defaultdict(set)
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 10:
                    held[key(x)].add(d)
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if d is None or len(held[key(x)]) < 2 or min(held[key(x)]) == d]
        out.append((d, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_against_brute_force_and_sql(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(40, None), (41, ""), (42, "é" * 9 + "\n" + "é" * 10), (43, "é" * 10), (44, "\n".join(["Shared line number one"] * 3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, linededup.digest(df).collect()), key=repr)
    assert got == brute_lines(rows)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(con.sql(linededup.SQL).fetchall(), key=repr) == got


def test_lines_of_odd_rows(spark):
    rows = [(1, "a line that repeats\nb"), (1, "a line that repeats\nb"), (None, "a line that repeats\nc"), (2, "A line that repeats"), (2, "other text, same id\na line that repeats")]
    assert sorted(map(tuple, linededup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr) == brute_lines(rows)
    assert linededup.digest(docs_of(spark, []).limit(0)).count() == 0
    out = linededup.dedup_lines(docs_of(spark, ["x\na shared long line", "a shared long line\ny", "z"]))
    assert set(out.columns) == {c.strip().split(" ")[0] for c in DOCS.split(",")} | {"n_dropped"}
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"], r["fp"], r["_mark"]) for r in out.collect()} == {0: ("x\na shared long line", 2, 0, "f", 1), 1: ("y", 2, 1, "f", 1), 2: ("z", 1, 0, "f", 1)}


def test_a_document_of_many_lines(spark):
    """Reassembly is linear: 200,000 lines, half of them dropped."""
    import time

    text = "\n".join(f"line that is held twice {i}" if i % 2 else f"line of this text alone {i}" for i in range(200_000))
    other = "\n".join(f"line that is held twice {i}" for i in range(1, 200_000, 2))
    start = time.time()
    out = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame([(2, text), (1, other)], "doc_id long, text string")).collect()}
    assert time.time() - start < 60
    assert out[2]["n_lines"] == 200_000 and out[2]["n_dropped"] == 100_000 and out[1]["text"] == other
    assert out[2]["text"] == "\n".join(f"line of this text alone {i}" for i in range(0, 200_000, 2))


def test_lines_with_a_higher_threshold(spark):
    df = spark.createDataFrame([(i, "a shared long line") for i in range(3)] + [(8, "held by only two"), (9, "held by only two")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(df, min_docs=3).collect()} == {0: 0, 1: 1, 2: 1, 8: 0, 9: 0}


def test_line_dedup_is_native(spark, tiny):
    plan = queries.op10_line_dedup(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))


def components(ids, fps, radius):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints():
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One  two") == xxhash.xxh64_intdigest(b"one two", 42)
    words = [random.Random(1).choice("abcdefg") for _ in range(50)]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(48)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 48)
    assert simhash.fingerprint(" ".join(words)) == want
    assert simhash.fingerprint("É A\xa0B c") == xxhash.xxh64_intdigest("É a\xa0b c".encode(), 42)


def test_spark_xxhash_is_the_same(spark):
    got = spark.createDataFrame([("one two three and a good deal more than that",)], "s string").select(F.xxhash64("s")).first()[0]
    import xxhash

    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"one two three and a good deal more than that", 42)


def test_block_links_join_just_what_is_linked(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.concatenate([base, base[:30] ^ (np.uint64(1) << rng.integers(0, 63, 30, dtype=np.uint64)), base[:30] ^ np.uint64(0b10101)])
    fps = np.unique(near)
    fps = fps[simhash._order(fps)]
    for cut in (None, 50):
        parts = [(fps, None)] if cut is None else [(fps[:cut], None), (fps[cut:], None), (fps[:cut], fps[cut:])]
        edges = [simhash.block_links(a, b, 3) for a, b in parts]
        parent = {int(x): int(x) for x in fps}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
        ids = [int(x) for x in fps]
        assert {i: find(i) for i in ids} == components(ids, ids, 3)


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randint(0, 40)) for _ in range(120)) for _ in range(12)]
    texts = base + [b.replace("alpha", "ALPHA") for b in base[:6]] + [b + " tail" for b in base[:8]] + [None, "", "one", "one two three", "one two three"] + [base[0]] * 20
    df = docs_of(spark, texts, 5)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    ids = list(range(5, 5 + len(texts)))
    fps = [simhash.fingerprint(t) for t in texts]
    want = components(ids, fps, 3)
    assert got == {i: (f"{f:016x}", want[i]) for i, f in zip(ids, fps, strict=True)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize(("block", "chunk"), [(8, 1), (16, 3), (4096, 256)])
def test_chunks_meet_each_other(spark, monkeypatch, block, chunk):
    """All links are found however the fingerprints are cut into blocks and chunks."""
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(7)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 120, dtype=np.int64)
    flip = lambda n: np.array([sum(1 << int(b) for b in rng.choice(62, n, replace=False)) for _ in base], np.int64)
    fps = np.unique(np.concatenate([base, base ^ flip(1), base ^ flip(3), (base ^ flip(3))[:50] ^ flip(2)[:50]]))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long")).collect()
    parent = {int(x): int(x) for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        p, q = find(e["a"]), find(e["b"])
        parent[max(p, q)] = min(p, q)
    ids = [int(x) for x in fps]
    want = components(ids, [i % (1 << 64) for i in ids], 3)
    assert {i: find(i) for i in ids} == {i: want[i] for i in ids}


def test_scratch_frees_what_was_written(spark):
    import os

    with common.scratch(spark):
        path = common.written(spark.range(3))._written
        assert os.path.isdir(path)
    assert not os.path.isdir(path)
    df = common.written(spark.range(3))
    common.discard(df)
    assert not os.path.isdir(df._written)


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "nobody else has this")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == [(3, 3), (3, 3), (None, 3), (None, None)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7), (None, 3), (500, 501), (501, 500)] + [(900, i) for i in range(901, 960)]
    got = {r["node"]: r["label"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("capacity", [7, 16])
def test_plan_places_every_piece_once(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        histogram = {n: rng.randint(1, 30) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        used = defaultdict(list)
        for length, first, last, sequence, each, offset in packing.plan(histogram, capacity):
            for rank in range(first, last):
                i = rank - first
                used[sequence + i // each].append((offset + i % each * length, length))
        assert {n: sum(1 for s in used.values() for _, x in s if x == n) for n in histogram} == histogram
        for spots in used.values():
            at = 0
            for offset, length in sorted(spots):
                assert offset == at
                at += length
            assert at <= capacity
        bins: list[int] = []  # best fit in decreasing length, piece by piece
        for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
            fits = [i for i, room in enumerate(bins) if room >= n]
            if fits:
                bins[min(fits, key=bins.__getitem__)] -= n
            else:
                bins.append(capacity - n)
        assert len(used) == len(bins)


def test_cut_pieces():
    assert packing.cut_pieces(5, 8) == [(0, 5)] and packing.cut_pieces(16, 8) == [(0, 8), (8, 8)]
    assert packing.cut_pieces(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_encoder_gives_the_tokenizers_ids():
    encoder = packing.Encoder(queries.tokenizer_path())
    assert encoder.fast is not None
    rng = random.Random(6)
    alphabet = "ab c'sd \n\t éñß²½中🙂́\x00\x85  <|endoftext|>ll'reZ_9"
    texts = ["", None, "x" * 3000, *["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)]]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    import public_tokenizers

    other = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None and next(other.encode(["hello"])).tolist() == other.tokenizer.encode("hello", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 10**6, "\n" * 10**6, "a" * 10**6, "x" + " \n\t" * 333_333 + "y", "." * 10**6, "word " * 30_000 + " " * 600_000])
def test_long_runs_are_encoded_whole(text):
    encoder = packing.Encoder(queries.tokenizer_path())
    assert next(encoder.encode([text])).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_text_that_the_library_cannot_take_falls_back(monkeypatch):
    encoder = packing.Encoder(queries.tokenizer_path())
    monkeypatch.setattr(packing, "LONG", 1 << 30)
    assert len(next(encoder.encode([" " * 10**6]))) > 0 and encoder._by_library(" " * 10**6) is None


def test_packing_round_trip(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", F.lit(1).alias("rank"), F.lit("t").alias("task"))
    docs = docs.unionByName(spark.createDataFrame([(-1, None, 1, "t"), (-2, "", 1, "t"), (-3, "word " * 9000, 1, "t")], docs.schema))
    rows = packing.pack(docs, queries.tokenizer_path()).collect()
    encoder = packing.Encoder(queries.tokenizer_path())
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for spots in sequences.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert [i for r in own for i in r["ids"]] == [*next(encoder.encode([texts[d]])).tolist(), 0]
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == 2048 for r in own[1:])
    assert len(sequences) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1
    assert packing.pack(docs.limit(0), queries.tokenizer_path(), keep_ids=False).count() == 0
    repeated = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a b")], "doc_id long, text string"), queries.tokenizer_path()).collect()
    assert len(repeated) == 4 and len({r["sequence_id"] for r in repeated}) == 1 and len({r["offset"] for r in repeated}) == 4
