import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import decontam, queries, suffixdedup, topk

V = "vec_id long, embedding array<float>, label int, rank int, score string"


def brute_top(rows, asked, k=20, scale=64):
    sound = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in sound:
        if q in asked:
            found = sorted((-sum(a * b for a, b in zip(w, d, strict=False)), i) for i, d in sound if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(300, None), (301, []), (302, [1.0, None, 1, 1, 1, 1]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (305, [9.0]), (306, [-2.0] * 9), (None, [1.0] * 6), (307, [0.0] * 6), (308, [300.0, -5000.0, 1, 1, 1, 1])]
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, 7, "x") for i, v in rows], V).repartition(3)
    for n in (1 << 30, 2000):  # one chunk, many chunks
        got = topk.top_k(df, df.where("vec_id % 20 = 0 OR vec_id > 299"), chunk_bytes=n).select("query_id", "rank", "vec_id", "score")
        assert sorted(map(tuple, got.collect())) == brute_top(rows, {i for i, _ in rows if i is not None and (i % 20 == 0 or i > 299)})


def test_top_k_over_many_tiles_and_chunks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(200)]) for i in range(60)]  # long vectors too
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = topk.top_k(df, df, 7, chunk_bytes=1)
    assert sorted(map(tuple, got.collect())) == sorted(
        (q, n + 1, i, -s) for q, w in rows for n, (s, i) in enumerate(sorted((-sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(w, d, strict=True)), i) for i, d in rows if i != q)[:7])
    )


def test_top_k_of_little(spark):
    df = spark.createDataFrame([(1, [1.0], 1, 1, ""), (2, [2.0], 1, 1, "")], V)
    assert sorted(map(tuple, topk.top_k(df, df).select("query_id", "rank", "vec_id", "score").collect())) == [(1, 1, 2, 64 * 128), (2, 1, 1, 64 * 128)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0


def test_blocks_that_cannot_matter_are_not_scored():
    rng = np.random.default_rng(0)
    centres = np.eye(8, dtype=np.int32) * 100
    rows = np.concatenate([c + rng.integers(-3, 4, (topk.BLOCK, 8)) for c in centres]).astype(np.int32)
    ids = np.arange(len(rows))
    search = topk.Search(ids[::50], rows[::50], 5)
    search.add(topk.Blocks(ids, rows))
    assert search.scored < 2 * len(ids[::50])
    q = rows[::50][3]
    want = sorted((-int(s), int(i)) for i, s in zip(ids, rows @ q, strict=True) if i != ids[::50][3])[:5]
    assert list(zip((-search.scores[3]).tolist(), search.found[3].tolist(), strict=True)) == want


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(items, text, window=13):
    own = words(text)
    hit, found = [0] * len(own), set()
    for i, t in items:
        x = words(t)
        if x:
            n = min(window, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in wins:
                    found.add(str(i))
                    hit[k : k + n] = [1] * n
    return len(own), sum(hit), found


@pytest.mark.parametrize("window", [1, 3, 5])
def test_automaton_against_brute_force(window):
    rng = random.Random(window)
    for trial in range(400):
        vocabulary = "ab" if trial % 2 else "abcd"
        items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for i in range(rng.randint(0, 5))]
        text = " ".join(rng.choice(vocabulary + "z") for _ in range(rng.randint(0, 40)))
        spans, found = decontam.Automaton([(i, decontam.words_of(t)) for i, t in items], window).hits(decontam.words_of(text))
        assert (sum(b - a for a, b in spans), found) == brute_hits(items, text, window)[1:]


def test_words_are_those_of_the_pattern():
    rng = random.Random(9)
    alphabet = "aZ09 _-'\x00\x7f\x80é中\n|{`@[🙂"
    for _ in range(500):
        t = "".join(rng.choice(alphabet) for _ in range(30))
        assert [w.decode() for w in decontam.words_of(t)] == words(t)


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet consectetur".split()) + str(rng.randint(0, 99)) for _ in range(n))
    items = [(1, text(40)), (2, text(13)), (3, "Short item, here."), (4, ""), (5, None), (6, text(30)), (6, text(20))]
    docs = [(0, text(50)), (1, text(300) + "! " + items[0][1].upper() + " (tail) " + text(5)), (2, items[1][1]), (3, text(500) + " short, ITEM here " + text(5)), (4, None), (5, ""), (6, "..."), (7, text(20) + " " + " ".join(items[0][1].split()[5:17])), (None, items[5][1])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_decontamination_report(leaks):
    import hashlib

    docs, benchmark, rows, items = leaks
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.report(docs, benchmark).collect()}
    for d, t in rows:
        n, hit, found = brute_hits(items, t)
        assert got[d] == (n, hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), hit > 0 and 20 * hit >= n)
    assert got[2][4] and got[1][4] and not got[3][4] and got[3][1] == 3 and got[7][1] == 0
    assert decontam.report(docs.limit(0), benchmark).count() == 0
    assert decontam.report(docs, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_large_components_take_part(spark):
    rng = random.Random(4)
    scales = [1.0, 2.0**19, 2.0**20, 2.0**24]
    rows = [(i, [rng.uniform(-1, 1) * scales[(i + j) % 4] for j in range(4)]) for i in range(60)]
    rows += [(100, [2.0**24, 0.0, 0.0, 0.0]), (101, [0.0, 2.0**25, 0.0, 0.0]), (102, [-(2.0**55), 0.0, 0.0, 0.0]), (103, [None, 2.0**30, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id < 10")
    weight = {i: [math.floor(64 * x) for x in v] for i, v in rows if None not in v}
    want = set()
    for q in range(10):
        scores = sorted((-sum(a * b for a, b in zip(weight[q], w, strict=True)), i) for i, w in weight.items() if i != q and i != 102)
        want |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(scores[:5])}
    assert {tuple(r) for r in topk.top_k(df.where("vec_id != 102"), queries, 5).collect()} == want
    small = spark.createDataFrame([(1, [0.25, 4.0]), (2, [2.0**50, 1.0]), (3, [-(2.0**50), 1.0])], "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(small, small.where("vec_id = 1")).collect()}
    assert got == {(1, 1, 2, (16 << 56) + 256 * 64), (1, 2, 3, -(16 << 56) + 256 * 64)}


def test_decontamination_sql(leaks):
    import duckdb

    docs, benchmark, _, _ = leaks
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", benchmark.toPandas())
    rel = con.sql(decontam.SQL)
    names = [d[0] for d in rel.description]
    want = sorted((tuple(None if v != v else v for v in r) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in decontam.report(docs, benchmark).collect()), key=repr) == want


def test_items_without_an_id_hit_but_are_not_named(leaks):
    docs, benchmark, _, items = leaks
    nameless = benchmark.withColumn("item_id", F.lit(None).cast("long"))
    for n in (10_000, 30):
        named, got = ({r["doc_id"]: r for r in decontam.report(docs, b, shard_words=n).collect()} for b in (benchmark, nameless))
        assert {d: (r["n_hit"], r["contaminated"]) for d, r in got.items()} == {d: (r["n_hit"], r["contaminated"]) for d, r in named.items()}
        assert {r["n_items"] for r in got.values()} == {0} and any(r["n_items"] for r in named.values())
        cut = [sorted(map(tuple, decontam.decontaminate(docs, b, shard_words=n).collect()), key=repr) for b in (benchmark, nameless)]
        assert cut[0] == cut[1]


def test_shards_find_the_same(leaks):
    docs, benchmark, _, _ = leaks
    parts = list(decontam.shards(benchmark, 30))
    assert len(parts) > 2 and sum(map(len, parts)) == 6
    whole, split = (sorted(map(tuple, decontam.report(docs, benchmark, shard_words=n).collect()), key=repr) for n in (10_000, 30))
    assert whole == split
    whole, split = (sorted(map(tuple, decontam.decontaminate(docs, benchmark, shard_words=n).collect()), key=repr) for n in (10_000, 30))
    assert whole == split


def test_decontaminated_documents(leaks):
    docs, benchmark, rows, items = leaks
    extra = docs.select(F.lit("k").alias("n_hit"), "doc_id", "text", F.length("text").cast("long").alias("n_chars"))
    out = {r["doc_id"]: r for r in decontam.decontaminate(extra, benchmark).collect()}
    assert set(out) == {0, 3, 4, 5, 6, 7}
    assert out[0]["text"] == rows[0][1] and out[0]["n_hit"] == "k"
    assert brute_hits(items, out[3]["text"])[1] == 0 and out[3]["n_chars"] == len(out[3]["text"]) and len(words(out[3]["text"])) == 505


def brute_repeats(texts, least):
    hashes = {d: suffixdedup.gram_hashes(suffixdedup.word_hashes(t), least) for d, t in texts.items() if t}
    held = defaultdict(set)
    for d, g in hashes.items():
        for h in g.tolist():
            held[h].add(d)
    out = defaultdict(set)
    for d, g in hashes.items():
        for i, h in enumerate(g.tolist()):
            if len(held[h]) > 1:
                out[d].update(range(i, i + least))
    return {d: s for d, s in out.items() if s}


def test_minimisers_are_shared_by_equal_passages():
    rng = random.Random(8)
    for _ in range(50):
        passage = [str(rng.randint(0, 500)) for _ in range(40)]
        places = []
        for _ in range(2):
            before = [str(rng.randint(0, 500)) for _ in range(rng.randint(0, 30))]
            text = " ".join([*before, *passage, *[str(rng.randint(0, 500)) for _ in range(20)]])
            at = suffixdedup.minimisers(suffixdedup.gram_hashes(suffixdedup.word_hashes(text), 8), 16) - len(before)
            places.append({int(x) for x in at if 0 <= x <= 40 - 8})
        inner = {x for x in places[0] if 15 <= x <= 40 - 8 - 15}
        assert places[0] & places[1] and inner <= places[1]
        window = sorted(places[0] & places[1])
        assert window[0] < 16


def test_repeated_passages_against_brute_force(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(str(rng.randint(0, 3000)) for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 64, 70, 200)]
    texts = {i: text(rng.randint(0, 120)) + " " + shared[i % 6].replace(" ", "\n" if i % 2 else "  ") + " " + text(rng.randint(0, 120)) for i in range(60)}
    texts |= {100: text(80), 101: text(49), 102: None, 103: "", 104: " ".join([shared[5]] * 3), 105: " ".join(text(60).split() * 2)}
    texts |= {110: texts[100], 111: texts[101], 112: texts[3]}
    rows = [(d, t, "x") for d, t in texts.items()] + [(110, texts[110], "x"), (None, texts[100], "x")]
    got = defaultdict(set)
    for r in suffixdedup.repeats(spark.createDataFrame(rows, "doc_id long, text string, mark string")).collect():
        assert r["end_word"] - r["start_word"] >= 50 and r["n_words"] == len(texts[r["doc_id"]].split())
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert dict(got) == brute_repeats(texts, 50)
    assert 110 in got and 111 not in got and 105 not in got


@pytest.mark.parametrize("tasks", [1, 4, 40])
def test_every_copy_within_a_text_meets_the_other_texts(spark, tasks):
    rng = random.Random(12)
    text = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    texts = {}
    for i in range(0, 24, 2):
        passage = text(130)
        texts[i] = " ".join(f"{passage} {text(5)}" for _ in range(30)) if i % 4 else " ".join([passage] * 40)
        texts[i + 1] = f"{text(20)} {passage} {text(20)}"
    held = {n: spark.conf.get(n, None) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = suffixdedup.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    finally:
        for n, v in held.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert dict(got) == brute_repeats(texts, 50)


@pytest.mark.parametrize("tasks", [1, 5, 40])
def test_short_passages_between_rows_that_share_only_their_right_part(spark, tasks):
    rng = random.Random(13)
    text = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    texts = {}
    for _ in range(6):  # sets of texts that share a right part behind left parts of their own
        right = text(rng.randint(36, 49)).split()
        for _ in range(4):
            left, n = text(14).split(), len(texts)
            for i in range(rng.randint(1, 3)):
                cut = rng.randint(0, 14)
                texts[n + i] = " ".join([text(30), *left[cut:], *right, text(rng.randint(0, 3)), *([text(40), *left, *right] if i == 1 else []), text(30)])
        for i in range(len(texts), len(texts) + 20):
            texts[i] = " ".join([text(30), *right[: rng.randint(35, len(right))], text(30)])
    for i in range(len(texts), len(texts) + 60):  # longer passages with shared middles
        at = rng.randint(0, 40)
        texts[i] = " ".join([text(20), *right[at % 30 :], *texts[0].split()[at : at + rng.randint(45, 70)], *right[: rng.randint(10, 40)], text(20)])
    held = {n: spark.conf.get(n, None) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = suffixdedup.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    finally:
        for n, v in held.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert dict(got) == brute_repeats(texts, 50)


def test_repeats_of_nothing(spark):
    assert suffixdedup.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_on_the_small_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = defaultdict(set)
    for r in queries.op5_suffix_array_dedup(spark, tiny).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert dict(got) == brute_repeats({r["doc_id"]: r["text"] for r in docs.collect()}, 50)
