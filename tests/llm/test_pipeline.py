from collections import defaultdict

import pytest

from halyard.llm import decontam, linededup, packing, queries, simhash


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


def test_stages_against_brute_force(spark, pipeline, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 34", "en", "s", 5), (-3, "", "en", "s", 0), (-4, "word", None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    root = tmp_path_factory.mktemp("stages")
    before = {r["doc_id"]: r for r in docs.collect()}
    items = [(str(r["item_id"]), decontam.words_of(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(root / str(i)))
        docs = spark.read.parquet(str(root / str(i)))
        if i == len(pipeline.STAGES) - 1:
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        if name == "language ID":
            assert set(before) - set(after) == {-1, -2, -3}
        elif name == "line dedup":
            held = defaultdict(set)
            key = lambda x: x.strip(linededup.BLANKS).translate(str.maketrans(linededup.UPPER, linededup.LOWER))
            for d, r in before.items():
                for line in r["text"].split("\n"):
                    if len(key(line)) >= 10:
                        held[key(line)].add(d)
            want = {d: "\n".join(x for x in r["text"].split("\n") if len(held[key(x)]) < 2 or min(held[key(x)]) == d) for d, r in before.items()}
            assert {d: r["text"] for d, r in after.items()} == want
            assert all(r["n_chars"] == len(r["text"]) for d, r in after.items() if r["text"] != before[d]["text"])
        elif name == "SimHash near-dedup":
            ids = sorted(before)
            fps = {d: simhash.fingerprint(before[d]["text"]) for d in ids}
            group = {d: d for d in ids}
            changed = True
            while changed:
                changed = False
                for a in ids:
                    for b in ids:
                        if (fps[a] ^ fps[b]).bit_count() <= 3 and group[b] < group[a]:
                            group[a], changed = group[b], True
            assert set(after) == {d for d in ids if group[d] == d}
        else:
            automaton = decontam.Automaton(items, 13)
            for d, r in before.items():
                spans, _ = automaton.hits(decontam.words_of(r["text"]))
                hit = sum(b - a for a, b in spans)
                assert (d in after) == (not (hit and 20 * hit >= len(decontam.words_of(r["text"]))))
                if d in after:
                    assert after[d]["text"] == r["text"] if not hit else not automaton.hits(decontam.words_of(after[d]["text"]))[1]
        before = after
    encoder = packing.Encoder(queries.tokenizer_path())
    lengths = defaultdict(int)
    for r in docs.collect():
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {d: len(next(encoder.encode([r["text"]]))) + 1 for d, r in before.items()}


def test_pipeline_query(spark, pipeline, tiny):
    out = pipeline.run(spark, tiny)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_names():
    import re

    assert [n for n in queries.QUERIES] == sorted(queries.QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1])) and len(queries.QUERIES) == 10
