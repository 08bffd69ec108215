"""Benchmark decontamination with a generalised suffix automaton over the words of all test items.

The automaton is built on the driver from the benchmark, whose size is checked: items are put into shards of at most
`shard_words` words, so each automaton has a bounded number of states; workers get it as flat sorted arrays. A larger benchmark
makes more shards, one after the other: each is a pass over the texts that writes the hits alone, by two hashes of doc_id and text,
which are few; the last pass meets the hits of the others in a join, so neither the driver nor a worker holds two automata at a
time and documents are never rewritten. Documents are streamed past it batch by batch: the length of the longest suffix of the
words read that occurs in some item is tracked, and where it reaches a window its words are hit. Runs of words too short to
hold a window, or without the pairs of words that every window consists of, are skipped beforehand; a skipped word cannot end
or begin a match, so the tracked lengths of all others that matter are as in a full pass.

A window is `window` consecutive words of an item; a shorter item, if it has words, is one window.

Cases: null has no words; a document without words has no hits and is not contaminated; items without words never occur;
repeated items and item_ids count once; items without an id hit, but are neither counted nor named; an empty benchmark or table gives no hits or rows; columns beside the named ones are
carried through by decontaminate() untouched.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import by_batch, free_name, prepare, spread, written

#: Lower-cases A-Z, keeps digits, a-z and all bytes above 0x7F, and makes any other byte a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPAN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; transitions are sorted arrays of state and word together, and of the next state."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.length, self.link = array("q", [0]), array("q", [-1])
        self.next: dict[int, int] = {}  # while it is built: (state << 32 | word) -> state
        out: list[array] = [array("l")]
        named: list[tuple[str | None, list[int]]] = []
        for item_id, words in items:
            if words:
                ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
                named.append((item_id, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w, out)
        self._mark(named)
        keys = np.fromiter(self.next.keys(), np.int64, len(self.next))
        order = np.argsort(keys, kind="stable")
        self.keys = array("q", keys[order].tobytes())
        self.targets = array("q", np.fromiter(self.next.values(), np.int64, len(self.next))[order].tobytes())
        self.next = {}

    def _extend(self, last: int, word: int, out: list[array]) -> int:
        """The state of the sequence read so far and word, made if there is none; out: words with a transition, by state."""
        step = self.next
        there = step.get(last << 32 | word)
        if there is not None and self.length[there] == self.length[last] + 1:
            return there
        if there is None:
            made = self._state(self.length[last] + 1, out)
            p = last
            while p != -1 and (p << 32 | word) not in step:
                step[p << 32 | word] = made
                out[p].append(word)
                p = self.link[p]
            self.link[made] = 0 if p == -1 else self._split(p, step[p << 32 | word], word, out)
            return made
        return self._split(last, there, word, out)

    def _split(self, p: int, q: int, word: int, out: list[array]) -> int:
        """q itself if it holds just what p and word spell, else a copy of q for the shorter of what it held."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, out)
        out[copy] = out[q][:]
        for w in out[q]:
            self.next[copy << 32 | w] = self.next[q << 32 | w]
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next.get(p << 32 | word) == q:
            self.next[p << 32 | word] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, out: list[array]) -> int:
        self.length.append(length)
        self.link.append(-1)
        out.append(array("l"))
        return len(self.length) - 1

    def after(self, state: int, word: int) -> int:
        """The next state, -1 if there is none."""
        key = state << 32 | word
        at = bisect_left(self.keys, key)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == key else -1

    def _mark(self, items: list[tuple[str | None, list[int]]]) -> None:
        """ends: state -> (window length, items) for each state that holds a whole window; above: the nearest such state up the links."""
        ends: dict[int, tuple[int, set[str]]] = {}
        pairs: set[int] = set()
        self.shortest = self.window
        for item_id, ids in items:
            size = min(self.window, len(ids))
            self.shortest = min(self.shortest, size)
            pairs.update(a << 32 | b for a, b in zip(ids, ids[1:], strict=False))
            state = 0
            for i, w in enumerate(ids):
                state = self.next[state << 32 | w]
                if i + 1 >= size:
                    v = state
                    while self.length[self.link[v]] >= size:
                        v = self.link[v]
                    found = ends.setdefault((v, size), (size, set()))[1]
                    if item_id is not None:
                        found.add(item_id)
        at: dict[int, list[tuple[int, tuple[str, ...]]]] = defaultdict(list)
        for (v, size), (_, found) in ends.items():
            at[v].append((size, tuple(sorted(found))))
        self.ends = dict(at)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.above = array("q", [-1]) * len(self.length)
        for v in order:
            up = self.link[v]
            self.above[v] = up if up in self.ends else self.above[up]
        self.pairs = np.array(sorted(pairs), np.int64)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of the words inside occurrences of windows, merged and in order, and the items that occur."""
        n = len(words)
        if n < self.shortest or not self.words:
            return [], set()
        known = self.words.get
        ids = np.fromiter(map(known, words, repeat(0)), np.int64, n)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for start, end in self._stretches(ids):
            self._stream(ids[start:end].tolist(), start, spans, items)
        return merged(spans), items

    def _stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Maximal runs [start, end) of words each pair of which follows each other in some item too, and long enough for a window."""
        if self.shortest == 1:
            good = ids > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
            return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        if not len(self.pairs):
            return []
        keys = ids[:-1] << 32 | ids[1:]
        both = (ids[:-1] > 0) & (ids[1:] > 0)
        good = np.zeros(len(keys), bool)
        at = np.searchsorted(self.pairs, keys[both])
        good[both] = self.pairs[np.minimum(at, len(self.pairs) - 1)] == keys[both]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        return [(int(a), int(b) + 1) for a, b in zip(edge[::2], edge[1::2], strict=True) if b + 1 - a >= self.shortest]

    def _stream(self, ids: list[int], base: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        after, link, lengths, ends, above = self.after, self.link, self.length, self.ends, self.above
        state = matched = 0
        for i, w in enumerate(ids):
            there = after(state, w)
            while there < 0 and state:
                state = link[state]
                matched = lengths[state]
                there = after(state, w)
            if there >= 0:
                state = there
                matched += 1
            v = state if state in ends else above[state]
            while v > 0:
                for size, found in ends[v]:
                    if size <= matched:
                        spans.append((base + i + 1 - size, base + i + 1))
                        items.update(found)
                v = above[v]


def shards(benchmark: DataFrame, shard_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items of benchmark (item_id, text), at most shard_words words at a time unless one item has more; one empty shard if there are none."""
    held: list[tuple[str | None, list[bytes]]] = []
    words = 0
    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    for row in named.toLocalIterator():
        own = words_of(row["text"])
        if held and words + len(own) > shard_words:
            yield held
            held, words = [], 0
        held.append((row["item_id"], own))
        words += len(own)
    yield held


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _last_pass(documents: DataFrame, benchmark: DataFrame, window: int, shard_words: int):
    """documents with the hits of all shards but the last in two more columns if there are several, and a function that finds all hits of a batch.

    The function gives for each row its words' number, the spans that are hit and the items that occur.
    """
    spark = documents.sparkSession
    prepare(spark)
    at = documents.columns.index("text")
    width = len(documents.columns)
    parts = shards(benchmark, shard_words)
    own = next(parts)
    key = [F.xxhash64("doc_id", "text").alias("_k"), F.xxhash64(F.lit(1), "text", "doc_id").alias("_g")]
    schema = "_k long, _g long, spans array<array<int>>, items array<string>"
    earlier: list[DataFrame] = []
    for following in parts:
        held = spark.sparkContext.broadcast(Automaton(own, window))

        def hits(batch: pa.RecordBatch, held=held) -> pa.RecordBatch | None:
            found = [(i, *held.value.hits(words_of(t.as_py()))) for i, t in enumerate(batch.column(2))]
            found = [(i, spans, items) for i, spans, items in found if spans]
            if not found:
                return None
            rows, spans, items = zip(*found, strict=True)
            spans = pa.array([[list(x) for x in s] for s in spans], pa.list_(pa.list_(pa.int32())))
            columns = [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), spans, pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            return pa.record_batch(columns, names=["_k", "_g", "spans", "items"])

        found = spread(documents.select(*key, "text")).mapInArrow(by_batch(hits), schema)
        earlier.append(written(found.groupBy("_k", "_g").agg(F.any_value("spans").alias("spans"), F.any_value("items").alias("items"))))  # copies have equal hits
        held.unpersist()
        own = following
    if earlier:
        whole = earlier[0]
        for part in earlier[1:]:
            whole = whole.unionByName(part)
        spans, items, k, g = (free_name(documents, x) for x in ("_spans", "_items", "_k", "_g"))
        # One row a shard and text.
        by_text = written(whole.groupBy(F.col("_k").alias(k), F.col("_g").alias(g)).agg(F.flatten(F.collect_list("spans")).alias(spans), F.flatten(F.collect_list("items")).alias(items)))
        documents = documents.withColumns({k: key[0], g: key[1]}).join(by_text, [k, g], "left").select(*[F.col(f"`{c}`") for c in documents.columns], spans, items)
    held = spark.sparkContext.broadcast(Automaton(own, window))

    def find(batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        before = zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True) if batch.num_columns > width else repeat((None, None))
        for text, (spans, items) in zip(batch.column(at), before, strict=False):
            words = words_of(text.as_py())
            found, occur = held.value.hits(words)
            if spans:
                found = merged([*found, *map(tuple, spans)])
            yield len(words), found, occur | set(items or ())

    return documents if earlier else spread(documents), find


def report(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, shard_words: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (share * n_hit >= n_words > 0 and a hit) per document."""
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source, find = _last_pass(source, benchmark, window, shard_words)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, (n, spans, items) in zip(batch.column(0).to_pylist(), find(batch), strict=True):
            hit = sum(b - a for a, b in spans)
            rows.append((doc_id, n, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0 and share * hit >= n))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return source.mapInArrow(by_batch(each), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without what lies between the first and the last character of each span of words."""
    lowered = [m.span() for m in _SPAN.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : lowered[a][0]])
        at = lowered[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, shard_words: int = 500_000) -> DataFrame:
    """documents without contaminated rows, and the rest without the spans of words inside windows; untouched texts stay as they are.

    Column n_chars, where there is one, follows the text.
    """
    schema, width = documents.schema, len(documents.columns)
    at = documents.columns.index("text")
    chars = documents.columns.index("n_chars") if "n_chars" in documents.columns else None
    source, find = _last_pass(documents, benchmark, window, shard_words)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = batch.column(at).to_pylist()
        stay, changed = [], False
        counts = batch.column(chars).to_pylist() if chars is not None else None
        for i, (n, spans, _) in enumerate(find(batch)):
            hit = sum(b - a for a, b in spans)
            stay.append(not (hit > 0 and share * hit >= n))
            if spans:
                texts[i], changed = cut_spans(texts[i], spans), True
                if counts is not None:
                    counts[i] = len(texts[i])
        columns = list(batch.columns[:width])
        if changed:
            columns[at] = pa.array(texts, columns[at].type)
            if counts is not None:
                columns[chars] = pa.array(counts, columns[chars].type)
        return pa.record_batch(columns, names=batch.schema.names[:width]).filter(pa.array(stay))

    return source.mapInArrow(by_batch(each), schema)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT *, least(13, len(w)) AS size FROM i WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda p: array_to_string(w[p : p + size - 1], ' '))) AS s FROM sized
), places AS (
  SELECT r, size, unnest(list_transform(range(1, len(w) - size + 2), lambda p: {'p': p, 's': array_to_string(w[p : p + size - 1], ' ')})) AS x
  FROM d JOIN (SELECT DISTINCT size FROM windows) ON len(w) >= size
), hits AS (
  SELECT r, x.p AS p, places.size, item_id FROM places JOIN windows ON places.size = windows.size AND x.s = windows.s
), words AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT r, p, size FROM hits)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS digest FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
