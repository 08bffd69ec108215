"""Repeated passages across documents with a sparse suffix array.

Suffixes are kept at content-selected positions only: the minimisers of word k-grams, so that equal passages keep the same
positions. Positions whose k-gram occurs in one text only (a minimum and maximum of text hashes per k-gram, pre-aggregated)
have no neighbour and go. The others carry their suffix and, reversed, what stands before it, both as word hashes and as long as
the shortest passage sought; a range partitioning by (k-gram, suffix, left context) sorts them across tasks, so that a passage
that a third of all documents share is spread over many. Each row is compared with the nearest row of another text on either
side, the match is extended to the right and to the left, and where it has `least` words at least, its words are a repeated
passage. Rows of one text in a row wait for the next text, rows with equal contexts as one; the runs at the edges of a task are
compared with what lies next to them in other tasks. Longer passages are the union over their positions.

Rows that share a passage's right part, but not its left, can sort between its copies, so that no neighbour shows it. Any `least`
words have a kept position within their first `window` words (least >= k + window - 1), so such rows share least - window + 1
words to their right. Where neighbours share that much, but less to their left, or are of one text, both emit hashes of the
windows of `least` words around their position that the other does not have. In each set of rows with an equal window that does
not lie in one piece, each piece has such a border, where it also names a text of the piece that the row itself has met, so the
windows whose hash comes from two texts (a minimum and maximum of text hashes, pre-aggregated) are what the neighbours do not show. Stretches of one text, or of two rows, need none.

So every window of `least` words that occurs in two texts is found, and whatever is reported occurs in another text (up to hashes:
64 bits for the k-gram and for windows, 32 for each word around a position).

Texts that equal another document's are repeated whole. Equal texts count as one text in the array, so copies are no pairs.

Cases: null and empty texts and those of fewer words than `least` have no passages; a null doc_id takes no part; a passage that
repeats only within one document is no repeat across documents; repeated rows of one doc_id are one document; an empty table
gives an empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import prepare, spread, written

LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
HEAD, TAIL, FIRST, AFTER, LAST, BEFORE, OPEN = range(1, 8)


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").translate(LOWERED).split() if text else []
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on."""
    n = len(words) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for i in range(k):
            out = out * _MIX + words[i : i + n]
        out ^= out >> np.uint64(32)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out


def _over(values: np.ndarray, width: int, function) -> np.ndarray:
    """function over each `width` neighbouring values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = function(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the smallest of some `window` neighbouring ones."""
    if len(grams) <= window:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.zeros(0, np.int64)
    least = _over(grams, window, np.minimum)
    around = np.concatenate([np.full(window - 1, least[0]), least, np.full(window - 1, least[-1])])
    around[: window - 1] = 0
    around[len(around) - window + 1 :] = 0
    return np.flatnonzero(_over(around, window, np.maximum) == grams)


def common_prefix(a: bytes, b: bytes) -> int:
    """Words (4 bytes each) that two contexts share from their start on."""
    n = min(len(a), len(b)) // 4
    if a[: 4 * n] == b[: 4 * n]:
        return n
    x, y = np.frombuffer(a, np.uint32, n), np.frombuffer(b, np.uint32, n)
    return int(np.argmin(x == y))


def repeats(documents: DataFrame, least: int = 50, k: int = 8, window: int = 16) -> DataFrame:
    """doc_id, start_word, end_word (exclusive) and n_words (of the document) of each passage that repeats in another document."""
    spark = documents.sparkSession
    prepare(spark)
    source = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))

    def anchors(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text, mark in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = word_hashes(text.as_py())
                out[0].append(np.array([0], np.int64))
                out[1].append(np.array([mark], np.int64))
                out[2].append(np.array([-1 - len(words)], np.int32))  # the row of the document itself
                out[3].append(np.array([doc_id], np.int64))
                if len(words) >= least:
                    grams = gram_hashes(words, k)
                    at = minimisers(grams, window)
                    out[0].append(grams[at].view(np.int64))
                    out[1].append(np.full(len(at), mark, np.int64))
                    out[2].append(at.astype(np.int32))
                    out[3].append(np.full(len(at), doc_id, np.int64))
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=["gram", "mark", "at", "doc_id"])

    rows = written(spread(source).mapInArrow(anchors, "gram long, mark long, at int, doc_id long"))
    texts = rows.where("at < 0").select("doc_id", "mark", (-1 - F.col("at")).alias("n_words"))
    kept = rows.where("at >= 0").select("gram", "mark", "at")
    # Written, so that the join below has a shuffle of its own on both sides and adaptive execution can split a hot k-gram.
    shared = written(kept.groupBy("gram").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a < b").select("gram"))
    places = kept.join(shared, "gram").groupBy("mark").agg(F.collect_set("at").alias("places"))
    first = texts.groupBy("mark").agg(F.min("doc_id").alias("doc_id"))  # one document stands for each text
    chosen = written(first.join(places, "mark").select("doc_id", F.col("mark").alias("m"), "places"))
    from_texts = source.join(chosen, (source["doc_id"] == chosen["doc_id"]) & (source["mark"] == chosen["m"])).select(source["mark"], source["text"], "places")

    def suffixes(batches):
        for batch in batches:
            for mark, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = word_hashes(text.as_py())
                grams = gram_hashes(words, k)
                short = (words >> np.uint64(32)).astype(">u4")
                data, back = short.tobytes(), short[::-1].tobytes()
                at = sorted(places.as_py())
                right = [data[4 * p : 4 * (p + least)] for p in at]
                left = [back[4 * (len(words) - p) : 4 * (len(words) - p + least)] for p in at]
                for i in range(0, len(at), 4096):
                    j = slice(i, i + 4096)
                    yield pa.record_batch(
                        [pa.array(grams[at[j]].view(np.int64)), pa.array([mark] * len(at[j]), pa.int64()), pa.array(at[j], pa.int32()), pa.array(right[j], pa.binary()), pa.array(left[j], pa.binary())],
                        names=["gram", "mark", "at", "right", "left"],
                    )

    order = ["gram", "right", "left", "mark", "at"]
    unsorted = written(from_texts.mapInArrow(suffixes, "gram long, mark long, at int, right binary, left binary"))  # read twice: by the range sampling too
    array = unsorted.repartitionByRange(*order).sortWithinPartitions(*order)

    schema = "side int, mark long, start int, end int, gram long, right binary, left binary, places array<int>, windows array<long>"
    names = ["side", "mark", "start", "end", "gram", "right", "left", "places", "windows"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    reached = max(k, least - window + 1)  # words to the right of the first kept position of any `least` words

    def batches_of(rows):
        for i in range(0, len(rows), 10_000):
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 10_000], strict=True), kinds, strict=True)], names=names)

    def reach(a, b):
        """Words shared before and from the place of two rows on, if that is a match."""
        y = common_prefix(a[3], b[3])
        if a[0] != b[0] or y < k:
            return None
        x = common_prefix(a[4], b[4])
        return (x, y) if x + y >= least else None

    def neighbours(batches):
        """Spans (side 0), the first and last run of the task (HEAD, TAIL) and their ends with the rows of another text next to them (FIRST, AFTER, LAST, BEFORE), windows (OPEN)."""
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        # Rows of the current text in the current gram: one row for each context, all its places, how few words before it make a
        # window to emit, and the rows of other texts met (text, words before, words behind).
        run: list[list] = []
        other = shared = None  # the last row of another text before the run, and what the run's last context shares with it
        head = True  # the run is the first of the task
        group: list[list] = []  # the latest rows whose neighbours share `reached` words
        rows, changes = 3, 2  # rows, and runs of rows of one text, in that group; what touches an end of the task counts as enough

        def span(row, at, found):
            return (0, row[1], at - found[0], at + found[1], None, None, None, None, None)

        def edge(side, row, whole=0, places=None):
            return (side, row[1], task, whole, row[0], row[3], row[4], places or [row[2]], None)

        def windows(row, places, fewest, met):
            """The hashes of the windows with `fewest` to window - 1 words before the place, as far as the row has them; those that another text met has too are its own as well."""
            fewest = max(fewest, least - len(row[3]) // 4)
            xs = range(fewest, min(window - 1, len(row[4]) // 4) + 1)
            if xs:
                found = [xxhash.xxh64_intdigest(row[4][: 4 * x] + row[3][: 4 * (least - x)], x) for x in xs]
                found = np.array(found, np.uint64).view(np.int64).tolist()
                yield (OPEN, row[1], fewest, None, None, None, None, places, found)
                for mark, before, behind in met:
                    theirs = [w for x, w in zip(xs, found, strict=True) if x <= before and least - x <= behind]
                    if theirs:
                        yield (OPEN, mark, fewest, None, None, None, None, [], theirs)

        def flush():
            if rows >= 3 and changes >= 2:
                for own in group:
                    yield from windows(*own)
                group.clear()

        def follow(own):
            """Take the next row with other contexts into the group; what leaves the group. Rows of the current text wait for the next text."""
            nonlocal rows, changes
            before = group[-1] if group else None
            shared = common_prefix(before[0][3], own[0][3]) if before and before[0][0] == own[0][0] else 0
            if before and shared >= reached:
                same = before[0][1] == own[0][1]
                own[2] = max(1, least - shared, 0 if same else common_prefix(before[0][4], own[0][4]) + 1)
                before[2] = min(before[2], own[2])
                rows, changes = rows + 1, changes + (not same)
                if not same:
                    yield from flush()
            else:
                yield from flush()
                group.clear()
                if before:
                    rows, changes = 1, 1
                else:
                    own[2] = 1
            group.append(own)

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run and (run[-1][0][0] != row[0] or run[-1][0][1] != row[1]):
                    same = run[-1][0][0] == row[0]
                    if same:
                        for own, places, _, met in run:
                            found = reach(own, row)
                            if found:
                                out += [span(own, at, found) for at in places]
                                out.append(span(row, row[2], found))
                                met.append((row[1], *found))
                    if head:
                        out += [edge(HEAD, own, places=places) for own, places, *_ in run]
                        out += [edge(FIRST, run[0][0]), *([edge(AFTER, row)] if same else [])]
                        head = False
                    other, run = run[-1][0] if same else None, []
                if run and run[-1][0][3:] == row[3:]:
                    run[-1][1].append(row[2])
                else:
                    shared = reach(other, row) if other is not None else None
                    if shared:
                        out.append(span(other, other[2], shared))
                    run.append([row, [row[2]], window, [(other[1], *shared)] if shared else []])
                    out += follow(run[-1])
                if shared:
                    out.append(span(row, row[2], shared))
            yield from batches_of(out)
        if run:
            out = [edge(TAIL, own, places=places) for own, places, *_ in run]
            if head:
                out += [edge(HEAD, own, places=places) for own, places, *_ in run]
                out.append(edge(FIRST, run[0][0], 1))
            out += [edge(LAST, run[-1][0], int(head)), *([edge(BEFORE, other)] if other is not None else [])]
            group[-1][2] = 1
            for own in group:
                out += windows(*own)
            yield from batches_of(out)

    matches = written(array.mapInArrow(neighbours, schema))
    ends: dict[int, dict[int, tuple]] = {}
    whole: set[int] = set()  # tasks that are one run
    for r in matches.where(F.col("side").isin(FIRST, AFTER, LAST, BEFORE)).toLocalIterator():
        ends.setdefault(r["start"], {})[r["side"]] = (r["gram"], r["mark"], r["places"][0], bytes(r["right"]), bytes(r["left"]))
        if r["end"]:
            whole.add(r["start"])

    def beside(tasks, near, next_):
        """For each task the nearest row outside and the nearest of another text than that one."""
        out, held = {}, []
        for task in tasks:
            out[task] = held
            own = ends[task][near]
            further = [ends[task][next_]] if next_ in ends[task] else []
            held = [own, *(further or [r for r in held if task in whole and r[1] != own[1]][:1])]
        return out

    around = spark.sparkContext.broadcast((beside(sorted(ends), LAST, BEFORE), beside(sorted(ends, reverse=True), FIRST, AFTER)))

    def across(batches):
        before, after = around.value
        for batch in batches:
            out = []
            for side, mark, task, gram, right, left, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (gram, mark, places[0], right, left)
                mate = next((r for r in (before if side == HEAD else after)[task] if r[1] != mark), None)
                found = reach(mate, row) if mate else None
                if found:
                    x, y = found
                    out += [(mark, at - x, at + y) for at in places]
                    out.append((mate[1], mate[2] - x, mate[2] + y))
            if out:
                marks, a, b = zip(*out, strict=True)
                yield pa.record_batch([pa.array(marks, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["mark", "start", "end"])

    edges = matches.where(F.col("side").isin(HEAD, TAIL)).select("side", "mark", "start", "gram", "right", "left", "places").mapInArrow(across, "mark long, start int, end int")
    opened = matches.where(F.col("side") == OPEN).select("mark", "places", "start", F.posexplode("windows").alias("i", "w")).select("mark", "places", (F.col("start") + F.col("i")).alias("x"), "w")
    twice = written(opened.groupBy("w").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a < b").select("w"))
    hidden = opened.join(twice, "w").select("mark", F.explode("places").alias("at"), "x").select("mark", (F.col("at") - F.col("x")).alias("start"), (F.col("at") - F.col("x") + least).alias("end"))
    spans = matches.where("side = 0").select("mark", "start", "end").union(edges).union(hidden).groupBy("mark").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    merged = F.aggregate(
        "s",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    by_text = spans.select("mark", merged.alias("s"))
    copied = texts.groupBy("mark").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("mark", F.lit(True).alias("copied"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    each = texts.where(F.col("n_words") >= least).distinct().join(copied, "mark", "left").join(by_text, "mark", "left")
    return each.select("doc_id", "n_words", F.explode(F.when(F.col("copied"), whole).otherwise(F.col("s"))).alias("e")).select(
        "doc_id", F.col("e.start").cast("long").alias("start_word"), F.col("e.end").cast("long").alias("end_word"), F.col("n_words").cast("long").alias("n_words")
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\x0c\r]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), places AS (
  SELECT doc_id, len(w) AS n_words, unnest(list_transform(range(0, len(w) - 49), lambda p: {'p': p, 's': array_to_string(w[p + 1 : p + 50], ' ')})) AS x FROM d WHERE len(w) >= 50
), shared AS (
  SELECT x.s AS s FROM places GROUP BY x.s HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT doc_id, n_words, x.p AS p, x.p - lag(x.p) OVER (PARTITION BY doc_id ORDER BY x.p) AS gap FROM places JOIN shared ON x.s = shared.s
), passages AS (
  SELECT *, count(*) FILTER (WHERE gap IS NULL OR gap > 50) OVER (PARTITION BY doc_id ORDER BY p) AS passage FROM hits
)
SELECT doc_id, CAST(min(p) AS BIGINT) AS start_word, CAST(max(p) + 50 AS BIGINT) AS end_word, CAST(min(n_words) AS BIGINT) AS n_words FROM passages GROUP BY doc_id, passage
"""
