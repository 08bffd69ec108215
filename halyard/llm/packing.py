"""Best-fit packing planned over the histogram of piece lengths.

A pass over the documents tokenizes them and cuts long ones into pieces, each with its rank among the pieces of its length in
its task. The histogram has one count per length, so at most `capacity` rows reach the driver whatever the corpus. Best fit in
decreasing length runs over these counts: one step places all pieces of a length into all open sequences of one remaining
capacity, so the plan is a list of rank intervals, not of documents. Documents then take their slots by joining on length and
rank: rank = (pieces of the length in earlier tasks) + (rank in the task), both from the written pieces, so no length, however
common, meets in one task.

Cases: a null or empty text has no ids but the end id and is packed like any other; texts of any length or kind (a million blanks,
newlines or equal letters) are encoded whole; repeated rows, and rows of one doc_id, are packed once each; an empty table gives an empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import prepare, spread, written

#: Fixed value: the pattern by which byte-level BPE splits a text into pieces.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: In longer texts, runs of so many blanks are looked for before that library is tried.
LONG = 20_000
_BLANKS = re.compile(r"\s{%d}" % LONG)


class Encoder:
    """Ids of whole texts by a tokenizers file.

    A byte-level BPE without normalizer gives the same ids whether its merges are applied in the order of their ranks or, as here
    where it can be done, in the order of the ids of what they make: the library for that takes a fourth of the time. Its table
    is read from the tokenizer itself; any other tokenizer encodes by itself, and so does this one where that library fails on a
    text (its pattern runs out of stack on some hundred thousand blanks in a row).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.fast = self._by_rank(json.loads(self.tokenizer.to_str()))

    def _by_rank(self, spec: dict):
        splitter, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        try:
            import tiktoken
        except ImportError:
            return None
        special = {x["content"] for x in spec.get("added_tokens", ())}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [(m if isinstance(m, str) else "".join(m)).replace(" ", "") for m in model["merges"]]
        made = [model["vocab"][m] for m in merged]
        if made != sorted(set(made)):
            return None
        return tiktoken.Encoding("read", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for text in texts:
            if not text:
                yield np.zeros(0, np.uint32)
            else:
                ids = self._by_library(text) if self.fast is not None and not (len(text) > LONG and _BLANKS.search(text)) else None
                yield ids if ids is not None else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _by_library(self, text: str) -> np.ndarray | None:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except (KeyboardInterrupt, SystemExit, GeneratorExit):
            raise
        except BaseException:  # a panic of the library is no Exception
            return None


def cut_pieces(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of total ids; only the first may be shorter when it is cut."""
    if total <= capacity:
        return [(0, total)]
    head = total % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, total, capacity)]


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, the task and the rank in it, and the ids if they are kept."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank_in_task long" + ", ids array<int>" * keep_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank_in_task"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids

    def run(batches):
        from pyspark import TaskContext

        task, encoder, seen = TaskContext.get().partitionId(), _encoder(tokenizer_path), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut_pieces(len(ids), capacity)):
                    own = ids[start : start + length]
                    row = [doc_id, k, start, length, zlib.crc32(own.tobytes()), task, int(seen[length])] + [own.astype(np.int32)] * keep_ids
                    seen[length] += 1
                    for to, value in zip(rows, row, strict=True):
                        to.append(value)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=names)

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, schema)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One a worker process: reading the file takes a while."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit in decreasing length over counts.

    Rows (length, first, last, sequence, each, offset): pieces of the length with ranks first..last-1 go, `each` to a sequence,
    to the sequences from `sequence` on, the first of them in each at `offset`.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: ranges (first sequence, count)
    made = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            best = next((r for r in range(length, capacity) if room.get(r)), None)
            if best is None:
                each = capacity // length
                full = left // each
                count, put = (full, full * each) if full else (1, left)
                first, each, remains = made, each if full else left, capacity
                made += count
            else:
                first, count = room[best].pop()
                each = best // length
                if left < each:
                    each = left
                if count > 1 and count * each > left:
                    take = max(1, left // each)
                    room[best].append((first + take, count - take))
                    count = take
                put, remains = count * each, best
            rows.append((length, rank, rank + put, first, each, capacity - remains))
            rest = remains - each * length
            if rest:
                room.setdefault(rest, []).append((first, count))
            left, rank = left - put, rank + put
    return rows


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids unless keep_ids is off."""
    spark = documents.sparkSession
    prepare(spark)
    own = written(pieces(documents, tokenizer_path, capacity, end_id, keep_ids))
    by_task = written(own.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    planned = spark.createDataFrame(plan(counts, capacity), "length long, first long, last long, sequence long, each long, start_offset long")
    before = by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).alias("earlier"))
    # The task counts are at most capacity rows a task; a join splits no further than a (task, length) needs.
    ranked = own.join(before, ["task", "length"]).withColumn("rank", F.col("rank_in_task") + F.coalesce("earlier", F.lit(0)))
    # The plan's size is bounded by the capacity: each row uses up a range of sequences of one room and leaves one with less. There
    # are at most 3 new ranges a length, and a sequence holds at most sqrt(2 * capacity) different lengths, so at most
    # 3 * capacity * sqrt(2 * capacity) rows (393,216 for 2048) follow, some thousands in practice.
    slots = ranked.join(F.broadcast(planned), "length").where("rank >= first AND rank < last")
    place = F.col("rank") - F.col("first")
    return slots.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("start_offset") + (place % F.col("each")) * F.col("length")).cast("long").alias("offset"),
        *["ids"] * keep_ids,
    )
