"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is the product of its letters' vectors, each permuted (rotated) by its
place; a document is the bundle (sum) of its n-grams' vectors, and a language's prototype the bundle of the normalised vectors
of training documents. A document gets the language whose prototype has the largest cosine with it; ties go to the smaller name.

Training reads a sample of at most about `sample_rows` rows, chosen by a hash of doc_id over the whole table; executors bundle
it to integers (so the sums do not depend on their order) and send one row per language and component. Prediction reads every
text in full and needs the prototypes only.

Cases: a text that is null or has no letter is `und` with score 0; a null lang is never learned; a null doc_id is held out; with
nothing to learn from, every document is `und`; repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import by_batch, prepare, spread

DIMENSIONS, LETTERS, SEED = 1024, 64, 42
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Letter number of each code point: 0 for what is no letter, 1 to 26 for a to z, others dealt out by a hash; case is folded."""
    numbers = np.zeros(0x110000, np.int16)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = ord(x.lower()[0])
            numbers[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (LETTERS - 27)
    return numbers


@lru_cache(1)
def _vectors() -> tuple[np.ndarray, np.ndarray]:
    """Vectors of two bound letters in the first places of a trigram, by letter * LETTERS + letter, and of the letter in the last."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (LETTERS, DIMENSIONS))
    pairs = np.roll(letters, 2, axis=1)[:, None, :] * np.roll(letters, 1, axis=1)[None, :, :]
    return pairs.reshape(LETTERS * LETTERS, DIMENSIONS), letters


def _sequence(text: str | None) -> np.ndarray:
    return _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]


def has_letter(text: str | None) -> bool:
    return bool(_sequence(text).any())


def encode(text: str | None) -> np.ndarray | None:
    """The bundle of the text's trigrams of letters and gaps; None without a letter."""
    seq = _sequence(text)
    if not seq.any():
        return None
    seq = np.concatenate([[0], seq, [0]]).astype(np.int64)
    seq = seq[np.concatenate([[True], (seq[1:] > 0) | (seq[:-1] > 0)])]  # one gap for many
    grams, counts = np.unique(seq[:-2] * (LETTERS * LETTERS) + seq[1:-1] * LETTERS + seq[2:], return_counts=True)
    pairs, last = _vectors()
    out = np.zeros(DIMENSIONS, np.float32)
    for i in range(0, len(grams), 4096):
        g = grams[i : i + 4096]
        out += counts[i : i + 4096].astype(np.float32) @ (pairs[g // LETTERS] * last[g % LETTERS]).astype(np.float32)
    return out


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def train(documents: DataFrame, sample_rows: int = 20_000, scale: int = 1 << 20) -> tuple[list[str], np.ndarray]:
    """Languages in order of name and their unit prototypes, from documents (doc_id, text, lang)."""
    prepare(documents.sparkSession)
    known = documents.where("lang IS NOT NULL AND text IS NOT NULL")
    total = known.count()
    wanted = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(total, 1)) * (1 << 30)))

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if (v := encode(text.as_py())) is not None:
                    sums.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
                    sums[lang] += np.rint(v / np.linalg.norm(v) * scale).astype(np.int64)
        for lang, v in sums.items():
            yield pa.record_batch([pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(v)], names=["lang", "i", "v"])

    rows = spread(wanted.select("text", "lang")).mapInArrow(bundle, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    names = sorted({r["lang"] for r in rows})
    out = np.zeros((len(names), DIMENSIONS))
    for r in rows:
        out[names.index(r["lang"]), r["i"]] = r["v"]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return names, (out / np.where(norms > 0, norms, 1)).astype(np.float32)


def predict(documents: DataFrame, names: list[str], prototypes: np.ndarray, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of documents with the language and the cosine cut to 0..1; columns of those two names are replaced."""
    prepare(documents.sparkSession)
    kept = [f for f in documents.schema.fields if f.name not in (lang, score)]
    source = documents.select(*[F.col(f"`{f.name}`") for f in kept])
    at = source.columns.index("text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = [], []
        for text in batch.column(at):
            v = encode(text.as_py()) if names else None
            if v is None:
                langs.append(UNDETERMINED)
                scores.append(0.0)
            else:
                cosines = prototypes @ v / max(float(np.linalg.norm(v)), 1e-9)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
        return pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang, score])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return spread(source).mapInArrow(by_batch(each), StructType([*kept, StructField(lang, StringType()), StructField(score, DoubleType())]))


def identify(documents: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from the documents that are not held out."""
    source = documents.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    out = held_out(F.col("doc_id"))
    model = train(source.where(~out), sample_rows)
    return predict(source.select("doc_id", "text"), *model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def keep_identified(documents: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """The documents with a letter, whose lang is the language that their text has; those without a letter go.

    Where no language is known to learn from, or a bundle is all zeros, lang stays as it was.
    """
    prepare(documents.sparkSession)
    names, prototypes = train(documents.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))), sample_rows)
    schema, columns = documents.schema, documents.columns
    at, of = columns.index("text"), columns.index("lang")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        stay, langs = [], batch.column(of).to_pylist()
        for i, text in enumerate(batch.column(at)):
            v = encode(text.as_py())
            stay.append(v is not None)
            if names and v is not None and v.any():
                langs[i] = names[int(np.argmax(prototypes @ v))]
        own = list(batch.columns)
        own[of] = pa.array(langs, own[of].type)
        return pa.record_batch(own, names=batch.schema.names).filter(pa.array(stay, pa.bool_()))

    return spread(documents).mapInArrow(by_batch(each), schema)
