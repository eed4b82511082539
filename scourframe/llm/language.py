"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, learned online."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scourframe.llm import common

#: Buckets of hashed n-grams.
BUCKETS = 1 << 15
#: The sample that is learned from holds so many distinct texts of each language at most, those of the lowest hashes.
SAMPLE_PER_LANGUAGE = 1200
#: What a text is where no language can be told.
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of one to three characters of the whole lower-cased text: buckets and how often each occurs."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    counts = np.zeros(BUCKETS, np.int64)
    one, two, three = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
    shift = np.uint32(32 - 15)
    parts = [code * one]
    parts += [(code[:-1] * one + code[1:]) * two] if len(code) > 1 else []
    parts += [((code[:-2] * one + code[1:-1]) * two + code[2:]) * three] if len(code) > 2 else []
    for part in parts:
        counts += np.bincount((part ^ part >> np.uint32(13)) * one >> shift, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.int32)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    nonzero: float = field(default=0.0)

    def values(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return (x / max(np.sqrt((x * x).sum()), 1e-12)).astype(np.float32)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.values(at, counts) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(*gram_counts(text)).astype(float) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Examples(Sequence):
    """Texts to learn from: buckets, values and language of each. The values are computed whenever they are asked for, so that only counts are held,
    in the few bytes in which they came."""

    def __init__(self, model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray, int]]):
        self.model, self.rows = model, rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        at, n, label = self.rows[i]
        return at, self.model.values(at, n.astype(np.int32)), label


def learn_online(examples: Sequence[tuple[np.ndarray, np.ndarray, int]], n_languages: int, epochs: int = 3, alpha: float = 0.8, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, one rate a coordinate, with elastic-net penalties; the bias is not penalised."""
    z, n = np.zeros((BUCKETS + 1, n_languages)), np.zeros((BUCKETS + 1, n_languages))

    def weights(rows: np.ndarray) -> np.ndarray:
        own, spread = z[rows], np.sqrt(n[rows])
        limit = np.where(rows[:, None] == BUCKETS, 0.0, l1)
        return np.where(np.abs(own) <= limit, 0.0, -(own - np.sign(own) * limit) / ((beta + spread) / alpha + l2))

    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(examples)):
            at, x, label = examples[i]
            rows, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(rows)
            error = softmax(x @ w)
            error[label] -= 1
            slope = x[:, None] * error
            square = slope * slope
            z[rows] += slope - (np.sqrt(n[rows] + square) - np.sqrt(n[rows])) / alpha * w
            n[rows] += square
    final = weights(np.arange(BUCKETS + 1))
    return final[:-1].astype(np.float32), final[-1].astype(np.float32)


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which rows not learned from are likeliest."""
    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean()

    return min((float(t) for t in np.geomspace(0.05, 10, 60)), key=loss) if len(labels) else 1.0


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows of `docs` that have a text and a language.

    Document frequencies are counted over all of these rows: each task counts its own, and the buckets are summed up. Weights
    are learned on the driver from the `sample_per_language` distinct texts of each language whose hashes are lowest, so that a text
    that is repeated however often counts once and takes no place from others; a fifth of them only calibrates the temperature, in
    languages of which ten are drawn. Rows without text, letter or language are not learned from. Where nothing is left to learn
    from, the model calls every text undetermined.
    """
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        "text is not null and lang is not null and lang <> 'und' and text rlike '\\\\p{L}'").withColumn("own", F.xxhash64("text"))

    def count(batches):
        frequency, n, lowest = np.zeros(BUCKETS, np.int64), 0, {}
        for batch in batches:
            for text, lang, own in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                frequency[gram_counts(text.as_py())[0]] += 1
                held = lowest.setdefault(lang, set())
                held.add(own)
                if len(held) > 4 * sample_per_language:
                    lowest[lang] = set(sorted(held)[:sample_per_language])
            n += batch.num_rows
        at = np.flatnonzero(frequency)
        drawn = [(lang, own) for lang, held in lowest.items() for own in sorted(held)[:sample_per_language]]
        for bucket, lang, own, count in ((at, [None] * len(at), [None] * len(at), frequency[at]), ([-1], [None], [None], [n]), ([None] * len(drawn), *(zip(*drawn) if drawn else ((), ())), [1] * len(drawn))):
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(lang, pa.string()), pa.array(own, pa.int64()), pa.array(count, pa.int64())], ["bucket", "lang", "own", "n"])

    counted = common.settled(known.mapInArrow(count, "bucket int, lang string, own long, n long"), "grams")
    sums = counted.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    low = Window.partitionBy("lang").orderBy("own")
    drawn = counted.filter("own is not null").select("lang", "own").distinct().withColumn("place", F.row_number().over(low)).filter(F.col("place") <= sample_per_language)
    limits = {row["lang"]: (row["own"], row["n"]) for row in drawn.groupBy("lang").agg(F.max("own").alias("own"), F.count("*").alias("n")).collect()}
    common.dropped(counted)
    frequency, total = np.zeros(BUCKETS), 0
    for bucket, n in zip(sums.column("bucket").to_pylist(), sums.column("n").to_pylist()):
        if bucket < 0:
            total = n
        else:
            frequency[bucket] = n
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float32)
    languages = sorted(limits)
    if not languages:
        return LanguageModel([], idf, np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))

    limit = F.create_map(*[F.lit(x) for lang in languages for x in (lang, limits[lang][0])])
    chosen = known.filter(F.col("own") <= limit[F.col("lang")]).dropDuplicates(["own", "lang"])

    def features(batches):
        for batch in batches:
            pairs = [gram_counts(text.as_py()) for text in batch.column(0)]
            at = [at.astype(np.uint16).tobytes() for at, _ in pairs]
            counts = [n.astype(np.min_scalar_type(n.max())).tobytes() for _, n in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["lang", "own", "at", "n"])

    rows = chosen.mapInArrow(features, "lang string, own long, at binary, n binary").toArrow()
    model = LanguageModel(languages, idf, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages), np.float32))
    learn, check = [], []
    told = sorted(zip(rows.column("own").to_pylist(), rows.column("lang").to_pylist(), rows.column("at"), rows.column("n")), key=lambda row: row[:2])
    for own, lang, at, n in told:  # views of what came, no copies
        at = np.frombuffer(at.as_buffer(), np.uint16)
        n = np.frombuffer(n.as_buffer(), f"u{n.as_buffer().size // len(at)}")
        (check if own % 5 == 0 and limits[lang][1] >= 10 else learn).append((at, n, languages.index(lang)))
    del told
    learn, check = Examples(model, learn), Examples(model, check)
    model.weights, model.bias = learn_online(learn, len(languages))
    held = [x @ model.weights[at] + model.bias for at, x, _ in check]
    model.temperature = best_temperature(np.array(held, float), np.array([label for *_, label in check.rows]))
    model.nonzero = float((model.weights != 0).mean())
    return model


def language_of(model: LanguageModel, text: Column | str = "text") -> Column:
    """Struct of `lang_pred` (`und` where the text is null or has no letter) and `score` (its probability; 0 for `und`).

    Texts of any length are read whole, equal texts are called alike, ties go to the language of the smaller name, no other column is read, and
    an empty table stays empty.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(text) for text in texts], columns=["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score` appended; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_language", language_of(model, text_col)).select(*kept, "_language.*")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract: the language of every whole text, learned from the rows that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(~common.held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
