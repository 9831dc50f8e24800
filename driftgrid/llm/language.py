"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, FTRL, temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import bounded, chunks, crc_mod
from driftgrid.llm.features import char_codes, char_points, ftrl, text_codes

ORDERS, BITS, SCALE = (1, 2, 3), 16, 20.0
CHARS = 250_000             # texts are taken together up to so many characters: some 100 bytes of arrays each
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray          # (2^BITS + 1, languages) float32: scale x idf x weight of a code, zero in the last row
    bias: np.ndarray
    temperature: float


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram occurs, over all texts; and their number."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros((1 << BITS) + 1, dtype=np.int64), 0
        for f in chunks(frames, "text", CHARS):
            points, starts, ends = char_points([t if isinstance(t, str) else "" for t in f["text"]])
            by_order = [char_codes(points, ends, k, BITS) for k in ORDERS]
            for a, b in zip(starts, ends, strict=True):
                seen = np.zeros((1 << BITS) + 1, dtype=bool)
                for codes in by_order:
                    seen[codes[a:b]] = True
                df += seen
            n += len(f)
        hit = np.flatnonzero(df[:-1])
        yield pd.DataFrame({"code": np.append(hit, -1), "n": np.append(df[hit], n)})

    out, n = np.zeros(1 << BITS, dtype=np.int64), 0
    for code, c in texts.mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n")).collect():   # 2^BITS rows at most
        if code < 0:
            n = c
        else:
            out[code] = c
    return out, n


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for lang, order, text in zip(f["lang"], f["pick"], f["text"], strict=True):
            codes, n = np.unique(text_codes(text, ORDERS, BITS), return_counts=True)
            out.append((lang, order, codes.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()))
        yield pd.DataFrame(out, columns=["lang", "pick", "codes", "n"])


def fit_language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fold: tuple[int, int] = (3, 1),
                 sample: int = 3000) -> LanguageModel:
    """Learn from rows whose crc32(key) modulo fold[0] is not fold[1], with text and language.

    Document frequencies count all of those rows. The regression is fitted on at most `sample` rows, chosen
    by a hash of the key with the same share of each language as far as it has rows; every fifth of them
    only calibrates the temperature.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        (crc_mod(F.col("key"), fold[0]) != fold[1]) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    df, n = document_frequency(rows.select("text"))
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(per)
    if not languages:
        return LanguageModel([], np.zeros(((1 << BITS) + 1, 0), dtype=np.float32), np.zeros(0), 1.0)
    share = F.coalesce(*[F.when(F.col("lang") == v, F.lit(min(1.0, sample / len(languages) / per[v]))) for v in languages])
    picked = rows.withColumn("pick", F.xxhash64(F.col("key").cast("string"), F.lit("lang"))).filter(
        F.pmod(F.col("pick"), F.lit(1 << 30)) < share * F.lit(1 << 30))
    got = bounded(picked.mapInPandas(_counts, "lang string, pick long, codes binary, n binary"), "pick", sample).collect()

    idf = np.log((1 + n) / (1 + df)) + 1
    learn, held = [], []
    for i, r in enumerate(got):
        codes, c = np.frombuffer(r["codes"], dtype=np.int32), np.frombuffer(r["n"], dtype=np.int32)
        values = SCALE * c / max(1, c.sum()) * idf[codes]
        (held if i % 5 == 4 else learn).append((codes.astype(np.int64), values, languages.index(r["lang"])))
    w, bias = ftrl(learn, len(languages), 1 << BITS, alpha=1.0, l1=0.01, l2=0.01)
    return LanguageModel(languages, np.vstack([SCALE * idf[:, None] * w, np.zeros((1, len(languages)))]).astype(np.float32), bias,
                         temperature([(v @ w[c] + bias, y) for c, v, y in held]))


def temperature(scored: list[tuple[np.ndarray, int]]) -> float:
    """The temperature with the least log loss on held rows, on a grid of 1/2 to 8; 1 without rows."""
    if not scored:
        return 1.0
    s, y = np.array([a for a, _ in scored]), np.array([b for _, b in scored])

    def loss(t: float) -> float:
        u = s / t - (s / t).max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(u).sum(axis=1)) - u[np.arange(len(y)), y]))
    return min((float(t) for t in np.geomspace(0.5, 8, 49)), key=loss)


def predict_language(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", fold: tuple[int, int] = (3, 1), carry: bool = False) -> DataFrame:
    """key, held_out, lang_pred, score (calibrated probability) for every row; with carry also `row`, the input row.

    Whole texts are read. A null text, one without a letter, or a model without languages gives 'und' with
    score 0. held_out is false for a null key. Rows are independent: repeats and ties give repeats.
    """
    k = len(model.languages)

    def score(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in frames:
            part = [pd.DataFrame({"lang_pred": pd.Series(dtype=object), "score": pd.Series(dtype=float)})]
            for f in chunks(iter([pd.DataFrame({"text": texts})]), "text", CHARS):
                raw = [t if isinstance(t, str) else "" for t in f["text"]]
                known = np.array([k > 0 and any(map(str.isalpha, t)) for t in raw], dtype=bool)
                pred, best = np.full(len(raw), UNKNOWN, dtype=object), np.zeros(len(raw))
                if known.any():
                    points, starts, ends = char_points([t for t, ok in zip(raw, known, strict=True) if ok])
                    total, grams = np.zeros((len(starts), k)), np.zeros(len(starts))
                    for order in ORDERS:
                        codes = char_codes(points, ends, order, BITS)
                        total += np.add.reduceat(model.table[codes], starts, axis=0, dtype=np.float64)
                        grams += np.maximum(ends - starts - order + 1, 0)
                    s = (total / grams[:, None] + model.bias) / model.temperature
                    p = np.exp(s - s.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    pred[known], best[known] = np.array(model.languages, dtype=object)[p.argmax(axis=1)], p.max(axis=1)
                part.append(pd.DataFrame({"lang_pred": pred, "score": best}))
            yield pd.concat(part[1:] or part, ignore_index=True)

    udf = F.pandas_udf(score, "lang_pred string, score double")
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *([F.struct("*").alias("row")] if carry else []))
    out = out.withColumn("said", udf("text"))
    return out.select(F.col("key").alias(key), F.coalesce(crc_mod(F.col("key"), fold[0]) == fold[1], F.lit(False)).alias("held_out"),
                      "said.lang_pred", "said.score", *(["row"] if carry else []))


def in_known_language(docs: DataFrame, least: float = 0.5, **columns: str) -> DataFrame:
    """The rows of docs whose language is told with at least `least`; the model is learned from docs itself."""
    model = fit_language(docs, **columns)
    keys = {k: v for k, v in columns.items() if k in ("key", "text")}
    kept = predict_language(docs, model, carry=True, **keys)
    return kept.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
