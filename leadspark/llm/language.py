"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import lean, mix, small_batches, steps

#: Documents of a language that its model is fitted on at most, the ones with the smallest hash of doc_id and text, and the places of that hash.
TRAIN_DOCS, PLACES = 1000, 1 << 62
#: Characters of these documents that are counted at most for a language.
TRAIN_CHARS = 1_000_000
ORDER = 4
DISCOUNT = 0.75
#: A text is rejected when its cross-entropy is above the training documents' by so many deviations, widened for short texts.
REJECT_DEVIATIONS = 10.0
_U = np.uint64
_SPACE, _OTHER = 0x20, 0x01


def _lookup() -> np.ndarray:
    """Code point -> symbol: letters fold to lower case, runs of all else count as a space."""
    table = np.full(0x3000, _SPACE, dtype=np.uint32)
    for c in range(0x3000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE = _lookup()


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all rows, symbols before each row): each row starts with a space, and spaces do not repeat."""
    lead = (data & 0xC0) != 0x80
    at = np.cumsum(lead)
    first = np.concatenate([[0], at])[offs]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    if len(points) != (at[-1] if len(at) else 0):  # invalid bytes; does not occur in Spark strings
        points = np.resize(points, at[-1] if len(at) else 0)
    sym = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], points)
    sym = np.insert(sym, first[:-1], _SPACE)
    first = first + np.arange(len(first))
    keep = np.ones(len(sym), dtype=bool)
    keep[1:] = ~((sym[1:] == _SPACE) & (sym[:-1] == _SPACE))
    keep[first[:-1]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return sym[keep], before[first]


def gram_hashes(sym: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols that end at each place; a place without n symbols before it reads what precedes."""
    h = np.zeros(len(sym), dtype=_U)
    with np.errstate(over="ignore"):
        for back in range(n - 1, -1, -1):
            h *= _U(0x100000001B3)
            h[back:] += sym[: len(sym) - back] + _U(1)
    return mix(h ^ _U(n << 56))


class KneserNey:
    """An interpolated model: log probabilities in arrays that are sorted by n-gram hash, one for each order."""

    def __init__(self, sym: np.ndarray, starts: np.ndarray):
        inside = np.ones(len(sym), dtype=bool)
        inside[starts[starts < len(sym)]] = False  # the leading space of a text is context only
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []  # hashes, log probabilities
        self.weights: list[tuple[np.ndarray, np.ndarray]] = []  # context hashes, log back-off weights
        depth = np.arange(len(sym)) - np.repeat(starts, np.diff(np.append(starts, len(sym))))
        grams = {n: gram_hashes(sym, n) for n in range(1, ORDER + 1)}
        context = {n: np.concatenate([np.zeros(1, _U), grams[n - 1][:-1]]) if n > 1 else np.zeros(len(sym), _U) for n in range(1, ORDER + 1)}
        for n in range(1, ORDER + 1):
            ok = inside & (depth >= n - 1)
            if n == ORDER:
                g, at, c = np.unique(grams[n][ok], return_index=True, return_counts=True)
            else:  # lower orders count the different symbols seen before the n-gram
                ok &= depth >= n
                _, one = np.unique(grams[n + 1][ok], return_index=True)
                g, at, c = np.unique(grams[n][ok][one], return_index=True, return_counts=True)
                at = one[at]
            ctx = context[n][ok][at]
            u, inv = np.unique(ctx, return_inverse=True)
            total = np.bincount(inv, weights=c, minlength=len(u))
            kinds = np.bincount(inv, minlength=len(u))
            weight = DISCOUNT * kinds / np.maximum(total, 1)
            if n == 1:
                unseen = 1.0 / (len(g) + 100)
                base = np.full(len(g), unseen)
                self.floor = float(np.log((weight[0] if len(weight) else 1.0) * unseen))
            else:
                base = np.exp(self._lower(n - 1, grams[n - 1][ok][at]))
            p = np.maximum(c - DISCOUNT, 0) / total[inv] + weight[inv] * base
            self.tables.append((g, np.log(p)))
            self.weights.append((u, np.log(weight)))

    def _lower(self, n: int, g: np.ndarray) -> np.ndarray:
        found, where = self._find(self.tables[n - 1][0], g)
        return np.where(found, self.tables[n - 1][1][where], self.floor) if len(self.tables[n - 1][1]) else np.full(len(g), self.floor)

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, at

    def log_probability(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Of each place, from its n-gram and context hashes of orders 1 to ORDER; unseen n-grams back off."""
        out = np.full(len(grams[0]), self.floor)
        for n in range(1, ORDER + 1):
            found, at = self._find(self.tables[n - 1][0], grams[n - 1])
            if n > 1:
                known, w = self._find(self.weights[n - 1][0], contexts[n - 1])
                if len(self.weights[n - 1][1]):
                    out = np.where(known, out + self.weights[n - 1][1][w], out)
            if len(self.tables[n - 1][1]):
                out = np.where(found, self.tables[n - 1][1][at], out)
        return out


class Identifier:
    """One model a language, and what cross-entropy its own documents have."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        self.models, self.usual = [], []
        for lang in self.langs:
            fit, check = [t for i, t in enumerate(texts[lang]) if i % 5 or len(texts[lang]) < 10], texts[lang][::5]
            parts = [symbols(d, o) for _, _, d, o in steps(pa.array(fit))]
            sym = np.concatenate([p[0] for p in parts])
            base = np.cumsum([0, *(len(p[0]) for p in parts)])
            starts = np.concatenate([p[1][:-1] + b for p, b in zip(parts, base, strict=False)])
            self.models.append(KneserNey(sym, starts))
            self.usual.append((check, lang))
        calibrated = []
        for k, (check, _) in enumerate(self.usual):
            h, n = self.entropies(pa.array(check))
            own = h[:, k][n >= 200] if (n >= 200).sum() >= 5 else h[:, k][n > 0]
            calibrated.append((float(own.mean()), float(own.std())) if len(own) else (3.0, 1.0))
        self.usual = calibrated

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy a symbol in nats for each row and language, scored symbols of each row)."""
        out, sizes = [np.zeros((0, len(self.langs)))], [np.zeros(0, dtype=np.int64)]
        for _, _, data, offs in steps(column):
            sym, at = symbols(data, offs)
            top = gram_hashes(sym, ORDER)
            depth = np.arange(len(sym)) - np.repeat(at[:-1], np.diff(at))
            for d in range(1, ORDER - 1):  # fewer symbols before these places in their rows
                rows = np.flatnonzero(depth == d)
                top[rows] = gram_hashes(sym, d + 1)[rows]
            codes, unique = pd.factorize(top)
            one = np.zeros(len(unique), dtype=np.int64)
            one[codes[::-1]] = np.arange(len(codes))[::-1]
            n = len(sym)
            grams, contexts = [], []
            for k in range(1, ORDER + 1):
                g = np.zeros(len(one), dtype=_U)
                c = np.zeros(len(one), dtype=_U)
                with np.errstate(over="ignore"):
                    for back in range(k - 1, -1, -1):
                        g = g * _U(0x100000001B3) + np.where(one >= back, sym[np.maximum(one - back, 0)] + _U(1), _U(0))
                    for back in range(k - 1, 0, -1):
                        c = c * _U(0x100000001B3) + np.where(one >= back, sym[np.maximum(one - back, 0)] + _U(1), _U(0))
                deep = depth[one] >= k - 1
                grams.append(np.where(deep, mix(g ^ _U(k << 56)), _U(0)))
                contexts.append(np.where(deep, mix(c ^ _U((k - 1) << 56)), _U(0)) if k > 1 else np.zeros(len(one), _U))
            each = np.diff(at) - 1
            result = np.zeros((len(at) - 1, len(self.langs)))
            for k, model in enumerate(self.models):
                p = model.log_probability(grams, contexts)[codes] if n else np.zeros(0)
                p[at[:-1]] = 0.0
                total = np.concatenate([[0.0], np.cumsum(p)])
                result[:, k] = -(total[at[1:]] - total[at[:-1]]) / np.maximum(each, 1)
            out.append(result)
            sizes.append(each)
        return np.concatenate(out), np.concatenate(sizes)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each row."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        letters = has_letters(column)
        if not self.langs:
            return ["und"] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
        h, n = self.entropies(column)
        best = h.argmin(axis=1)
        rows = np.arange(len(best))
        # a posterior over languages, from at most 50 symbols' worth of evidence, so that it does not saturate
        weight = np.minimum(n, 50)[:, None]
        score = 1.0 / np.exp(-(h - h[rows, best][:, None]) * weight).sum(axis=1) if len(best) else np.zeros(0)
        mean, spread = (np.array([u[k] for u in self.usual])[best] for k in (0, 1))
        limit = mean + REJECT_DEVIATIONS * np.maximum(spread, 0.05) * (1 + 2 * np.sqrt(100 / np.maximum(n, 1)))
        lang = [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return lang, np.where(letters, score, 0.0), ~letters | (h[rows, best] > limit)


_ASCII_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def has_letters(column: pa.Array) -> np.ndarray:
    out = []
    for _, _, data, offs in steps(column):
        n = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])[offs]
        some = np.diff(n) > 0
        for r in np.flatnonzero(~some & (np.diff(offs) > 0)):
            some[r] = any(map(str.isalpha, data[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "replace")))
        out.append(some)
    return np.concatenate(out) if out else np.zeros(0, bool)


def fit(docs: DataFrame, train: str = "true") -> Identifier:
    """Fit on rows of docs(doc_id, text, lang) that meet the SQL condition `train` and have a text and a lang.

    Of each language, at most about TRAIN_DOCS documents and TRAIN_CHARS characters are
    used: rows below a threshold of a hash of doc_id and text, which one count of rows a language sets.
    Equal rows count once.
    """
    rows = docs.where(train).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(PLACES))
    some = F.lit(False)
    for lang, n in counts.items():
        some = some | ((F.col("lang") == lang) & (place < int(PLACES * min(1.0, TRAIN_DOCS / n))))
    texts: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for r in rows.where(some).select("lang", "text", place.alias("place")).distinct().orderBy("lang", "place", "text").toLocalIterator():
        if size.get(r["lang"], 0) < TRAIN_CHARS:
            size[r["lang"]] = size.get(r["lang"], 0) + len(r["text"])
            texts.setdefault(r["lang"], []).append(r["text"])
    return Identifier({lang: own for lang, own in texts.items() if any(map(len, own))})


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """docs(doc_id, text) with lang_pred, score and rejected, for every whole text.

    lang_pred is the language of least cross-entropy a character; `und` if the text is null
    or has no letter, or if no language was learned.  score is the share of the language in a
    posterior, 0 for und.  rejected marks und and texts whose cross-entropy is far above that of
    the language's own documents.  Rows keep their number, null and repeated ids too; of docs'
    columns only doc_id returns.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = shared.value.predict(b.column("text"))
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double, rejected boolean")


def without_rejected(docs: DataFrame, model: Identifier) -> DataFrame:
    """The rows of docs, with all their columns, whose language the model does not reject."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~shared.value.predict(b.column("text"))[2]))

    return docs.mapInArrow(lean(run), docs.schema)
