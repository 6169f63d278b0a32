"""Toxicity scores of texts restored by a noisy-channel decoder.

A character trigram model is counted over all documents.  Spans that look
disguised -- letters spaced out, digits and signs for letters, letters repeated --
are read as the output of a noisy channel: every character offers the letters it
may stand for, or nothing, each at a cost, and a Viterbi search over this lattice
finds the most likely original under the trigram model.  A logistic model over
words and word beginnings of the text and of its restored spans gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import fresh, stage

#: Labelled rows of each class that fit the classifier, at most about.
TRAINING_ROWS = {1: 6000, 0: 12000}
#: Log ratio of shares from which a feature speaks for toxicity.
LEAST_RATIO = 2.0
#: Hash space of features.
SPACE = 1 << 22
#: Words and spans that a worker remembers.
MEMO = 200_000
#: Characters that are counted at a time.
COUNTED = 1 << 20

#: Letters that digits and signs stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Costs of the channel, in nats.
AS_LEET, DROPPED_SIGN, DROPPED_GAP, KEPT_GAP, DROPPED_REPEAT = 0.7, 6.0, 0.2, 4.0, 0.8

#: Symbols of the language model: 0 anything between words, 1 to 26 letters, 27 other letters.
SYMBOLS = 28
_TO_SYMBOL = bytes([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0 for b in range(256)])

_SIGNS = re.escape("".join(LEET))
_MARKS = frozenset(c for c in LEET if not c.isalnum())
_ALONE = r"(?<![^\W_])[^\W_](?![^\W_])"
#: Letters and digits that stand alone, any gaps between them; signs for letters alone.
_SPACED = re.compile(rf"{_ALONE}(?:[\W_]+{_ALONE})*")
_SPACED_SIGNS = re.compile(rf"[{re.escape(''.join(sorted(_MARKS)))}](?:[^\w{re.escape(''.join(sorted(_MARKS)))}]+[{re.escape(''.join(sorted(_MARKS)))}])+")
#: Letters and signs of a spaced-out word, at least.
SPACED = 3
_LEETED = re.compile(rf"[^\W\d_][{_SIGNS}]+[^\W\d_]|[{_SIGNS}][^\W\d_]|[^\W\d_][@$|(0-9]")
_REPEATED = re.compile(r"([^\W\d_])\1")
_REPEATED_SIGN = re.compile(rf"([{_SIGNS}])\1")
_EDGE = "\"'.,;:!?()[]{}<>-_*#%&/\\~`^=+|$@"


def _gap(c: str) -> bool:
    return not c.isalnum() and c not in _MARKS


def spaced_spans(text: str) -> Iterator[str]:
    """Stretches in which letters, digits and signs for letters stand alone, SPACED of them at least."""
    for m in _SPACED.finditer(text):
        start, end = m.span()
        first = last = 0
        while start and _gap(text[start - 1]):  # signs that lead
            k = start - 1
            while k and _gap(text[k - 1]):
                k -= 1
            if not k or text[k - 1] not in _MARKS or k > 1 and text[k - 2].isalnum():
                break
            start, first = k - 1, first + 1
        while end < len(text) and _gap(text[end]):  # signs that follow
            k = end + 1
            while k < len(text) and _gap(text[k]):
                k += 1
            if k == len(text) or text[k] not in _MARKS or k + 1 < len(text) and text[k + 1].isalnum():
                break
            end, last = k + 1, last + 1
        core = m.group()
        inner = sum(c.isalnum() or c in _MARKS for c in core)
        if inner >= SPACED:
            yield core
        if first + last and first + inner + last >= SPACED:
            yield text[start:end]
    for m in _SPACED_SIGNS.finditer(text):
        if sum(c in _MARKS for c in m.group()) >= SPACED:
            yield m.group()


class Decoder:
    """Viterbi search for the original of a disguised span."""

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        pair, one = cube.sum(2), cube.sum((0, 2))
        low = (one + 1.0) / (one.sum() + SYMBOLS)
        mid = (cube.sum(0) + 20 * low[None, :]) / (cube.sum(0).sum(1, keepdims=True) + 20)
        self.cost = (-np.log((cube + 5 * mid[None, :, :]) / (pair[:, :, None] + 5))).tolist()

    def options(self, c: str, before: str, spaced: bool, beside: bool = False, pairs: bool = False) -> list[tuple[str, int, float]]:
        """(written, symbol or -1 for nothing, channel cost) for one character.

        ``before`` is the one it follows; a sign ``beside`` a letter may be a gap between spaced ones.
        With ``pairs`` a repeated sign stands for a letter of its own each time.
        """
        low = c.lower()
        if len(low) != 1:
            return [(c, 27, 0.0)]
        if "a" <= low <= "z":
            out = [(low, ord(low) - 96, 0.0)]
        elif low.isalpha():
            out = [(low, 27, 0.0)]
        elif low in LEET:
            out = [(x, ord(x) - 96, AS_LEET) for x in LEET[low]] + [("", -1, DROPPED_GAP if spaced and beside and low in _MARKS else DROPPED_SIGN)]
        elif spaced:
            return [("", -1, DROPPED_GAP), (" ", 0, KEPT_GAP)]
        else:
            return [("", -1, DROPPED_SIGN), (c, 0, 0.0)]
        if low == before and not (pairs and low in LEET):
            out.append(("", -1, DROPPED_REPEAT))
        return out

    def decode(self, span: str, spaced: bool = False, pairs: bool = False) -> str:
        """The cheapest original; ties go to the first in option order."""
        cost = self.cost
        # State: the last two symbols. Back pointers are (previous entry, written) so that memory grows with the span alone.
        beam: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        before = ""
        for k, c in enumerate(span):
            made: dict[tuple[int, int], tuple[float, tuple]] = {}
            beside = spaced and (span[k - 1 : k].isalnum() or span[k + 1 : k + 2].isalnum())
            for written, symbol, paid in self.options(c, before, spaced, beside, pairs):
                # The model counts the bytes of other letters.
                again = len(c.encode("utf-8", "replace")) - 1 if symbol == 27 else 0
                for (a, b), (total, path) in beam.items():
                    if symbol < 0:
                        key, sum_, step = (a, b), total + paid, path
                    elif again:
                        sum_ = total + paid + cost[a][b][27] + cost[b][27][27] + (again - 1) * cost[27][27][27]
                        key, step = (27, 27), (path, written)
                    else:
                        key, sum_, step = (b, symbol), total + paid + cost[a][b][symbol], (path, written)
                    if key not in made or sum_ < made[key][0]:
                        made[key] = sum_, step
            beam, before = made, c.lower()
        _, path = min(((total + cost[a][b][0], path) for (a, b), (total, path) in beam.items()), key=lambda x: x[0])
        out = []
        while path:
            path, written = path
            out.append(written)
        return "".join(reversed(out))


class Reader:
    """Words of a text and of what its disguised spans decode to."""

    def __init__(self, decoder: Decoder):
        self.decoder = decoder
        self.words: dict[str, tuple[str, ...]] = {}
        self.spans: dict[str, str] = {}

    def forms(self, token: str) -> tuple[str, ...]:
        """A token without its edge signs, and its restored form if it looks disguised; what was decoded is remembered."""
        known = self.words.get(token)
        if known is None:
            word = token.strip(_EDGE)
            known = (word,) if word else ()
            core = token.strip("\"'.,;:?[]{}<>-_*#%&/\\~`^=")
            if _LEETED.search(core) or _REPEATED.search(core):
                if len(self.words) >= MEMO // 2:
                    self.words.clear()
                read = [self.decoder.decode(core)]
                if _REPEATED_SIGN.search(core):
                    read.append(self.decoder.decode(core, pairs=True))
                known += tuple(dict.fromkeys(w for r in read for w in r.split() if w != word))
                self.words[token] = known
        return known

    def restored(self, text: str) -> list[str]:
        """Decoded spans of letters that were spaced out."""
        out = []
        for span in spaced_spans(unicodedata.normalize("NFC", text)):
            found = self.spans.get(span)
            if found is None:
                if len(self.spans) >= MEMO // 8:
                    self.spans.clear()
                found = self.spans[span] = self.decoder.decode(span, spaced=True)
            out.extend(found.split())
        return out


def word_features(word: str) -> set[int]:
    """Hashes of a word and of its beginnings."""
    data = ["=" + word, *("^" + word[:k] for k in (3, 4, 5, 6) if len(word) >= k)]
    return {crc32(x.encode("utf-8", "replace")) % SPACE for x in data}


@dataclass
class Model:
    """What scoring needs; its size is bounded by the symbols and by the words of the rows that fit it."""

    counts: np.ndarray
    weights: dict[int, float]
    bias: float


class Scorer:
    """Scores of texts; a worker's memory of words is bounded."""

    def __init__(self, model: Model):
        self.model, self.reader = model, Reader(Decoder(model.counts))
        self.active: dict[str, tuple[int, ...]] = {}

    def _active(self, token: str) -> tuple[int, ...]:
        if len(self.active) >= MEMO:
            self.active.clear()
        weights = self.model.weights
        found = {f for w in self.reader.forms(token) for f in word_features(w) if f in weights}
        out = self.active[token] = tuple(found)
        return out

    def score(self, text: str | None) -> float:
        low = (text or "").lower()
        tokens = set(low.split())
        tokens.update(self.reader.restored(low))
        known, feats = self.active.get, set()
        for t in tokens:
            f = known(t)
            if f is None:
                f = self._active(t)
            if f:
                feats.update(f)
        z = self.model.bias + sum(map(self.model.weights.__getitem__, sorted(feats)))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def character_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Trigram counts of symbols over all texts; the table has SYMBOLS ** 3 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)

        def add(texts: list[str]) -> None:
            s = np.frombuffer("  ".join(texts).encode("utf-8", "replace").translate(_TO_SYMBOL), np.uint8).astype(np.int16)
            if len(s) > 2:
                total[:] += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)

        for batch in batches:
            held: list[str] = []
            size = 0
            for t in batch.column(0):
                t = t.as_py()
                if not t:
                    continue
                held.append(t)
                size += len(t)
                if size >= COUNTED:
                    add(held)
                    held, size = [], 0
            add(held)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in rows:
        counts[r["at"]] = r["n"]
    return counts


def _lists(values: list[np.ndarray]) -> pa.Array:
    """A list array of numpy arrays without a Python object for each number."""
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, np.int32), pa.int32()))


def train(docs: DataFrame, labelled: DataFrame, counts: np.ndarray, text: str = "text", key: str = "doc_id") -> Model:
    """Fit the classifier on ``labelled`` (key, toxic); rows with null labels are left out.

    A key that is labelled more than once is toxic if any of its rows says so.
    Of each class about TRAINING_ROWS rows are drawn by a hash of the key, so that
    what is fitted has a bound whatever the corpus; without both classes every score
    is the share of toxic labels.
    """
    labelled = labelled.select(F.col(key).alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    many = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    if len(many) < 2:
        rate = (many.get(1, 0) + 0.01) / (sum(many.values()) + 1)
        return Model(counts, {}, math.log(rate / (1 - rate)))
    part = F.lit(0.0)
    for y, most in TRAINING_ROWS.items():
        part = F.when(F.col("y") == y, min(1.0, most / many[y])).otherwise(part)
    drawn = labelled.where(F.pmod(F.xxhash64(F.lit(61), "id"), F.lit(1 << 20)) < part * (1 << 20))
    # At most about sum(TRAINING_ROWS) rows of two numbers.
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), "id").select("y", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Decoder(counts))
        for batch in batches:
            out = []
            for t in batch.column(1):
                low = (t.as_py() or "").lower()
                words = {w for token in {*low.split(), *reader.restored(low)} for w in reader.forms(token)}
                out.append(np.array(sorted({f for w in words for f in word_features(w)}), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(out)], ["y", "feats"])

    sample = stage(rows.mapInArrow(features, "y int, feats array<int>"), "toxicity-sample")
    seen = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = float(seen.get(1, 0)) or 1.0, float(seen.get(0, 0)) or 1.0
    stats = sample.select("y", F.explode("feats").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    # Features that toxic rows have several times as often as others; there are no more than the sample's words give.
    ratio = F.log(((F.col("a") + 0.5) / (n1 + 1)) / ((F.col("n") - F.col("a") + 0.5) / (n0 + 1)))
    chosen = stats.where((F.col("n") >= 3) & (F.col("a") >= 2) & (ratio > LEAST_RATIO)).select("f").collect()
    index = {r["f"]: k for k, r in enumerate(chosen)}
    ids = np.array(sorted(index), np.int32)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = np.asarray(batch.column(1).flatten()), np.asarray(pc.list_value_length(batch.column(1)))
            chosen = np.isin(flat, ids)
            ends = np.concatenate([[0], np.cumsum(chosen)])[np.concatenate([[0], np.cumsum(sizes)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[chosen], pa.int32()))], ["y", "feats"])

    table = sample.mapInArrow(keep, "y int, feats array<int>").toPandas()
    order = np.lexsort((table["feats"].map(lambda x: crc32(np.asarray(x, np.int32).tobytes())), table["y"]))
    feats = [table["feats"].iloc[k] for k in order]
    y = table["y"].to_numpy(float)[order]
    w, b = _fit(feats, y, index)
    return Model(counts, {f: float(w[k]) for f, k in index.items() if abs(w[k]) > 1e-4}, b)


def _fit(feats: list, y: np.ndarray, index: dict[int, int], rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression with weights of at least 0 and a ridge, by full-batch steps with momentum and scaled gradients.

    Weights below 0 would let long clean stretches outweigh an insult.  The classes' losses count 2 to 3.
    """
    row = np.repeat(np.arange(len(feats)), [len(x) for x in feats])
    col = np.array([index[f] for x in feats for f in x], np.int64)
    weight = np.where(y == 1, 0.4 / max(y.sum(), 1), 0.6 / max((1 - y).sum(), 1))
    w, b = np.zeros(len(index) + 1), 0.0
    m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[col], minlength=len(y)) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.append(np.bincount(col, e[row], minlength=len(index)), e.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], float(w[-1])


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``columns`` of each input row and its score from 0 to 1, higher for texts that are likelier toxic.

    Null and empty texts get the model's score of a text without features; long texts
    are read whole; repeated rows are scored each and alike.
    """
    shipped = docs.sparkSession.sparkContext.broadcast({"model": (model.counts, model.weights, model.bias)})
    asked = list(columns) if text in columns else [*columns, text]
    at = asked.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        if "scorer" not in held:
            held["scorer"] = Scorer(Model(*held["model"]))  # one for all tasks of a worker, so words are decoded once
        scorer = held["scorer"]
        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(scores, pa.float64())], [*columns, name])

    rows = docs.select(*[F.col(f"`{c}`") for c in asked])
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kinds}, `{name}` double")


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their columns alone."""
    model = train(docs, labels.where(~held_out(key)), character_counts(docs, text), text, key)
    (name,) = fresh(docs, "score")
    return score_toxicity(docs, model, text, tuple(docs.columns), name).where(F.col(name) < threshold).drop(name)


def held_out(key: str) -> Column:
    """Whether a row is kept out of the fit: CRC-32 of its key as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    The model is learned from labelled rows that are not held out.  Labels are joined
    to texts for the fit alone and are never inputs of a score.  A null key is held out.
    """
    counts = character_counts(docs, text)
    model = train(docs, labels.where(~held_out(key)), counts, text, key)
    return score_toxicity(docs, model, text, (key,)).select(
        F.col(key).alias("doc_id"), held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
