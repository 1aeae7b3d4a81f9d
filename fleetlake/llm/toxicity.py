"""Toxicity by compression distance: the same window is compressed with a dictionary of toxic and with one of
ordinary text, and what the first saves over the second speaks for toxicity.

Both dictionaries hold the content that zstandard's trainer finds in ordinary text, at the same distance from the
window, so that ordinary windows come out equally long. Behind it the toxic one holds the segments that set toxic
text apart, words and word beginnings that are far commoner there, and the other the same without their heads. Where no
segment does, the dictionaries are what the trainer finds in toxic and in ordinary windows. Letters are shifted by
their place in the word, so that beginnings of words match beginnings only. A text's savings and its number of windows
give its score through a logistic curve, which is fitted, as the decision at 0.5 is calibrated, on labelled texts that
the dictionaries haven't seen: each fold of the labels is measured with dictionaries of the others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from . import textkernel as K

#: Labelled texts of each class that a model is fitted on, at most, and bytes of all of them.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 2000, 4000, 64 << 20
#: Windows of a class that the trainer sees, at most; they are taken evenly from all the sample's texts.
POOL = 25_000
#: Words of a window and from one window to the next; bytes of common dictionary content.
WINDOW, STEP, COMMON = 8, 4, 16384
#: A segment is in so many toxic texts at least and so many times commoner there by words; the logarithm of its
#: likelihood ratio is EVIDENCE times that of the number of toxic texts at least. No text counts for more than MOST_WORDS
#: of its words; one in the other class costs PRICE toxic ones, as the classes' words go.
LEAST_TEXTS, LEAST_TIMES, EVIDENCE, MOST_WORDS, PRICE = 2, 4.0, 2.0, 3, 3.0
#: Folds of the labelled texts: the fewer labels the more, at least and at most.
FOLDS, FOLD_TEXTS = (3, 10), 200
TOP = (3, 8)
#: Toxic texts are copies of each other where this share of so many least hashes of their words agrees.
HASHES, ALIKE = 64, 0.4
#: What stands for a segment's first bytes where these are taken away; it equals no text.
BLANK = b"\1\2\3\4"
#: Letters lower-cased; whatever else parts words.
_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
#: The letters' numbers, how many there are, the least byte that stands for one, and the last place that counts.
_LETTER = np.where(_KEEP >= 128, _KEEP.astype(np.int16) - 102, _KEEP.astype(np.int16) - 97).astype(np.int16)
_LETTERS, _LEAST, _LAST = 154, 48, 12


def windows(words: list[bytes]) -> list[bytes]:
    """Overlapping windows over the words, so that each word has its neighbours in one; at least one window."""
    return [b" " + b" ".join(words[k : k + WINDOW]) + b" " for k in range(0, max(1, len(words) - WINDOW + STEP), STEP)]


class Words:
    """Texts as arrays of numbers of their distinct words."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}

    def add(self, words: list[bytes]) -> np.ndarray:
        return np.unique(np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int64))


def _copies(texts: list[np.ndarray]) -> np.ndarray:
    """For each text the number of the first that it is a copy of, by the share of equal least hashes of the words."""
    odd = np.random.default_rng(0).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.array([((t.astype(np.uint64)[:, None] + np.uint64(1)) * odd).min(axis=0) if len(t) else odd for t in texts])
    first, own = [], np.arange(len(texts))
    for k, hashes in enumerate(least):
        alike = (least[first] == hashes).mean(axis=1) if first else np.zeros(0)
        if len(alike) and alike.max() >= ALIKE:
            own[k] = first[int(alike.argmax())]
        else:
            first.append(k)
    return own


def _words_with(texts: list[np.ndarray], of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct words with each of n segments the texts have, MOST_WORDS a text at most, and how many texts have
    one; ``of`` is the segment of each word, below 0 none."""
    flat = of[np.concatenate(texts)] if texts else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return _tallied(owner[flat >= 0], flat[flat >= 0], n)


def _tallied(owner: np.ndarray, segment: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    pair, times = np.unique(owner * n + segment, return_counts=True)
    return np.bincount(pair % n, weights=np.minimum(times, MOST_WORDS), minlength=n), np.bincount(pair % n, minlength=n)


def _telling(vocabulary: list[bytes], own: list[np.ndarray], other: list[np.ndarray]) -> list[bytes]:
    """Segments, words or beginnings of words, that set the texts ``own`` apart from ``other``. Each is chosen for
    the texts in which it explains words that no earlier choice does."""
    here, there = sum(map(len, own)), sum(map(len, other))
    if not here or not there:
        return []
    usual, least = here / (here + there), EVIDENCE * np.log(len(own))
    alive = np.array([3 <= len(w) <= 40 for w in vocabulary], bool)
    segments: list[bytes] = []
    against: list[float] = []
    members: list[np.ndarray] = []
    for length in (*range(4, 12), 0):  # a longer beginning can't be in more texts than a shorter one
        names: dict[bytes, int] = {}
        of = np.full(len(vocabulary), -1, np.int64)
        for k in np.flatnonzero(alive).tolist():
            word = vocabulary[k]
            if not length or len(word) >= length:
                of[k] = names.setdefault(b" " + word[:length] if length else b" " + word + b" ", len(names))
        if not names:
            continue
        (count, among), (opposed, _) = _words_with(own, of, len(names)), _words_with(other, of, len(names))
        frequent = among >= LEAST_TEXTS
        short = of < 0  # words too short for this length stay for the whole words
        alive &= short | frequent[np.maximum(of, 0)]
        share = count / np.maximum(count + opposed, 1)
        ratio = count * np.log(np.maximum(share, 1e-9) / usual) + opposed * np.log(np.maximum(1 - share, 1e-9) / (1 - usual))
        good = frequent & (count * there >= LEAST_TIMES * (opposed + 0.5) * here) & (ratio >= least)
        listed = list(names)
        for s in np.flatnonzero(good).tolist():
            segments.append(listed[s])
            against.append(float(opposed[s]))
            members.append(np.flatnonzero(of == s))
    if not segments:
        return []
    order = sorted(range(len(segments)), key=lambda s: (len(segments[s]), segments[s]))
    word = np.concatenate([members[s] for s in order])
    place = np.repeat(np.arange(len(order)), [len(members[s]) for s in order])
    by_word = np.argsort(word, kind="stable")
    word, place = word[by_word], place[by_word]
    flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(t) for t in own])
    lo, hi = np.searchsorted(word, flat), np.searchsorted(word, flat, "right")
    text = np.repeat(owner, hi - lo)  # every text's words with every segment that they have
    segment, said = K.gather(place, lo, hi - lo), np.repeat(flat, hi - lo)
    price = PRICE * here / there * np.array([against[s] for s in order])
    chosen: list[bytes] = []
    while len(text):
        count, among = _tallied(text, segment, len(order))
        worth = np.where(among >= LEAST_TEXTS, count - price, -np.inf)
        best = len(order) - 1 - int(np.argmax(worth[::-1]))  # of equals the longest
        if worth[best] <= 0:
            break
        chosen.append(segments[order[best]])
        stay = ~np.isin(said, members[order[best]])  # what it stands for no longer speaks for others
        text, segment, said = text[stay], segment[stay], said[stay]
    return chosen


@dataclass
class Model:
    """Both dictionaries' content and the curve. ``curve`` None: nothing was learnt, every score is 0."""

    toxic: bytes = b""
    ordinary: bytes = b""
    curve: tuple[float, ...] | None = None

    def _size(self, content: bytes):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        told = zstandard.ZstdCompressionParameters.from_level(6, source_size=256, dict_size=len(content), min_match=5, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        data.precompute_compress(compression_params=told)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=told).compress

    def ready(self) -> Model:
        self._with_toxic, self._with_ordinary = self._size(self.toxic), self._size(self.ordinary)
        return self

    def features(self, words: list[bytes]) -> tuple[float, ...]:
        """Largest saving, the sums of the TOP largest, the sum of all by the number of windows and by its root, and the
        logarithm of that number, each in units that make them alike."""
        a, b = self._with_toxic, self._with_ordinary
        saved = sorted([len(b(w)) - len(a(w)) for w in windows(words)], reverse=True)
        n, whole = len(saved), sum(x for x in saved if x > 0)
        return saved[0] / 4, *(sum(x for x in saved[:k] if x > 0) / (2.5 * k) for k in TOP), whole / n, whole / n**0.5, math.log(n) / 4

    def score(self, words: list[bytes]) -> float:
        if self.curve is None:
            return 0.0
        z = self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], self.features(words)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def placed(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes of texts, which begin at ``starts``, with letters shifted by their places in their words."""
    kept, at = _KEEP[raw], np.arange(len(raw), dtype=np.int32)
    parts = kept == 0x20
    before = np.where(parts, at, -1)
    first = starts[starts < len(raw)]
    before[first] = np.maximum(before[first], first - 1)
    place = np.minimum(at - np.maximum.accumulate(before) - 1, _LAST)
    return np.where(parts, 0x20, (_LETTER[kept] + 37 * place) % _LETTERS + _LEAST).astype(np.uint8)


def words_of(text: str | None) -> list[bytes]:
    return placed(np.frombuffer((text or "").encode(), np.uint8), np.zeros(1, np.int64)).tobytes().split()


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic curve with a small ridge, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), np.array([0.01] + [0.1] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
    return tuple(float(v) for v in w)


def _content(windows: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(COMMON, windows).as_bytes()[-COMMON:]
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(windows)[-COMMON:]


def _evenly(rows: list, most: int) -> list:
    """At most ``most`` of the rows, at equal distances."""
    return rows if len(rows) <= most else [rows[k * len(rows) // most] for k in range(most)]


def fit(sample: list[tuple[str | None, int]], odds: float | None = None) -> Model:
    """A model from labelled texts (label 1: toxic). All of them make the dictionaries; the curve is fitted on what
    each fold's texts save with dictionaries of the other folds. Without two texts of each class there is no model.
    ``odds``: of toxic to ordinary texts where the sample isn't as all texts are; the curve is moved accordingly."""
    label = np.array([y for _, y in sample], int)
    fewest = min((label == 1).sum(), (label == 0).sum())
    if fewest < 2:
        return Model()
    folds = int(min(fewest, np.clip(FOLD_TEXTS // fewest, *FOLDS)))
    book = Words()
    texts = [book.add(words_of(text)) for text, _ in sample]
    toxic_at = np.flatnonzero(label == 1)
    group = _copies([texts[k] for k in toxic_at])
    leads = np.unique(group)
    folds = max(2, min(folds, len(leads)))
    fold = np.zeros(len(label), int)
    fold[label == 0] = np.arange((label == 0).sum()) % folds
    fold[toxic_at] = np.searchsorted(leads, group) % folds if len(leads) > 1 else np.arange(len(group)) % folds
    single = np.ones(len(label), bool)  # copies of a toxic text are measured with it and tell their words once
    single[toxic_at[group != np.arange(len(group))]] = False
    pools: tuple[list, list] = ([], [])  # of ordinary and of toxic texts: fold and window
    for k, (text, y) in enumerate(sample):
        seen = windows(words_of(text))
        pools[y].extend((fold[k], w) for w in (seen[::2] if y else seen[k % 7 % len(seen) :: 7]))
    pools = (_evenly(pools[0], POOL), _evenly(pools[1], POOL))
    vocabulary = list(book.number)

    def made(without: int, plain: bool = False) -> Model:
        ordinary, toxic = ([w for f, w in pool if f != without] for pool in pools)
        told = [] if plain else _telling(vocabulary, *([t for t, f, x in zip(texts, fold, np.where(single, label, -1)) if x == y and f != without] for y in (1, 0)))
        common = _content(ordinary)
        # the same without the segments' heads, so that what their ends have in common with ordinary words saves nothing
        blank = b"".join(BLANK[: len(x)] + x[len(BLANK) :] for x in told)
        model = Model(_content(toxic) if plain else common + b"".join(told), common + blank).ready()
        model.segments = told
        return model

    model = made(-1)
    plain = not model.segments
    if plain:
        model = made(-1, plain)
    found = {}
    for without in range(folds):
        part = made(without, plain)
        found |= {k: part.features(words_of(sample[k][0])) for k in np.flatnonzero(fold == without).tolist()}
    model.curve = _logistic(np.array([found[k] for k in range(len(label))]), label.astype(float))
    if odds:
        model.curve = (model.curve[0] + float(np.log(odds * (label == 0).sum() / (label == 1).sum())), *model.curve[1:])
    return model


def fold_of(key: Column) -> Column:
    """crc32 of the key as text, modulo 5 (null as the empty text); 0 is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: tuple[int, int] = (SAMPLE_TOXIC, SAMPLE_ORDINARY)) -> Model:
    """A model from at most ``most`` labelled texts of each class outside the held-out fold, those whose keys have
    the least hashes, as many as have SAMPLE_BYTES. Keys with several labels count as toxic if one of them says so; null labels are left out."""
    told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("__label"))
    told = told.where(fold_of(F.col("__key")) != 0)
    counts = {r["__label"]: r["count"] for r in told.groupBy("__label").count().collect()}  # two rows
    order = [F.xxhash64(F.col("__key").cast("string")), F.col("__key")]
    few = told.where("__label = 1").orderBy(*order).limit(most[0]).unionByName(told.where("__label = 0").orderBy(*order).limit(most[1]))
    # bounded by the parameter, so it may go to every task; a key's first text in order stands for it
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(few), "__key").groupBy("__key", "__label").agg(F.min("__text").alias("__text"))
    held = F.sum(F.coalesce(F.octet_length("__text"), F.lit(0))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__held", held).where(F.col("__held") <= SAMPLE_BYTES).drop("__held").collect()
    rows.sort(key=lambda r: (str(r["__key"]), r["__text"] or ""))
    odds = counts[1] / counts[0] if counts.get(1) and counts.get(0) else None
    return fit([(r["__text"], r["__label"]) for r in rows], odds)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: likelier toxic) and predicted (1 from 0.5 on). Null and empty texts are
    scored as one empty window; all windows of long texts count. Columns with the results' names are replaced."""
    content = (model.toxic, model.ordinary, model.curve)

    def make(batch: pa.RecordBatch) -> list:
        if content not in _ready:
            _ready.clear()
            _ready[content] = Model(*content).ready()
        own, out = _ready[content], []
        for t in K.texts(batch.column(text)):
            whole = placed(t.data, t.starts).tobytes()
            out += [own.score(whole[a:b].split()) for a, b in zip(t.starts.tolist(), t.starts[1:].tolist())]
        score = np.array(out)
        return [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]

    return shared.mapped(docs, {"score": "double", "predicted": "int"}, make)


_ready: dict[tuple, Model] = {}
