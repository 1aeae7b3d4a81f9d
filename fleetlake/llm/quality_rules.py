"""Line-first quality rules: lines that look like navigation, boilerplate or broken sentences go, then documents
that lose too much of their text.

Rules per line (a line is what stands between newlines; lines without a word are neither kept nor lost):

* navigation: at least 4 words, and at least a third as many bars or bullets as words (``|`` ``>`` ``*`` ``#``);
* boilerplate: contains, case aside, a phrase of BOILERPLATE;
* punctuation: at least 4 words, of which half or more end in a symbol ``#*$%&|<>`` or an exclamation mark;
* repetition: at least 4 words and equal to an earlier line, or at least 8 of which half equal the word before.

A document is kept if it passes the base rules and the lines that stay hold more than LOST_SHARE of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared
from . import textkernel as K

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BARS = np.zeros(256, bool)
BARS[list(b"|>*#")] = True
NOISE = SYMBOLS.copy()
NOISE[ord("!")] = True
#: Fixed phrases, lower case.
BOILERPLATE = [b"lorem ipsum", b"javascript", b"cookie policy", b"terms of use", b"privacy policy", b"all rights reserved", b"click here", b"sign up now", b"subscribe to our", b"share this"]
#: A document goes when at least this share of its words stood in lines that failed.
LOST_SHARE = 0.5
WINDOW, LEAST_WORDS, REPEATED_PERCENT = 8, 20, 30


def _repeated_words(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Per document, words inside an 8-word window that the document holds twice or more."""
    out = np.zeros(len(before) - 1, np.int64)
    runs = K.rolling(hashes, WINDOW)
    for i, (a, b) in enumerate(zip(before.tolist(), before[1:].tolist())):
        if b - a <= WINDOW:
            continue
        own = runs[a : b - WINDOW + 1]
        order = np.sort(own)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            at = np.searchsorted(twice, own)
            at[at == len(twice)] = 0
            hit = np.flatnonzero(twice[at] == own)
            steps = np.zeros(b - a + 1, np.int64)
            np.add.at(steps, hit, 1)
            np.add.at(steps, hit + WINDOW, -1)
            out[i] = int((np.cumsum(steps) > 0).sum())
    return out


def _lines(t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every line of every document, newline excluded."""
    breaks = np.flatnonzero(t.data == 10)
    starts = np.sort(np.concatenate([t.starts[:-1], breaks + 1]), kind="stable")
    owner = np.searchsorted(t.starts[1:], breaks, "right")
    owner = np.sort(np.concatenate([np.arange(len(t)), owner]), kind="stable")
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:]
    same = np.zeros(len(starts), bool)
    same[:-1] = owner[1:] == owner[:-1]
    ends[same] -= 1
    last = np.flatnonzero(~same)
    ends[last] = t.starts[owner[last] + 1]
    return starts, ends, owner


def _between(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie in each [start, end)."""
    return np.searchsorted(marks, ends) - np.searchsorted(marks, starts)


def measure(t: K.Texts) -> dict[str, np.ndarray]:
    """Counts, verdicts and line decisions for the documents of a slice."""
    starts, ends, before = K.words(t)
    hashes = K.span_hashes(t.data, starts, ends)
    n_words = np.diff(before)
    heads = (t.data & 0xC0) != 0x80
    letters = np.flatnonzero(heads & ~K.SPACE[t.data])
    symbols = np.flatnonzero(SYMBOLS[t.data])
    n_repeat = _repeated_words(hashes, before)

    line_start, line_end, owner = _lines(t)
    line_words = _between(starts, line_start, line_end)
    line_hash = K.span_hashes(t.data, line_start, line_end)
    own = K.mix(line_hash + K.mix(owner.astype(np.uint64) + np.uint64(1)))
    own[line_words == 0] = K.mix(np.flatnonzero(line_words == 0).astype(np.uint64))  # empty lines equal nothing
    order = np.argsort(own, kind="stable")
    earlier = np.zeros(len(own), bool)
    earlier[order[1:]] = own[order[1:]] == own[order[:-1]]
    earlier &= line_words > 0

    # bars that stand alone separate items
    bars = np.flatnonzero(BARS[t.data])
    alone = bars[_alone(t.data, bars)]
    noisy = starts[NOISE[t.data[ends - 1]]]
    same = np.zeros(len(starts), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    stuttered = _between(starts[same], line_start, line_end)
    navigation = (line_words >= 4) & (3 * _between(alone, line_start, line_end) >= line_words)
    broken = (line_words >= 4) & (2 * _between(noisy, line_start, line_end) >= line_words)
    stutter = (line_words >= 8) & (2 * stuttered >= line_words)
    boilerplate = np.zeros(len(line_start), bool)
    lowered = bytes(K.LOWER[t.data])
    for phrase in BOILERPLATE:
        at = lowered.find(phrase)
        while at >= 0:
            line = int(np.searchsorted(line_start, at, "right")) - 1
            if at + len(phrase) <= line_end[line]:
                boilerplate[line] = True
            at = lowered.find(phrase, at + 1)
    failed = navigation | broken | stutter | boilerplate | (earlier & (line_words >= 4))
    lost = np.bincount(owner[failed], line_words[failed], len(t)).astype(np.int64)
    base_failed = (n_words < LEAST_WORDS) | (100 * n_repeat > REPEATED_PERCENT * n_words)
    return {
        "n_words": n_words,
        "word_chars": _between(letters, t.starts[:-1], t.starts[1:]),
        "n_symbols": _between(symbols, t.starts[:-1], t.starts[1:]),
        "n_dup_lines": np.bincount(owner[earlier], minlength=len(t)).astype(np.int64),
        "n_repeat_words": n_repeat,
        "lost_words": lost,
        "base_failed": base_failed,
        "kept": ~base_failed & (lost < LOST_SHARE * np.maximum(n_words, 1)),
        "line_start": line_start,
        "line_end": line_end,
        "line_owner": owner,
        "line_failed": failed,
    }


def _alone(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    left = np.ones(len(at), bool)
    left[at > 0] = K.SPACE[data[at[at > 0] - 1]]
    right = np.ones(len(at), bool)
    inner = at < len(data) - 1
    right[inner] = K.SPACE[data[at[inner] + 1]]
    return left & right


COUNTS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "lost_words": "long", "base_failed": "boolean", "kept": "boolean"}


def judged(docs: DataFrame, text: str = "text", cleaned: str | None = "cleaned") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and, unless ``cleaned`` is None, the text without the lines
    that failed. Null and empty texts have no words, fail the base rules and clean to the empty string. Texts of
    any length are judged whole; columns with the results' names are replaced."""
    fields = COUNTS | ({cleaned: "string"} if cleaned else {})

    def make(batch: pa.RecordBatch) -> list:
        parts: dict[str, list] = {name: [] for name in fields}
        for t in K.texts(batch.column(text)):
            found = measure(t)
            for name in COUNTS:
                parts[name].append(found[name])
            if cleaned:
                whole, at = bytes(t.data), np.searchsorted(found["line_owner"], np.arange(len(t) + 1))
                for i in range(len(t)):
                    lines = range(at[i], at[i + 1])
                    parts[cleaned].append("\n".join(whole[found["line_start"][k] : found["line_end"][k]].decode() for k in lines if not found["line_failed"][k]))
        return [pa.array(parts[n], pa.string()) if n == cleaned else pa.array(np.concatenate(parts[n])) for n in fields]

    return shared.mapped(docs, fields, make)
