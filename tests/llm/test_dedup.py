"""Repeated passages and the Jaccard join against brute force."""

import itertools
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlake.llm import jaccard_join, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(rows, depth, unit):
    """key, bytes, kept bytes and removed runs of each row, window by window."""
    counts, data = Counter(), []
    for key, text in rows:
        body = (text or "").encode()
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", body)] if unit == "word" else [(k, k + 1) for k in range(len(body))]
        symbols = [body[a:b] for a, b in spans]
        keys = [tuple(symbols[k : k + depth]) for k in range(len(symbols) - depth + 1)]
        counts.update(keys)
        data.append((key, body, spans, keys))
    out = []
    for key, body, spans, keys in data:
        gone = bytearray(len(body))
        for k, window in enumerate(keys):
            if counts[window] > 1:
                end = spans[k + depth][0] if k + depth < len(spans) else len(body)
                gone[spans[k][0] : end] = b"\1" * (end - spans[k][0])
        runs = sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1]))
        out.append((key, len(body), bytes(c for c, x in zip(body, gone) if not x), runs))
    return sorted(out, key=str)


def texts():
    r = random.Random(7)
    passages = ["".join(r.choice("abcd efgh") for _ in range(r.randint(20, 120))) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, "a" * 100), (4, "a" * 40), (5, "ab" * 60), (6, "xyz " * 30), (None, "a" * 55), (7, "dup text that is long enough to be found twice ok"), (7, "dup text that is long enough to be found twice ok")]
    for k in range(250):
        t = "".join(r.choice("abcdefgh ié") for _ in range(r.randint(0, 150)))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            j = r.randint(0, len(t))
            t = t[:j] + p[a : r.randint(a, len(p))] + t[j:]
        rows.append((100 + k if r.random() < 0.95 else 55, t))
    return rows + [(600 + k, rows[50 + k][1]) for k in range(20)]


@pytest.mark.parametrize(("depth", "digit", "unit", "most"), [(24, 8, "byte", 50_000), (24, 8, "byte", 2), (4, 2, "word", 1)])
def test_repeats_against_brute_force(spark, monkeypatch, depth, digit, unit, most):
    monkeypatch.setattr(suffix_dedup, "ANCHOR_ROWS", most)
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 2000)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in suffix_dedup.without_repeats(docs, depth=depth, digit=digit, unit=unit).collect()]
    assert sorted(got, key=str) == removed(rows, depth, unit)


def test_repeats_in_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.limit(250).collect()]
    docs = documents.sparkSession.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in suffix_dedup.without_repeats(docs).collect()]
    want = removed(rows, 400, "byte")
    assert sorted(got, key=str) == want and any(len(x[2]) < x[1] for x in want)


def joined(rows, width, num, den):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    having, shared = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for x in s:
            having[x].append(k)
    for group in having.values():
        shared.update(itertools.combinations(group, 2))
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            up[top(a)] = top(b)
    least = {}
    for k, (key, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), key), key)
    return sorted((key, len(sets[k]), least[top(k)]) for k, (key, _) in enumerate(rows))


def families():
    r, out = random.Random(5), []
    words = [f"w{k}" for k in range(3000)]
    for _ in range(50):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 8, 9, 10, 11, 12, 15, 20, 30, 60, 200, 900]))]
        for _ in range(r.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                j, c = r.randrange(len(w)), r.random()
                if c < 0.4:
                    w[j] = r.choice(words)
                elif c < 0.7:
                    w.insert(j, r.choice(words))
                elif len(w) > 1:
                    w.pop(j)
            out.append((1000 + len(out), " ".join(w) if r.random() < 0.9 else " ".join(w).upper()))
    return out + [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a b"), (8, "same key"), (8, "same key"), (8, "else")]


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_join_against_brute_force(spark, monkeypatch, width, num, den):
    for name, value in (("BLOCK", 4), ("MEMBERS", 3), ("LIST", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in jaccard_join.joined(docs, width=width, num=num, den=den).collect())
    assert got == joined(rows, width, num, den)


def test_a_step_of_the_join_shuffles_little_at_a_time(spark, documents, monkeypatch):
    """1.3 bytes a byte of text went through the shuffle of one table when all cells met at once."""
    sc, write = spark.sparkContext._jsc.sc(), jaccard_join.shared.written

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    most = []

    def written(*args):
        before = shuffled()
        out = write(*args)
        most.append(shuffled() - before)
        return out

    monkeypatch.setattr(jaccard_join.shared, "written", written)
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0]
    jaccard_join.joined(documents, width=5, num=80, den=100)
    assert 0 < max(most) < 0.8 * size


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" ")))
    before = files()
    rows = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count()
    held = rows.join(rows.withColumnRenamed("count", "n"), "k")
    jaccard_join.shared.written(spark, held, "test")
    time.sleep(1)
    assert not files() - before
    assert spark.conf.get(jaccard_join.shared.CLEANUP) == "false"


def test_representatives(spark):
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text or "") for r in jaccard_join.representatives(docs).collect())
    want = joined(rows, 3, 90, 100)
    heads = {(k, c) for k, _, c in want if k == c}
    assert {k for k, _ in got} == {k for k, _ in heads} and len(got) == len(set(got))


def test_odd_and_empty(odd, empty):
    for docs in (odd, empty):
        n = docs.count()
        assert jaccard_join.joined(docs).count() == n == suffix_dedup.without_repeats(docs).count()
        assert set(jaccard_join.representatives(docs).columns) == set(docs.columns)
    found = {r.doc_id: r for r in jaccard_join.joined(odd).where("doc_id IN (1, 2, 3)").collect()}
    assert all(r.component_id == k and r.n_shingles == 0 for k, r in found.items())
