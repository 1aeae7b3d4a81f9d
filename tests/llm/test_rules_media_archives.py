"""Quality rules, toxicity, TIFF pages and WARC archives."""

import base64
import gzip
import hashlib
import random
import re
import shutil
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlake.llm import quality_rules, tiff_media, toxicity, warc_archive
from fleetlake.llm import textkernel as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counted(text):
    words, windows, lines, seen, twice = WORD.findall(text), {}, text.split("\n"), set(), 0
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    inside = {j for at in windows.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
    for line in lines:
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(inside)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab  \n\n|é#日\x0b"), max_size=150), min_size=1, max_size=5), st.sampled_from([40, 1 << 20]))
def test_counts_against_brute_force(texts, most):
    got = [list(x) for t in K.texts(pa.array(texts), most) for x in zip(*(quality_rules.measure(t)[c].tolist() for c in COUNTS))]
    assert got == [counted(t) for t in texts]


def test_verdicts(spark, documents):
    clean = " ".join(f"word{k}, and" for k in range(40)) + "."
    junk = {"menu": " | ".join(f"item{k}" for k in range(40)), "noise": " ".join(f"word{k}###" for k in range(40)), "stutter": " ".join(w for k in range(8) for w in [f"w{k}"] * 7)}
    rows = [("clean", clean), ("lines", f"{clean}\n{junk['menu'][:40]}"), *junk.items()]
    got = {r.name: r for r in quality_rules.judged(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert got["clean"].kept and got["clean"].cleaned == clean and got["lines"].kept and got["lines"].cleaned == clean
    assert not any(got[k].kept for k in junk)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.judged(documents, cleaned=None).join(labels, "doc_id").where("NOT base_failed")
    shares = {r.quality: r.share for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[1] > 0.99 and shares[0] < 0.6


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.trained(docs, labels)
    held = docs.join(labels, "doc_id").where(toxicity.fold_of(F.col("doc_id")) == 0)
    rows = toxicity.scored(held, model).select("toxic", "predicted", "score").collect()
    right = sum(r.toxic == r.predicted for r in rows) / len(rows)
    found = [r.predicted for r in rows if r.toxic]
    false = [r.predicted for r in rows if not r.toxic]
    assert right > 0.94 and sum(found) / len(found) > 0.6 and sum(false) / len(false) < 0.02
    assert all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in rows] == [r.score for r in toxicity.scored(held, toxicity.trained(docs, labels)).collect()]


def test_toxicity_in_each_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    held = docs.join(labels, "doc_id").where(toxicity.fold_of(F.col("doc_id")) == 0)
    rows = toxicity.scored(held, toxicity.trained(docs, labels)).groupBy("lang", "toxic").agg(F.avg("predicted").alias("share")).collect()
    shares = {(r.lang, r.toxic): r.share for r in rows}
    for lang in ("de", "en", "es", "fr"):
        assert shares[lang, 1] >= 0.7 and shares[lang, 0] <= 0.03, shares


def test_letters_shifted_by_place():
    texts = ["", "Trash, été trash", " x", "bomentec\n"]
    t = next(K.texts(pa.array(texts)))
    whole = toxicity.placed(t.data, t.starts).tobytes()
    assert [whole[a:b].split() for a, b in zip(t.starts.tolist(), t.starts[1:].tolist())] == [toxicity.words_of(x) for x in texts]
    trash, _, again = toxicity.words_of(texts[1])
    assert trash == again and toxicity.words_of("boment")[0] == toxicity.words_of(texts[3])[0][:6] and toxicity.words_of("ment")[0] not in toxicity.words_of("boment")[0]


def test_toxicity_with_few_labels(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.scored(docs, toxicity.trained(docs, labels)).join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    assert sum(r.predicted for r in rows if r.toxic) >= 4 and sum(r.predicted for r in rows if not r.toxic) <= 1
    # no segment is in two texts: toxic windows against ordinary ones
    plain = toxicity.fit([("wretched filthy vermin", 1), ("loathsome stinking maggot", 1), *[(f"calm river number {k} flows north", 0) for k in range(4)]])
    assert plain.curve and not plain.segments and plain.ordinary
    assert plain.features(toxicity.words_of("filthy vermin"))[0] > 0 >= plain.features(toxicity.words_of("calm river number"))[0]
    for few in ([("", 1), (None, 1), ("", 0), ("x", 0)], [("a", 1)] * 2 + [("a", 0)] * 2):
        assert 0 < toxicity.fit(few).score([b"x"]) < 1


def test_copies_of_toxic_texts_tell_once():
    words = [f"word{k}" for k in range(60)]
    book = toxicity.Words()
    texts = [book.add([w.encode() for w in t]) for t in (words, words[:-3], [f"other{k}" for k in range(50)] + words[:10], [])]
    assert toxicity._copies(texts).tolist() == [0, 0, 2, 3]


def test_toxicity_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for docs in (odd, empty):
        rows = toxicity.scored(docs, toxicity.trained(docs, none)).collect()
        assert len(rows) == docs.count() and all(r.score == 0 and r.predicted == 0 for r in rows)


IMAGE = st.tuples(st.integers(1, 40), st.integers(1, 70), st.integers(0, 2**32 - 1), st.sampled_from([2, 4, 256]))


@settings(max_examples=120, deadline=None)
@given(st.lists(IMAGE, min_size=1, max_size=3), st.sampled_from([tiff_media.NONE, tiff_media.LZW, tiff_media.DEFLATE, tiff_media.PACKBITS]), st.sampled_from([1, 2]), st.sampled_from([0, 16, 32]), st.integers(1, 50))
def test_tiff_round_trip(shapes, scheme, predictor, tile, strip):
    images = [np.random.default_rng(seed).integers(0, top, (h, w), dtype=np.uint8) for h, w, seed, top in shapes]
    back = list(tiff_media.pages(tiff_media.encode(images, scheme, predictor, strip, tile)))
    assert len(back) == len(images) and all((a == b).all() for a, b in zip(back, images))


def test_lzw_through_all_widths():
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes() + b"ab" * 9000
    assert tiff_media.unlzw(tiff_media.lzw(data)) == data
    assert tiff_media.unlzw(bytes.fromhex("800b6050220c0c8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])  # a known code stream


def test_big_endian_and_broken_files():
    body = zlib.compress(bytes(range(6)))
    tags = [(256, 3), (257, 2), (258, 8), (259, 8), (262, 1), (273, 8), (278, 2), (279, len(body))]
    at = 8 + len(body)
    ifd = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in tags) + struct.pack(">I", 0)
    data = struct.pack(">2sHI", b"MM", 42, at) + body + ifd
    assert [p.tolist() for p in tiff_media.pages(data)] == [[[0, 1, 2], [3, 4, 5]]]
    for bad in (b"", b"II*\0", b"PNG....." * 3, data[:-4] + struct.pack(">I", at)):
        with pytest.raises((ValueError, struct.error)):
            list(tiff_media.pages(bad))


def test_media_of_documents(spark, documents, odd, empty):
    for docs in (documents, odd, empty):
        files = tiff_media.with_media(docs.select("doc_id", "text", *[c for c in ("media", "n_bytes") if c in docs.columns]))
        rows = tiff_media.read_back(files, ["doc_id", "text", "n_bytes"]).collect()
        assert len(rows) == docs.count()
        for r in rows[::5]:
            text = (r.text or "").encode()
            body = text + b" " * (max(192, -(-len(text) // 192) * 192) - len(text))
            assert (r.n_bytes, r.payload_bytes) == (len(text), len(body))
            assert r.payload_sha256 == hashlib.sha256(body).hexdigest() and r.tail_crc32 == zlib.crc32(body[-16:])
    long = spark.createDataFrame([(1, "ab c" * 300_000)], "doc_id long, text string")
    found = tiff_media.page_rows(tiff_media.with_media(long), ["doc_id"])
    assert [r.page for r in found.select("page").collect()] == list(range(4))


def pages(spark):
    r = random.Random(2)
    rows = [(k, f"http://x.example/{k} é", "same page" if k % 4 == 0 else r.choice([None, "", f"<p>{r.randint(0, 5)}</p>", f"unique {k} é"])) for k in range(200)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


@pytest.mark.parametrize("least", [0, 9])
def test_archives_against_brute_force(spark, least):
    rows, docs = pages(spark)
    first = {}
    for key, _, html in rows:
        first.setdefault(html or "", key)
    got = {int(r.key): r for r in warc_archive.read(spark, warc_archive.write(docs, least=least)).collect()}
    assert len(got) == len(rows)
    for key, url, html in rows:
        body = (html or "").encode()
        to = first[html or ""] if first[html or ""] != key and len(body) >= least else None
        r = got[key]
        assert (r.record_type, r.refers_to) == (("revisit", str(to)) if to is not None else ("response", None))
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and r.payload_bytes == len(body)
        assert r.url == url and (to is not None or bytes(r.payload) == body)


def test_archive_is_one_member_per_record_and_checked():
    records = [warc_archive.page_record(k, "u", b"x" * k, warc_archive.digest(b"x" * k)) for k in range(5)]
    data = b"".join(records)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 5
    for step in (1, 7, 1000):
        found = list(warc_archive.records(data[k : k + step] for k in range(0, len(data), step)))
        assert [len(r.http()[1]) for r in found] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        list(warc_archive.records([data[:-5]]))
    plain = gzip.decompress(records[4])
    for broken in (plain.replace(b"xxxx", b"xxxy"), plain.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(ValueError):
            list(warc_archive.records([gzip.compress(broken)]))


def test_archive_odd_and_empty(spark):
    rows = [(None, None, None), (None, "u", "same"), (3, "u\n x", "same"), (3, "u", "same"), (2, None, "same"), (9, "v", "y" * 500_000)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("key", "payload", "digest", "revisit")})
    got = warc_archive.read(spark, warc_archive.write(docs)).collect()
    assert len(got) == 6 and sorted((r.key, r.refers_to) for r in got if r.record_type == "revisit" and r.key) == [("3", "2"), ("3", "2")]
    assert warc_archive.read(spark, warc_archive.write(docs.limit(0))).count() == 0


def test_rules_odd_and_empty(odd, empty):
    assert quality_rules.judged(odd).count() == odd.count() and quality_rules.judged(empty).count() == 0
    assert {r.cleaned for r in quality_rules.judged(odd).where("text IS NULL OR text = ''").collect()} == {""}


def test_archives_are_what_the_list_names(spark, tmp_path):
    rows = [(k, f"http://h/{k}", "same" if k % 3 else f"page {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    files = warc_archive.write(docs, folder)
    names = [r.path for r in files.collect()]
    stray = names[0].removeprefix("file://")
    shutil.copy(stray, stray.replace("part-", "part-9"))  # what another attempt of a task has left
    warc_archive.write(docs.limit(5), folder)
    told = lambda f: sorted((int(r.key), r.record_type, r.refers_to, r.payload_digest) for r in warc_archive.read(spark, f).collect())
    want = told(files)
    assert [x[0] for x in want] == list(range(40))
    shuffled = docs.orderBy(F.rand(3)).repartition(5)
    assert told(warc_archive.write(shuffled)) == want
