"""The registered queries against DuckDB, the tokenizers' libraries and brute force, on a small fixture with odd rows."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fleetlake.llm import queries

SOURCE = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs = pq.read_table(f"{SOURCE}/documents.parquet").to_pylist()
    docs = sorted((d for d in docs if len(d["text"] or "") < 6000), key=lambda d: d["doc_id"])[:70]
    first = max(d["doc_id"] for d in docs) + 1
    passage = " ".join(f"w{k}\u00e9" for k in range(120))
    odd = [None, "", " \n ", docs[0]["text"], docs[1]["text"].upper(), "one two", f"start {passage} end", f"{passage}\u00fc other", "ab" * 500, "x <|endoftext|> y's \u4e2d\u00a0z"]
    docs += [{**docs[k], "doc_id": first + k, "text": t, "source": None if k == 0 else docs[k]["source"]} for k, t in enumerate(odd)]
    labels = pq.read_table(f"{SOURCE}/labels.parquet")
    pages = pq.read_table(f"{SOURCE}/pages.parquet").to_pylist()[:25]
    last = max(p["page_id"] for p in pages)
    pages += [{**pages[k], "page_id": last + 1 + k, "html": h} for k, h in enumerate([None, "", pages[0]["html"], pages[3]["html"], "<p>\u00e9</p>"])]
    schema = {name: pq.read_schema(_file(f"{SOURCE}/{name}.parquet")) for name in ("documents", "pages")}
    pq.write_table(pa.Table.from_pylist(docs, schema["documents"]), folder / "documents.parquet")
    pq.write_table(pa.Table.from_pylist(pages, schema["pages"]), folder / "pages.parquet")
    pq.write_table(labels, folder / "labels.parquet")
    return str(folder), {d["doc_id"]: d["text"] or "" for d in docs}


def _file(path):
    return path if os.path.isfile(path) else next(os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".parquet"))


def answer(spark, tables, name):
    rows = [r.asDict() for r in queries.QUERIES[name](spark, tables[0]).collect()]
    if name != "op10_warc_archive":
        assert sorted(r["doc_id"] for r in rows) == sorted(tables[1])
        return {r["doc_id"]: r for r in rows}
    return rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_as_sql_states(spark, tables, name):
    got = queries.QUERIES[name](spark, tables[0])
    with duckdb.connect() as db:
        for table in ("documents", "pages"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tables[0]}/{table}.parquet')")
        want = db.execute(queries.SQL[name])
        names = [c[0] for c in want.description]
        rows = [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in want.fetchall()]
    found = [tuple(round(r[n], 6) if isinstance(r[n], float) else r[n] for n in names) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(rows, key=repr) and set(names) == set(got.columns)


def test_op2_counts(spark, tables):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for doc, row in answer(spark, tables, "op2_token_counts").items():
        text = tables[1][doc]
        n = len(model.encode(text))
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_op3_against_all_windows(spark, tables):
    body = {d: t.encode() for d, t in tables[1].items()}
    times = Counter(b[k : k + 400] for b in body.values() for k in range(len(b) - 399))
    lost = 0
    for doc, row in answer(spark, tables, "op3_suffix_dedup").items():
        b, gone = body[doc], bytearray(len(body[doc]))
        for k in range(len(b) - 399):
            if times[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        assert row["text"] is not None and (row["text"] == kept.decode("utf-8", "replace") or "\ufffd" in row["text"])
        lost += sum(gone) > 0
    assert lost >= 4


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_op4_round_trip(spark, tables):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, row in answer(spark, tables, "op4_byte_bpe").items():
        ids = whole.encode(tables[1][doc], add_special_tokens=False).ids
        back = whole.decode(ids, skip_special_tokens=False)
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_op6_counts_and_base_rule(spark, tables):
    for doc, row in answer(spark, tables, "op6_quality_rules").items():
        text = tables[1][doc]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        times, inside = Counter(windows), set()
        for k, w in enumerate(windows):
            if times[w] > 1:
                inside |= set(range(k, k + 8))
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside))
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == want
        assert row["base_failed"] == (len(words) < 20 or 100 * len(inside) > 30 * len(words)) and not (row["base_failed"] and row["kept"])


def test_op7_is_whole_and_repeats(spark, tables):
    one, two = (answer(spark, tables, "op7_toxicity") for _ in range(2))
    assert one == two
    for doc, row in one.items():
        assert row["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0) and 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.5)
    empty = [row["score"] for doc, row in one.items() if not tables[1][doc].strip()]
    assert len(set(empty)) == 1


def test_op8_payloads(spark, tables):
    by_text = {}
    for doc, row in answer(spark, tables, "op8_tiff_media").items():
        b = tables[1][doc].encode()
        payload = b + b" " * (-len(b) % 192 if b else 192)
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert row["media_bytes"] > 0 and re.fullmatch("[0-9a-f]{64}", row["media_sha256"]) and row["feature"]
        assert by_text.setdefault(b, row["media_sha256"]) == row["media_sha256"]


def test_op9_files(spark, tables):
    from tokenizers import Tokenizer

    whole, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for doc, row in sorted(answer(spark, tables, "op9_token_files").items()):
        ids = [*whole.encode(tables[1][doc], add_special_tokens=False).ids, 2]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
