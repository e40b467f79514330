"""WARC archives: round trips against the pages, and a plain reader of the files."""

import gzip
import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from marginalia.llm import warc

INNER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Type: text/plain\r\nContent-Length: 4\r\n\r\nevil\r\n\r\n"
SCHEMA = "page_id long, url string, html string, digest string, size int"


def rows():
    draw = np.random.default_rng(12)
    copy, edge, short = "copy ü " * 300, "e" * 1000, "s" * 999
    odd = ["", None, INNER, "\r\n" + INNER * 3, "x\r\nWARC/1.0\r\n\r\nWARC/1.", "\r\nWARC/1.", INNER + "\r\n" + copy, "\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 9999999\r\n\r\n", "a\r\n" * 200 + INNER, copy, copy, copy, edge, edge, short, short, "日本語" * 5000]
    odd += ["\r\n".join([INNER] * int(n)) + "z" * int(n) for n in draw.integers(1, 40, 25)]
    odd += ["p" * int(n) for n in draw.integers(0, 4000, 60)]
    out = [(i, f"http://h/{i}?a=b c\r\nWARC/1.0" if i % 3 else None, t, "clash", 1) for i, t in enumerate(odd)]
    # no id, and rows that repeat a page
    return out + [(None, None, copy, "clash", 1), (None, "u", "alone" * 300, "clash", 1), (11, "again", copy, "clash", 1), (11, "again", copy, "clash", 1), (-5, "", edge, "clash", 1)]


def expected(given, least=1000):
    most = defaultdict(list)
    for i, _, t, *_ in given:
        most[t or ""].append(i)
    out = []
    for i, _, t, *_ in given:
        raw = (t or "").encode()
        known = [x for x in most[t or ""] if x is not None]
        first = max(known) if known and len(raw) >= least else None
        again = first is not None and (i is None or i < first) and len(most[t or ""]) > 1
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


def plain_reader(raw):
    """(offset, type, block) of the records that follow one another from the first byte on."""
    at, out = 0, []
    while at < len(raw) and raw.startswith(b"WARC/1.", at):
        end = raw.index(b"\r\n\r\n", at)
        head = dict(x.split(b": ", 1) for x in raw[at:end].split(b"\r\n")[1:])
        n = int(head[b"Content-Length"])
        out.append((at, head[b"WARC-Type"].decode(), raw[end + 4 : end + 4 + n]))
        assert raw[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        at = end + 8 + n
    return out


@pytest.mark.parametrize("split", ["128m", "1000b", "97b"])
def test_round_trip(spark, split):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if split != "128m" else "4m")
    try:
        assert Counter(map(tuple, warc.round_trip(pages).collect())) == expected(rows())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_and_payloads(spark, tmp_path):
    folder = str(tmp_path / "archives")
    given = rows()
    warc.write_archives(spark.createDataFrame(given, SCHEMA).repartition(2), folder)
    files = {p.name: p.read_bytes() for p in Path(folder).glob("part-*")}
    want = {(name, at): (kind, block) for name, raw in files.items() for at, kind, block in plain_reader(raw)}
    assert len(want) == len(given)
    got = warc.read_archives(spark, folder, payload=True).collect()
    assert {(r.file.rsplit("/", 1)[1], r.offset): (r.record_type, bytes(r.payload)) for r in got} == {k: (kind, block.split(b"\r\n\r\n", 1)[1]) for k, (kind, block) in want.items()}
    report = warc.chain_report(spark, folder).collect()
    assert all(r.covered == r.bytes == len(files[r.file.rsplit("/", 1)[1]]) and r.records <= r.candidates for r in report) and sum(r.records for r in report) == len(given) < sum(r.candidates for r in report)


def test_other_archives(spark, tmp_path):
    """Members compressed one by one, records without HTTP, a damaged length, a file that is no archive."""
    made = [f"WARC/1.1\r\nWARC-Type: {k}\r\nContent-Type: {c}\r\nwarc-record-id: <urn:x:{i}>\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, (k, c, b) in enumerate([("warcinfo", "application/warc-fields", b"software: x\r\n"), ("resource", "image/png", bytes(range(256))), ("response", "application/http", b"HTTP/1.1 204 No\r\n\r\n")])]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    (tmp_path / "b.warc").write_bytes(made[0] + made[1].replace(b"256", b"250") + made[2])
    (tmp_path / "c.warc").write_bytes(b"text\r\n" + b"".join(made))
    got = warc.read_archives(spark, str(tmp_path), payload=True).collect()
    by_file = defaultdict(dict)
    for r in got:
        by_file[r.file.rsplit("/", 1)[1]][r.record_id] = bytes(r.payload)
    assert by_file == {"a.warc.gz": {"<urn:x:0>": b"software: x\r\n", "<urn:x:1>": bytes(range(256)), "<urn:x:2>": b""}, "b.warc": {"<urn:x:0>": b"software: x\r\n", "<urn:x:1>": bytes(range(250))}}
    report = {r.file.rsplit("/", 1)[1]: r for r in warc.chain_report(spark, str(tmp_path)).collect()}
    assert report["b.warc"].records == 2 and report["b.warc"].covered < report["b.warc"].bytes and report["c.warc"].records == 0


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
