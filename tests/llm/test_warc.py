import base64
import gzip
import hashlib
import os

import pytest

from shelfrank.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long"


def pages():
    bodies = ["same", None, "", "é漢", "long " * 50000, "x\r\n\r\nWARC/1.1\r\n"]
    rows = [(i, f"http://x/{i % 9}", bodies[i % 6] if i % 4 else f"own {i}") for i in range(80)]
    return rows + [(80, None, "no url"), (81, "http://a b\r\nWARC-Type: x", "bad url"), (None, "http://n", "same"), (None, None, None), (79, "http://x/7", "again"), (3, rows[3][1], rows[3][2])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA).repartition(4)


def brute(rows, least=0):
    last = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = last.get(h or "") if i is not None and len(b) >= least else None
        kind = ("response", None) if to is None or to == i else ("revisit", str(to))
        out.append((None if i is None else str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *kind))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows = pages()
    folder = warc.write_warc(frame(spark, rows), roll_bytes=600, min_bytes=least)
    got = warc.read_warc(spark, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows, least)
    texts = {(str(i), h or "") for i, _, h in rows}
    assert all((str(r.page_id), bytes(r.payload).decode()) in texts for r in got if r.record_type == "response")
    urls = {str(i): u for i, u, _ in rows}
    assert all(r.url == urls[r.page_id] for r in got if r.page_id and int(r.page_id) < 79)
    manifest = spark.read.parquet(f"{folder}/manifest").collect()
    assert sum(m.records for m in manifest) == len(rows) and len(manifest) > 8
    assert [m.records for m in manifest if m.bytes > 600 + 5000] == []


def test_files_are_plain_warc_and_the_same_every_time(spark):
    rows, seen = pages(), []
    for _ in range(2):
        folder = warc.write_warc(frame(spark, rows), roll_bytes=2000)
        path = folder.removeprefix("file://")
        names = sorted(f for f in os.listdir(path) if f.endswith(".warc.gz"))
        seen.append([open(f"{path}/{f}", "rb").read() for f in names])
        assert os.listdir(f"{path}/temporary") == []
    assert b"".join(seen[0]) == b"".join(seen[1])
    text = gzip.decompress(b"".join(seen[0]))
    at, order = 0, []
    while at < len(text):  # by the lengths in the headers alone
        head, _, _ = text[at:].partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        block = text[at + len(head) + 4 : at + len(head) + 4 + int(fields[b"Content-Length"])]
        assert fields[b"WARC-Block-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(block).digest())
        order.append(int(fields[b"Page"] or -1))
        at += len(head) + 4 + len(block)
        assert text[at : at + 4] == b"\r\n\r\n"
        at += 4
    assert order == sorted(order) and len(order) == len(rows)


def test_commit_can_be_repeated_and_ignores_strays(spark):
    folder = warc.write_warc(frame(spark, pages()))
    path = folder.removeprefix("file://")
    with open(f"{path}/temporary/lost-attempt", "wb") as out:
        out.write(b"half a record")
    warc.commit(spark, folder)
    assert warc.read_warc(spark, folder).count() == len(pages())
    name = next(f for f in os.listdir(path) if f.endswith(".warc.gz"))
    os.truncate(f"{path}/{name}", os.path.getsize(f"{path}/{name}") - 5)
    with pytest.raises(Exception, match="ends within a record|incorrect data|differs"):
        warc.read_warc(spark, folder).count()


def test_empty_table(spark):
    assert warc.read_warc(spark, warc.write_warc(frame(spark, []))).count() == 0
