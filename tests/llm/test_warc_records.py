"""Archives read by an independent reader: gzip and plain line parsing, no code of the operator."""

import glob
import gzip
import hashlib
import json
import re
import zlib

from landspark.llm import warc


def records(data):
    """(header fields, block) of the records of an inflated archive, by the format's own rules."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = {}
        for line in lines[1:]:
            name, value = line.split(": ", 1)
            assert name not in fields
            fields[name] = value
        n = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + n]
        assert data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        at = end + 8 + n


def test_records_are_valid(spark, tmp_path):
    long = "<p>é" + "x" * 400_000
    same = "<p>" + "same " * 40
    rows = [(1, "http://a.test/1", same), (2, "http://a.test/2 \r\nWARC-Type: metadata", same), (3, None, None), (4, "", "short"), (5, "http://a.test/ü", long), (7, "u", "short"), (None, "v", "no id"), (1, "w", same), (9, "x", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    top = f"file://{tmp_path}"
    written = warc.write_archives(warc.record_types(df), f"{top}/one", date="2026-01-02T03:04:05Z")
    normal = warc.normalise(written, f"{top}/one", f"{top}/each")
    got = []
    for path in glob.glob(f"{tmp_path}/each/*.warc.gz"):
        raw = open(path, "rb").read()
        index = [json.loads(x) for x in open(f"{path}.idx")]
        assert [x["offset"] for x in index] == [sum(y["length"] for y in index[:k]) for k in range(len(index))]
        for x in index:  # a member of its own
            press = zlib.decompressobj(31)
            one = press.decompress(raw[x["offset"] : x["offset"] + x["length"]])
            assert press.eof and len(list(records(one))) == 1
        got += records(gzip.decompress(raw))
    assert len(got) == len(rows)
    payloads = {(i, hashlib.sha256((h or "").encode()).hexdigest()): (h or "").encode() for i, _, h in rows}
    ids = set()
    for fields, block in got:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Target-URI"} <= set(fields)
        assert fields["WARC-Date"] == "2026-01-02T03:04:05Z" and re.fullmatch(r"[!-~]+", fields["WARC-Target-URI"])
        page = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
        page = int(page) if page else None
        payload = payloads[page, fields["WARC-Payload-Digest"].removeprefix("sha256:")]
        head, _, body = block.partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200") and b"Content-Length: %d" % len(payload) in head
        if fields["WARC-Type"] == "revisit":
            assert body == b"" and len(payload) >= warc.LEAST and fields["WARC-Profile"].endswith("identical-payload-digest")
            ids.add((page, fields["WARC-Refers-To"]))
        else:
            assert fields["WARC-Type"] == "response" and body == payload
    assert ids == {(2, "<urn:page:1>"), (9, "<urn:page:5>")}
    back = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(normal, f"{top}/each").collect()}
    assert back == {(1, "response", None, len(same)), (2, "revisit", 1, len(same)), (3, "response", None, 0), (4, "response", None, 5), (5, "response", None, len(long.encode())), (7, "response", None, 5), (None, "response", None, 5), (9, "revisit", 5, len(long.encode()))}
    empty = warc.archive_pages(spark, df.limit(0))
    assert empty.count() == 0
