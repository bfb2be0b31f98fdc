"""Fill-in-the-middle against plain Python, at frame sizes that put cuts, words, code points and sentinels across frames."""

import hashlib
import random
import re

import pytest
import zstandard

from landspark.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, size long, frames string, form string"


def brute(doc_id, text, rate=50, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text) if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def rows():
    rng = random.Random(3)
    letters = ["a", "é", "\U0001f600", " ", "\n", "\t", "<", "P>", "S", " ", "\x00", "<S", "<M"]
    out = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    return out + [(700, None), (701, ""), (None, "a b c d"), (702, "w" * 1000), (703, " " * 500), (704, "a b " * 3000), (5, "x y z"), (5, "x y z")]


@pytest.mark.parametrize("size", [3, 7, 64, infill.FRAME])
def test_outputs(spark, size):
    docs = spark.createDataFrame([(i, t, 1, 2, "f", "g") for i, t in rows()], SCHEMA).repartition(3)
    got = infill.texts(infill.infill(infill.store_frames(docs, size=size))).collect()
    wanted = sorted((str(i), *map(str, brute(i, t))) for i, t in rows())
    assert sorted((str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored))) for r in got) == wanted
    assert {w[2] for w in wanted} == {"plain", "psm", "spm"}


def test_digests_and_frames(spark):
    """Digests are those of the texts; an output's frames, one after the other, are one zstandard stream of it."""
    docs = spark.createDataFrame([(i, t, 1, 2, "f", "g") for i, t in rows()], SCHEMA)
    out = infill.infill(infill.store_frames(docs, size=50), rate=100, suffix_first=0)
    text = {(r.doc_id, r.output) for r in infill.texts(out).collect()}
    sha = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in infill.digests(out).collect()}
    assert sha == {(i, hashlib.sha256(brute_psm(i, t).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows()}
    for r in out.collect():
        whole = b"".join(zstandard.ZstdDecompressor().decompress(f.data) for f in r.frames)
        assert (r.doc_id, whole.decode()) in text
        assert [f.at for f in r.frames] == [sum(len(zstandard.ZstdDecompressor().decompress(g.data)) for g in r.frames[:k]) for k in range(len(r.frames))]


def brute_psm(doc_id, text):
    n, form, p, m, out, whole = brute(doc_id, text, rate=100)
    if form == "plain":
        return out
    return f"<P>{whole[:p]}<S>{whole[p + m:]}<M>{whole[p:p + m]}"


def test_only_cut_frames_are_opened():
    """A cut opens the frame that it falls into, whatever lies before it."""
    opened = []

    class Watched(infill._Frames):
        def open(self, k):
            opened.append(k)
            return super().open(k)

    press = zstandard.ZstdCompressor()
    parts = [b"ab cd ", b"efgh", b"ij kl", b" mn"]
    ends, frames, at, units, inside = [2, 5, 12, 15], [], 0, 0, False
    for p in parts:
        frames.append({"at": at, "chars": at, "units": units, "open": inside, "data": press.compress(p)})
        at, units, inside = at + len(p), sum(x < at + len(p) for x in ends), p[-1:] != b" "
    for k, end in enumerate(ends, 1):
        opened.clear()
        assert infill._cut(Watched(frames, at), [f["units"] for f in frames], k, 5, at) == (end, end)
        assert len(opened) == 1


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert infill.digests(infill.infill(infill.store_frames(none))).count() == 0
    assert infill.texts(infill.infill(infill.store_frames(none))).columns[-2:] == ["output", "restored"]
