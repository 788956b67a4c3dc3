"""Media columns against an independent reading of what was stored."""

import hashlib
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from codeweft.llm.media import WIDTH, Range, feature, from_png, load_media, padded, plan_ranges, read_range, store_media, to_png
from codeweft.llm.queries import QUERIES

r = random.Random(3)
TEXTS = [None, "", "a", "é" * 400, "x" * WIDTH, "y" * (WIDTH + 1), "a", *["".join(r.choices("abcdefg \n", k=r.randrange(3000))) for _ in range(20)], "long " * 120_000]
ROWS = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)] + [(7, "again")]


def samples_of(png):
    """Payload of a greyscale PNG, read by the format's description."""
    at, body = 8, b""
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        if kind == b"IHDR":
            width, height, *_ = struct.unpack(">IIBBBBB", png[at + 8 : at + 8 + size])
        body += png[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    raw = zlib.decompress(body)
    return b"".join(raw[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))


def plain_feature(payload):
    n, total = len(payload), sum(payload)
    size = n // 64
    bits = "".join("1" if sum(payload[k * size : (k + 1) * size]) * n >= total * size else "0" for k in range(64))
    return f"{n // WIDTH}x{WIDTH}:{int(bits, 2):016x}:{total // n}:{min(payload)}:{max(payload)}"


def test_query(spark, tmp_path):
    docs = spark.createDataFrame([(*row, "m", 0) for row in ROWS], "doc_id long, text string, media string, payload int").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(x) for x in QUERIES["op12_media_columns"](spark, str(tmp_path)).drop("media_bytes", "media_sha256").fillna(-1).collect())
    want = []
    for ident, text in ROWS:
        data = (text or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        want.append((-1 if ident is None else ident, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), plain_feature(payload)))
    assert got == sorted(want)


def test_stored_forms_are_images(spark, tmp_path):
    path = f"{tmp_path}/archives"
    store_media(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2), path, archiveBytes=2000)
    assert len(list(tmp_path.glob("archives/*.zip"))) > 4  # archives of bounded size
    got = load_media(spark, path, rangeBytes=700, batchBytes=1000).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_bytes) for x in got) == sorted((i is None, i or 0, len((t or "").encode())) for i, t in ROWS)
    for row in got:
        assert samples_of(bytes(row.media)) == bytes(row.payload) and row.error is None
    with zipfile.ZipFile(f"{path}/{got[0].archive}") as archive:
        assert archive.testzip() is None
    equal = {bytes(x.media) for x in got if x.doc_id in (2, 6)}
    assert len(equal) == 1
    # Written again: added once, and archives that no manifest names don't count.
    store_media(spark.createDataFrame([(99, "more")], "doc_id long, text string"), path)
    (tmp_path / "archives/part-lost.zip").write_bytes((tmp_path / "archives" / got[0].archive).read_bytes())
    assert load_media(spark, path).count() == len(ROWS) + 1


def test_damaged_member(spark, tmp_path):
    path = f"{tmp_path}/archives"
    store_media(spark.createDataFrame(ROWS[:10], "doc_id long, text string").coalesce(1), path)
    (file,) = tmp_path.glob("archives/*.zip")
    hurt = zipfile.ZipFile(file).infolist()[5]
    data = bytearray(file.read_bytes())
    data[hurt.header_offset + 60] ^= 1
    file.write_bytes(bytes(data))
    got = load_media(spark, path, failures="rows", attempts=2).collect()
    assert [x.doc_id for x in got if x.error] == [5] and len(got) == 10
    assert all(x.payload is None and x.n_bytes == len(TEXTS[5]) for x in got if x.error)
    with pytest.raises(Exception, match="checksum"):
        load_media(spark, path).collect()


class Flaky(io.BytesIO):
    """Fails the first ``failures`` reads at a place."""

    left: dict = {}
    log: list = []

    def read(self, *size):
        at = self.tell()
        Flaky.log.append(at)
        if Flaky.left.get(at, 0) > 0:
            Flaky.left[at] -= 1
            raise OSError("gone for a moment")
        return super().read(*size)


def test_members_are_tried_again_by_offset():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for k in range(6):
            info = zipfile.ZipInfo(f"{k}.png")
            info.comment = f"{k}:1".encode()
            archive.writestr(info, to_png(padded(b"%d" % k)))
    places = [i.header_offset for i in zipfile.ZipFile(out).infolist()]
    Flaky.left, Flaky.log = {places[2]: 2, places[4]: 5}, []
    rows = list(read_range(Range("a", 0, 1 << 20), lambda name: Flaky(out.getvalue()), attempts=3, pause=0))
    assert [(x[0], x[7]) for x in rows] == [(0, None), (1, None), (2, None), (3, None), (4, "OSError: gone for a moment"), (5, None)]
    # Each try begins at the member that failed; the others were read once.
    assert [Flaky.log.count(p) for p in places] == [1, 1, 3, 1, 3, 1]


def test_ranges_and_rows():
    ranges = plan_ranges([("a", 10, 1), ("b", 25, 3), ("c", 0, 0)], 10)
    assert [(x.archive, x.begin, x.end) for x in ranges] == [("a", 0, 10), ("b", 0, 10), ("b", 10, 20), ("b", 20, 30)]
    for size in (0, 1, 575, 576, 577, 5000):
        payload = padded(bytes(i % 251 for i in range(size)))
        assert len(payload) % 576 == 0 and len(payload) >= 576
        assert from_png(to_png(payload)).tobytes() == payload and feature(from_png(to_png(payload))) == plain_feature(payload)
    with pytest.raises(ValueError):
        from_png(b"GIF89a")
    with pytest.raises(ValueError):
        from_png(to_png(padded(b"x"))[:-20])
    assert np.array_equal(from_png(to_png(padded(b""))), np.full((1, WIDTH), 255))


def test_empty_table(spark, tmp_path):
    store_media(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none")
    assert load_media(spark, f"{tmp_path}/none").collect() == []
