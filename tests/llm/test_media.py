"""Media columns: hand-made containers, round trips, and the query against plain Python."""

import hashlib
import struct
import zlib

from motorspark.llm import media

ODD = [None, "", "a", "x" * 64, "x" * 65, "é中😀\0 tail", "y" * 100_000, "y" * 100_000, "z" * 2_000_000]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind, *parts, version=0):
    return box(kind, bytes([version, 0, 0, 0]), *parts)


def trak(handler, codec, sizes, chunks, runs, keys, wide, compact=False):
    """A track with its samples in chunks at the given offsets."""
    at = full(b"co64" if wide else b"stco", struct.pack(f">I{len(chunks)}{'Q' if wide else 'I'}", len(chunks), *chunks))
    many = full(b"stz2", bytes(3), b"\x08", struct.pack(">I", len(sizes)), bytes(sizes)) if compact else full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes))
    table = [
        full(b"stsd", struct.pack(">I", 1), box(codec, bytes(8))), full(b"stts", struct.pack(">III", 1, len(sizes), 10)),
        full(b"stsc", struct.pack(f">I{3 * len(runs)}I", len(runs), *[x for r in runs for x in r])), many, at,
    ]
    if keys:
        table.append(full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)))
    head = full(b"mdhd", struct.pack(">QQIQI", 0, 0, 100, 10 * len(sizes), 0), version=1)
    return box(b"trak", box(b"mdia", head, full(b"hdlr", bytes(4), handler, bytes(12)), box(b"minf", box(b"stbl", *table))))


def test_several_tracks_uneven_chunks_and_wide_offsets():
    sound = trak(b"soun", b"mp4a", [5] * 4, [100, 200], [(1, 2, 1)], None, False)
    sizes = [10, 20, 30, 40, 50, 60]
    # Chunks of 1, 1, 3 and 1 samples.
    video = trak(b"vide", b"avc1", sizes, [1000, 2000, 3000, 4000], [(1, 1, 1), (3, 3, 1), (4, 1, 1)], [1, 3], True, compact=True)
    data = box(b"ftyp", b"isom") + box(b"free", b"junk") + box(b"moov", sound, video) + box(b"mdat", bytes(4000))
    got = media.media_row(data)
    assert got[:3] == ("avc1", "vide", 2) and got[3] == 0.6 and got[4:6] == (6, 2) and got[7] is None
    track = media.tracks(data)[1]
    assert track["offsets"].tolist() == [1000, 2000, 3000, 3030, 3070, 4000] and track["sizes"].tolist() == sizes
    # Between the chunks lie bytes of other tracks, so each run of samples is a range.
    assert got[6] == [{"offset": a, "length": n} for a, n in ((1000, 10), (2000, 20), (3000, 120), (4000, 60))]
    # Without a table of keyframes every sample is one.
    assert media.media_row(box(b"moov", sound) + box(b"mdat", bytes(300)))[4:6] == (4, 4)


def test_broken_containers():
    good = media.store(media.padded("some text")[1])
    reasons = {media.media_row(x)[7] for x in (None, b"", b"\0\0\0\xffmoov", good[: len(good) // 2])}
    assert None not in reasons and "no container" in reasons and "no track" in reasons
    for cut in range(0, len(good), 7):  # never anything but a reason
        media.media_row(good[:cut])
        media.media_row(good[:cut] + b"\xff" + good[cut + 1 :])


def test_containers_that_lie():
    def made(sizes=(10, 20), chunks=(600,), runs=((1, 2, 1),), keys=(1,)):
        return media.media_row(box(b"moov", trak(b"vide", b"avc1", list(sizes), list(chunks), list(runs), list(keys), True)) + box(b"mdat", bytes(2000)))

    assert made()[7] is None and made()[6] == [{"offset": 600, "length": 30}]
    assert made(keys=(2,))[6] == [{"offset": 610, "length": 20}]
    for bad in ({"keys": (0,)}, {"keys": (2, 1)}, {"keys": (1, 1)}, {"keys": (3,)}):
        assert made(**bad)[7] == "keyframes aren't ascending samples"
    for bad in ({"chunks": (2**31 - 1,)}, {"chunks": (2**63 + 5,)}, {"chunks": (2600,)}, {"sizes": (10, 2**32 - 1)}):
        assert made(**bad)[7] == "a sample lies outside the file"
    for bad in (((2, 2, 1),), ((1, 1, 1), (1, 1, 1)), ((1, 1, 1), (3, 1, 1))):
        assert made(runs=bad)[7] == "the runs of chunks aren't ascending"
    nested = b""
    for _ in range(3000):
        nested = box(b"moov", nested)
    assert media.media_row(nested)[7] == "boxes are nested too deep"


def test_columns_keep_the_others(spark):
    data = bytearray(media.store(media.padded("abc")[1]))
    df = spark.createDataFrame([(1, data, "mine", "gone"), (2, None, "mine", "gone")], "k long, f binary, n_bytes string, codec string")
    got = {r["k"]: r for r in media.media_columns(df, "f").collect()}
    assert got[1]["codec"] == "md8g" and got[1]["n_bytes"] == "mine" and got[2]["codec"] is None and got[2]["media_error"] == "no container"
    assert media.media_columns(df.where("false"), "f").count() == 0


def test_query_equals_plain_python(spark, tmp_path):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(ODD)] + [(None, "no id", "clash", "clash"), (2, "a", "clash", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string, n_bytes string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        whole = raw + bytes(-len(raw) % 64 if raw else 64)
        data = media.store(whole)
        want.append((str(i), len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]), len(data), hashlib.sha256(data).hexdigest()))
    got = media.op2_media_columns(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), *r[1:7]) for r in got) == sorted(want)
    n = {r["payload_bytes"]: r["feature"] for r in got}[100_032]
    assert n.startswith("codec=md8g;frames=1563;seconds=62.52;keyframes=98;")
    df.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert media.op2_media_columns(spark, f"{tmp_path}/none").count() == 0
