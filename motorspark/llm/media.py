"""Media columns: ISO media containers as columns of a table.

``media_columns`` walks the nested boxes of a file held in a binary column,
decodes the sample tables and gives codec, duration and the byte ranges that
start at a keyframe; payloads are not decoded. ``stored`` keeps texts
losslessly in such containers: 8-bit grey frames of 8 x 8, a keyframe every
``GOP`` frames, the others as differences from the one before. ``payload``
reads them back by the byte ranges.

Not read: fragments (``moof``), composition offsets (``ctts``) and edit lists
(``elst``). A fragmented file has a track without samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorspark.llm._io import documents, with_columns

FRAME, SIDE, GOP, TIMESCALE, CODEC = 64, 8, 16, 25, b"md8g"
#: Boxes that hold boxes only (ISO/IEC 14496-12).
#: Boxes that hold boxes, and how many may be open at once.
DEEPEST = 32
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def store(payload: bytes) -> bytes:
    """A container that holds ``payload``, whose length is a multiple of FRAME."""
    frames = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    coded = frames.copy()
    coded[1:] -= frames[:-1]
    coded[::GOP] = frames[::GOP]
    n = len(frames)
    keys = np.arange(1, n + 1, GOP, dtype=">u4")
    chunks = -(-n // GOP)
    last = n - (chunks - 1) * GOP
    entry = _box(
        CODEC, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1),
        bytes(32), struct.pack(">Hh", 8, -1),
    )
    runs = [(1, GOP, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != GOP)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")

    def moov(base: int, wide: bool) -> bytes:
        at = base + np.arange(chunks, dtype=np.uint64) * (GOP * FRAME)
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = _box(
            b"minf", _full(b"vmhd", bytes(8), flags=1),
            _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table,
        )
        mdia = _box(
            b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"vide", bytes(12), b"grey\0"), minf,
        )
        trak = _box(
            b"trak",
            _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3),
            mdia,
        )
        head = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", head, trak)

    wide = len(payload) + 4096 * 16 + 64 * chunks > 0xFFFFFFFF
    mdat_head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    base = len(ftyp) + len(moov(0, wide)) + len(mdat_head)
    return b"".join((ftyp, moov(base, wide), mdat_head, coded.tobytes()))


def boxes(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(path, start, end) of the body of every box, parents first; broken sizes and boxes nested deeper than DEEPEST raise ValueError."""
    open_ = [(0, len(data), "")]  # what is left of the boxes that are open
    while open_:
        start, end, path = open_.pop()
        if start == end:
            continue
        if end - start < 8:
            raise ValueError("a box is cut short")
        length, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if length == 1:
            if end - start < 16:
                raise ValueError("a box is cut short")
            length, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif length == 0:
            length = end - start
        if length < head or start + length > end:
            raise ValueError("a box reaches past its parent")
        here = f"{path}/{kind.decode('latin-1')}"
        yield here, start + head, start + length
        open_.append((start + length, end, path))
        if kind in NESTED:
            if len(open_) >= DEEPEST:
                raise ValueError("boxes are nested too deep")
            open_.append((start + head, start + length, here))


def _numbers(data: bytes, start: int, end: int, kind: str, width: int = 1) -> np.ndarray:
    """The entries of a counted table that starts at its count."""
    count = struct.unpack_from(">I", data, start)[0]
    size = np.dtype(kind).itemsize * width
    if start + 4 + count * size > end:
        raise ValueError("a table reaches past its box")
    return np.frombuffer(data, kind, count * width, start + 4).astype(np.int64).reshape(count, width)


def _small_sizes(data: bytes, a: int, b: int) -> np.ndarray:
    """The sizes of a compact table: 4, 8 or 16 bits each."""
    bits, count = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
    if bits not in (4, 8, 16) or a + 12 + -(-count * bits // 8) > b:
        raise ValueError("a table reaches past its box")
    if bits == 16:
        return np.frombuffer(data, ">u2", count, a + 12).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, -(-count * bits // 8), a + 12)
    return (raw if bits == 8 else np.stack((raw >> 4, raw & 15), 1).ravel()[:count]).astype(np.int64)


def tracks(data: bytes) -> list[dict]:
    """For each track: codec, handler, timescale, duration, sample offsets, sizes and keyframes (from 0)."""
    found: list[dict] = []
    for path, a, b in boxes(data):
        name = path[-4:]
        if path == "/moov/trak":
            found.append({})
        elif found and path.startswith("/moov/trak/"):
            t = found[-1]
            if name == "mdhd":
                long = data[a] == 1
                t["timescale"], t["duration"] = struct.unpack_from(">IQ" if long else ">II", data, a + (20 if long else 12))
            elif name == "hdlr":
                t["handler"] = data[a + 8 : a + 12].decode("latin-1")
            elif name == "stsd":
                t["codec"] = data[a + 12 : a + 16].decode("latin-1")
            elif name == "stts":
                t["times"] = _numbers(data, a + 4, b, ">u4", 2)
            elif name == "stss":
                t["keys"] = _numbers(data, a + 4, b, ">u4")[:, 0] - 1
            elif name == "stsc":
                t["runs"] = _numbers(data, a + 4, b, ">u4", 3)
            elif name in ("stco", "co64"):
                t["chunks"] = _numbers(data, a + 4, b, ">u4" if name == "stco" else ">u8")[:, 0]
            elif name == "stsz":
                fixed, count = struct.unpack_from(">II", data, a + 4)
                if fixed * count > len(data):
                    raise ValueError("a track reaches past the file")
                t["sizes"] = np.full(count, fixed, np.int64) if fixed else _numbers(data, a + 8, b, ">u4")[:, 0]
            elif name == "stz2":
                t["sizes"] = _small_sizes(data, a, b)
    for t in found:
        sizes, chunks, runs = t.get("sizes", np.zeros(0, np.int64)), t.get("chunks", np.zeros(0, np.int64)), t.get("runs", np.zeros((0, 3), np.int64))
        per = np.zeros(0, np.int64)
        if len(chunks) and len(runs):
            lengths = np.diff(np.append(runs[:, 0] - 1, len(chunks)))
            if runs[0, 0] != 1 or (lengths <= 0).any():
                raise ValueError("the runs of chunks aren't ascending")
            per = np.repeat(runs[:, 1], lengths)
        if per.sum() != len(sizes):
            raise ValueError("the sample tables disagree")
        starts = np.cumsum(sizes) - sizes
        first = np.minimum(np.cumsum(per) - per, max(len(sizes) - 1, 0))
        t["sizes"] = sizes
        t["offsets"] = starts + np.repeat(chunks - (starts[first] if len(sizes) else 0), per)
        if len(sizes) and (t["offsets"].min() < 0 or (t["offsets"] > len(data) - sizes).any()):
            raise ValueError("a sample lies outside the file")
        t["keys"] = t.get("keys", np.arange(len(sizes)))
        if len(t["keys"]) and (t["keys"][0] < 0 or t["keys"][-1] >= len(sizes) or (np.diff(t["keys"]) <= 0).any()):
            raise ValueError("keyframes aren't ascending samples")
    return found


def keyframe_ranges(track: dict) -> np.ndarray:
    """(offset, length) of the bytes from each keyframe up to the next; one for each run of samples that lie together."""
    keys, offsets, sizes = track["keys"], track["offsets"], track["sizes"]
    if not len(keys):
        return np.zeros((0, 2), np.int64)
    begins = np.concatenate(([True], offsets[1:] != offsets[:-1] + sizes[:-1]))
    begins[keys] = True
    # Samples before the first keyframe belong to none.
    at = np.flatnonzero(begins & (np.arange(len(sizes)) >= keys[0]))
    last = np.append(at[1:], len(sizes)) - 1
    return np.stack([offsets[at], offsets[last] + sizes[last] - offsets[at]], 1)


def payload(data: bytes, spans: np.ndarray) -> bytes:
    """The bytes stored in the frames at the ranges (offset, length) of ``data``, each range from a keyframe to the next."""
    raw = np.frombuffer(data, np.uint8)
    coded = np.concatenate([raw[:0], *(raw[a : a + n] for a, n in spans)])
    frames = coded.reshape(-1, FRAME)
    # Frames of a group are running sums, modulo 256, from its keyframe on.
    whole = len(frames) // GOP * GOP
    parts = [np.cumsum(frames[:whole].reshape(-1, GOP, FRAME), 1, dtype=np.uint8).reshape(-1, FRAME), np.cumsum(frames[whole:], 0, dtype=np.uint8)]
    return np.concatenate(parts).tobytes()


MEDIA_SCHEMA = "codec string, handler string, n_tracks long, duration_s double, n_samples long, n_keyframes long, keyframes array<struct<offset:long,length:long>>, media_error string"


def media_row(data: bytes | None) -> tuple:
    """The media columns of one container: of its first video track, or its first track without one."""
    try:
        if data is None:
            raise ValueError("no container")
        if not (found := tracks(data)):
            raise ValueError("no track")
        t = next((t for t in found if t.get("handler") == "vide"), found[0])
        spans = keyframe_ranges(t)
        seconds = t["duration"] / t["timescale"] if t.get("timescale") else None
        keyframes = [{"offset": int(a), "length": int(n)} for a, n in spans]
        return t.get("codec"), t.get("handler"), len(found), seconds, len(t["offsets"]), len(t["keys"]), keyframes, None
    except (ValueError, IndexError, OverflowError, struct.error) as e:
        return None, None, None, None, None, None, None, str(e)


def media_columns(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the media columns of the container in the binary ``column``.

    Null or broken containers give null columns and a reason in
    ``media_error``; a container without tracks has the reason ``no track``.
    Columns of ``df`` with the names of media columns are replaced; all others
    stay. Rows are independent: repeated rows and empty tables need no care.
    """
    kinds = [
        pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(),
        pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])), pa.string(),
    ]

    def scan(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [media_row(None if data is None else bytes(data)) for data in batch.column(column).to_pylist()]
        return [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)]

    return with_columns(df, MEDIA_SCHEMA, scan)


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 text, and its bytes with zeros up to a positive multiple of FRAME."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


def stored(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` of the text and the container ``media`` that holds it; a null or empty text is one frame of zeros."""

    def keep(batch: pa.RecordBatch) -> list[pa.Array]:
        made = [padded(text) for text in batch.column(column).to_pylist()]
        return [pa.array([n for n, _ in made], pa.int64()), pa.array([store(p) for _, p in made], pa.binary())]

    return with_columns(docs, "n_bytes long, media binary", keep)


DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored in a container, the containers' media columns, and the payload read back by them.

    ``feature``: codec, frames, duration, keyframes, and the first and last
    range that starts at a keyframe. A null or empty text is one frame of
    zeros. Repeated rows and ids come back each; an empty table stays empty.
    """

    def digest(batch: pa.RecordBatch) -> list[pa.Array]:
        out: list[tuple] = []
        for data, ranges in zip(batch.column("media").to_pylist(), batch.column("keyframes").to_pylist(), strict=True):
            back = payload(data, [(r["offset"], r["length"]) for r in ranges])
            out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(data), hashlib.sha256(data).hexdigest()))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 5, kinds, strict=True)]

    docs = documents(spark, sf_dir).select("doc_id", "text")
    read = with_columns(media_columns(stored(docs).drop("text"), "media"), DIGESTS, digest)
    first, last = F.get("keyframes", F.lit(0)), F.get("keyframes", F.size("keyframes") - 1)
    feature = F.format_string(
        "codec=%s;frames=%d;seconds=%.2f;keyframes=%d;first=%d+%d;last=%d+%d", "codec", "n_samples", "duration_s", "n_keyframes",
        first["offset"], first["length"], last["offset"], last["length"],
    )
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
