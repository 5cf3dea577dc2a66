"""Media columns for ISO base media files: written as 8-bit frames, read by walking boxes and sample tables.

``pack_frames`` stores bytes as uncompressed 8-bit grey frames in an ISO media file. ``media_columns`` walks the
nested boxes of any such file, decodes the sample tables of its tracks, and the runs of movie fragments, and returns codec, duration and the byte ranges and
times of keyframes; no payload is decoded. ``payload_of`` joins the sample ranges back to the stored bytes.

Defined results: a null text is empty and is stored as one frame of spaces; a null or malformed file gives null
columns and a text in ``error``; the columns describe the first video track, or the first track where there is none, and ``tracks`` all of them; repeated rows
each keep their row; an empty table gives an empty result; columns of the input whose names the result needs are replaced.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.batches import map_texts

#: Fixed values of the format: boxes that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}
WIDTH, HEIGHT, TIMESCALE, FRAME_TICKS, KEY_EVERY = 16, 12, 24_000, 1_000, 24


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pack_frames(payload: bytes, key_every: int = KEY_EVERY) -> bytes:
    """An ISO media file of 16 x 12 frames with one byte for each sample point; every ``key_every``-th frame is marked as a sync sample."""
    frame = WIDTH * HEIGHT
    if not payload or len(payload) % frame:
        raise ValueError(f"the payload must be a positive multiple of {frame} bytes")
    n = len(payload) // frame
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    large = len(payload) + 8 >= 1 << 32
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    at, ticks = len(head) + len(mdat), n * FRAME_TICKS
    keys = np.arange(1, n + 1, key_every, dtype=">u4")
    entry = box(b"raw ", struct.pack(">6xHHHIIIHHIIIH32shH", 1, 0, 0, 0, 0, 0, WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1, b"\0" * 32, 40, 0xFFFF))
    stbl = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        full_box(b"stts", struct.pack(">III", 1, n, FRAME_TICKS)),
        full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        full_box(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
        full_box(b"stsz", struct.pack(">II", frame, n)),
        full_box(b"co64", struct.pack(">IQ", 1, at)),
    )
    trak = box(
        b"trak",
        full_box(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, ticks, 0, 0, 0, 0), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7, version=1),
        box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1),
            full_box(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"),
            box(b"minf", full_box(b"vmhd", struct.pack(">4H", 0, 0, 0, 0), flags=1), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), stbl),
        ),
    )
    moov = box(b"moov", full_box(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), MATRIX, b"\0" * 24, struct.pack(">I", 2), version=1), trak)
    return b"".join((head, mdat, payload, moov))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, first byte, first byte of the body, end) of every box, depth first; sizes 0 (to the end) and 1 (64 bits) included."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box ends early")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} has a wrong size")
        yield (*path, kind), start, body, start + size
        if kind in CONTAINERS:
            yield from walk(data, body, start + size, (*path, kind))
        start += size


def _table(data: bytes, at: int, end: int, kind: str, columns: int) -> np.ndarray:
    """A counted table of big-endian integers that starts with its number of rows."""
    n = struct.unpack_from(">I", data, at)[0]
    item = np.dtype(kind)
    if at + 4 + n * columns * item.itemsize > end:
        raise ValueError("a sample table ends early")
    return np.frombuffer(data, item, n * columns, at + 4).reshape(n, columns).astype(np.int64)


#: Fixed values of the format: flags of fragment headers and runs, and the bit of a sample's flags that says it is no sync sample.
BASE_GIVEN, DESCRIPTION, DURATION, SIZE, FLAGS, BASE_IS_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
RUN_OFFSET, RUN_FIRST_FLAGS, RUN_FIELDS = 0x1, 0x4, (0x100, 0x200, 0x400, 0x800)
NO_SYNC = 0x10000


def tracks(data: bytes) -> list[dict]:
    """For each track its codec, sizes and decoded sample tables (offset, size, start in ticks and sync flag of each sample)."""
    out: list[dict] = []
    fragments: list[dict] = []
    moof = after = 0
    defaults: dict[int, tuple[int, int, int]] = {}
    for path, start, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            out.append({})
        elif kind == b"trex":
            track, _, *rest = struct.unpack_from(">5I", data, at + 4)
            defaults[track] = tuple(rest)
        elif kind == b"moof":
            moof, after = start, start
        elif kind == b"tfhd":
            fragments.append(_fragment(data, at, moof, after, defaults))
        elif kind == b"tfdt" and fragments:
            fragments[-1]["time"] = struct.unpack_from(">Q" if data[at] == 1 else ">I", data, at + 4)[0]
        elif kind == b"trun" and fragments:
            after = _run(data, at, end, fragments[-1])
        elif out and b"trak" in path:
            _table_of(out[-1], kind, data, at, end)
    for t in out:
        _place(t)
        _append(t, [f for f in fragments if f["track"] == t.get("id")])
        if len(t["sizes"]) and (t["offsets"] + t["sizes"]).max() > len(data):
            raise ValueError("a sample lies behind the end")
    return out


def _table_of(t: dict, kind: bytes, data: bytes, at: int, end: int) -> None:
    """Read one box of a track."""
    if kind == b"tkhd":
        t["id"] = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
    elif kind == b"mdhd":
        long = data[at] == 1
        t["timescale"], t["ticks"] = struct.unpack_from(">IQ" if long else ">II", data, at + (20 if long else 12))
    elif kind == b"hdlr":
        t["handler"] = data[at + 8 : at + 12].decode("latin-1")
    elif kind == b"stsd" and struct.unpack_from(">I", data, at + 4)[0]:
        t["codec"] = data[at + 12 : at + 16].decode("latin-1")
        if t.get("handler") == "vide":
            t["width"], t["height"] = struct.unpack_from(">HH", data, at + 8 + 32)
    elif kind == b"stts":
        t["stts"] = _table(data, at + 4, end, ">u4", 2)
    elif kind == b"stss":
        t["stss"] = _table(data, at + 4, end, ">u4", 1)[:, 0]
    elif kind == b"stsc":
        t["stsc"] = _table(data, at + 4, end, ">u4", 3)
    elif kind == b"stco":
        t["chunks"] = _table(data, at + 4, end, ">u4", 1)[:, 0]
    elif kind == b"co64":
        t["chunks"] = _table(data, at + 4, end, ">u8", 1)[:, 0]
    elif kind == b"stsz":
        size, n = struct.unpack_from(">II", data, at + 4)
        t["sizes"] = np.full(n, size, np.int64) if size else _table(data, at + 8, end, ">u4", 1)[:, 0]
    elif kind == b"stz2":
        bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if bits == 4:
            raw = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
            t["sizes"] = np.stack([raw >> 4, raw & 15], axis=1).reshape(-1)[:n].astype(np.int64)
        else:
            t["sizes"] = np.frombuffer(data, f">u{bits // 8}", n, at + 12).astype(np.int64)


def _fragment(data: bytes, at: int, moof: int, after: int, defaults: dict) -> dict:
    """A track fragment's header: its track, the place its data start at, and its samples' defaults."""
    flags, track = struct.unpack_from(">II", data, at)
    flags &= 0xFFFFFF
    at += 8
    f = {"track": track, "base": moof if flags & BASE_IS_MOOF else after, "runs": [], "time": None}
    if flags & BASE_GIVEN:
        f["base"] = struct.unpack_from(">Q", data, at)[0]
        at += 8
    at += 4 * bool(flags & DESCRIPTION)
    values = list(defaults.get(track, (0, 0, 0)))
    for k, flag in enumerate((DURATION, SIZE, FLAGS)):
        if flags & flag:
            values[k] = struct.unpack_from(">I", data, at)[0]
            at += 4
    f["defaults"], f["next"] = tuple(values), f["base"]
    return f


def _run(data: bytes, at: int, end: int, f: dict) -> int:
    """Add a run's samples (offset, size, ticks, flags) to its fragment; returns the place after its last sample."""
    flags, n = struct.unpack_from(">II", data, at)
    flags &= 0xFFFFFF
    at += 8
    where, first_flags = f["next"], None
    if flags & RUN_OFFSET:
        where = f["base"] + struct.unpack_from(">i", data, at)[0]
        at += 4
    if flags & RUN_FIRST_FLAGS:
        first_flags = struct.unpack_from(">I", data, at)[0]
        at += 4
    given = [k for k, flag in enumerate(RUN_FIELDS) if flags & flag]
    if at + 4 * n * len(given) > end:
        raise ValueError("a run ends early")
    rows = np.frombuffer(data, ">u4", n * len(given), at).reshape(n, len(given)).astype(np.int64)
    ticks, sizes, own = (rows[:, given.index(k)] if k in given else np.full(n, f["defaults"][k], np.int64) for k in range(3))
    if first_flags is not None and n:
        own = np.concatenate([[first_flags], own[1:]])
    ends = where + np.cumsum(sizes)
    f["runs"].append((ends - sizes, sizes, ticks, own))
    f["next"] = int(ends[-1]) if n else where
    return f["next"]


def _place(t: dict) -> None:
    """Sample offsets from the chunk tables, start times from the time table, and which samples are sync samples."""
    sizes, chunks, runs = t.get("sizes", np.zeros(0, np.int64)), t.get("chunks", np.zeros(0, np.int64)), t.get("stsc", np.zeros((0, 3), np.int64))
    if len(sizes):
        if not len(chunks) or not len(runs):
            raise ValueError("samples without chunks")
        firsts = np.append(runs[:, 0], len(chunks) + 1)
        per_chunk = np.repeat(runs[:, 1], np.maximum(0, np.diff(firsts)))
        chunk_of = np.repeat(np.arange(len(per_chunk)), per_chunk)[: len(sizes)]
        if len(chunk_of) < len(sizes):
            raise ValueError("fewer samples in chunks than sizes")
        before = np.cumsum(sizes) - sizes
        first = np.searchsorted(chunk_of, np.arange(len(per_chunk)))
        base = before[np.minimum(first, len(sizes) - 1)]
        t["offsets"] = chunks[chunk_of] + before - base[chunk_of]
    else:
        t["offsets"] = sizes
    t["sizes"] = sizes
    t["keys"] = t["stss"] - 1 if "stss" in t else np.arange(len(sizes))
    if len(t["keys"]) and t["keys"].max() >= len(sizes):
        raise ValueError("a sync sample lies behind the last sample")
    steps = t.get("stts", np.zeros((0, 2), np.int64))
    ticks = np.repeat(steps[:, 1], steps[:, 0])
    if len(ticks) < len(sizes):
        raise ValueError("fewer sample times than sizes")
    ends = np.cumsum(ticks[: len(sizes)])
    t["starts"], t["end"] = ends - ticks[: len(sizes)], int(ends[-1]) if len(sizes) else None


def _append(t: dict, fragments: list[dict]) -> None:
    """Add the samples of a track's fragments, in file order."""
    for f in fragments:
        now = f["time"] if f["time"] is not None else t["end"] or 0
        for offsets, sizes, ticks, flags in f["runs"]:
            t["keys"] = np.concatenate([t["keys"], len(t["sizes"]) + np.flatnonzero(flags & NO_SYNC == 0)])
            t["offsets"], t["sizes"] = np.concatenate([t["offsets"], offsets]), np.concatenate([t["sizes"], sizes])
            t["starts"] = np.concatenate([t["starts"], now + np.cumsum(ticks) - ticks])
            now += int(ticks.sum())
        t["end"] = now


KEYFRAMES = "keyframes array<struct<sample:long,first_byte:long,n_bytes:long,seconds:double>>"
COLUMNS = f"codec string, width int, height int, duration double, n_samples long, {KEYFRAMES}, tracks array<struct<handler:string,codec:string,duration:double,n_samples:long,n_keyframes:long>>, payload binary, error string"
NAMES = ("codec", "width", "height", "duration", "n_samples", "keyframes", "tracks", "payload", "error")


def _duration(t: dict) -> float | None:
    """Seconds from the samples' times; of a track without samples what its header says."""
    ticks = t["end"] if t["end"] is not None else t.get("ticks")
    return ticks / t["timescale"] if t.get("timescale") and ticks is not None else None


def describe(data: bytes | None, payload: bool = False) -> dict:
    """The media columns of one file, taken from its first video track, or its first track."""
    if data is None:
        return {"error": "no file"}
    try:
        found = tracks(data)
        if not found:
            return {"error": "no track"}
        t = next((x for x in found if x.get("handler") == "vide"), found[0])
        keys, scale = t["keys"], t.get("timescale")
        out = {"codec": t.get("codec"), "width": t.get("width"), "height": t.get("height"), "n_samples": len(t["sizes"]), "duration": _duration(t)}
        columns = keys.tolist(), t["offsets"][keys].tolist(), t["sizes"][keys].tolist(), t["starts"][keys].tolist()
        out["keyframes"] = [{"sample": k, "first_byte": o, "n_bytes": s, "seconds": x / scale if scale else None} for k, o, s, x in zip(*columns)]
        out["tracks"] = [{"handler": x.get("handler"), "codec": x.get("codec"), "duration": _duration(x), "n_samples": len(x["sizes"]), "n_keyframes": len(x["keys"])} for x in found]
        if payload:
            out["payload"] = payload_of(data, t)
        return out
    except (ValueError, struct.error, IndexError) as e:
        return {"error": str(e)}


def payload_of(data: bytes, track: dict) -> bytes:
    """The stored bytes: the track's samples in order, runs that touch read as one."""
    offsets, sizes = track["offsets"], track["sizes"]
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts, ends = np.append(0, breaks)[: len(offsets)], np.append(breaks, len(offsets))
    return b"".join(data[offsets[a] : offsets[b - 1] + sizes[b - 1]] for a, b in zip(starts, ends) if b > a)


def pack_texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, filled up with spaces to whole frames, as an ISO media file."""
    frame = WIDTH * HEIGHT

    def pack(texts: list[str | None]) -> list:
        raw = [(t or "").encode() for t in texts]
        return [[len(b) for b in raw], [pack_frames(b.ljust(max(frame, -(-len(b) // frame) * frame), b" ")) for b in raw]]

    return map_texts(docs.select(id, text), text, "n_bytes long, media binary", lambda: pack)


def media_columns(files: DataFrame, media: str = "media", payload: bool = False) -> DataFrame:
    """The columns of ``files`` and codec, width, height, duration, n_samples, keyframes (sample number, first byte, length and time of each), tracks, error; with
    ``payload`` also the stored bytes. Columns of ``files`` with these names are replaced."""

    def read(found: list[bytes | None]) -> list:
        rows = [describe(b, payload) for b in found]
        return [[r.get(n) for r in rows] for n in NAMES]

    own = files.select(*[F.col(f"`{c}`") for c in files.columns if c == media or c not in NAMES])
    out = map_texts(own, media, COLUMNS, lambda: read, keep=True)
    return out if payload else out.drop("payload")
