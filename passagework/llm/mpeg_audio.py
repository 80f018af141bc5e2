"""A media column of MPEG audio: payloads stored as frames, and a resynchronising reader.

``store`` puts bytes into MPEG-1 layer III frames at 48 kHz, mono and with checksums,
whose bitrate changes: every other frame has 80 and 96 kbit/s (240 and 288 bytes). Each
has its header, its CRC-16, side information that claims no coded samples, ``UNIT``
payload bytes as ancillary data, and zeros. In front stand an ID3v2 tag with the
payload's unpadded length and a frame with the Xing table (frames, bytes, 100 seek points).

``read`` makes no use of that layout beyond the public format: it skips tags, looks for
frame headers that chain, goes on at the next such header after damage, reads Xing, Info
and VBRI tables, checks the CRC of all frames that have one, and gives exact durations
(samples over the rate, as a fraction) and the byte offset of every frame. Its time grows
with the bytes, however often the bitrate changes.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, sliced

UNIT = 192

# Fixed values of the format: kbit/s by index, samples a second, CRC-16.
KBITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
POLYNOMIAL = 0x8005


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, out << 1 ^ POLYNOMIAL, out << 1) & 0xFFFF
    return out


CRC = _crc_table()


_CRC = CRC.tolist()


@functools.lru_cache(maxsize=4096)
def crc16_of(data: bytes, bits: int | None = None) -> int:
    """The CRC-16 of the first ``bits`` bits (all)."""
    bits = 8 * len(data) if bits is None else bits
    crc = 0xFFFF
    for b in data[: bits // 8]:
        crc = (crc << 8 ^ _CRC[crc >> 8 ^ b]) & 0xFFFF
    for k in range(bits % 8):
        out = crc >> 15 ^ data[bits // 8] >> 7 - k & 1
        crc = (crc << 1 ^ POLYNOMIAL * out) & 0xFFFF
    return crc


def _widths(version: int, kbits: int, hertz: int) -> list[int]:
    """Allocation bits of each subband of layer II, by version, bitrate of a channel and rate."""
    if version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    if kbits <= 48:
        return [4] * 2 + [3] * (10 if hertz == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if kbits <= 80 or hertz == 48000 else 7)


def checksum_holds(frame: bytes, info: dict) -> bool:
    """Whether a guarded frame's CRC is right: it covers half the header, and of layer I
    the allocations, of layer II these and the scale factors' selectors, of layer III the
    side information. A frame too short for its own fields is wrong."""
    bits = info["guarded"]
    body = frame[6:]
    if info["layer"] == 2:
        word, at, used = int.from_bytes(body[:48].ljust(48, b"\0")), 0, 0
        for k, width in enumerate(info["widths"]):
            own = 1 if k >= info["bound"] else info["channels"]
            for _ in range(own):
                used += (word >> 384 - at - width & (1 << width) - 1 > 0) * (info["channels"] // own)
                at += width
        bits = at + 2 * used
    if 8 * len(body) < bits:
        return False
    return int.from_bytes(frame[4:6]) == crc16_of(frame[2:4] + body[: -(-bits // 8)], 16 + bits)


@functools.lru_cache(maxsize=4096)
def header(word: bytes) -> dict | None:
    """What four header bytes say, or None if they can't be a frame's."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    bitrate, rate = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or word[3] & 3 == 2:
        return None
    hertz = RATES[version][rate]
    kbits = KBITS[1 if version == 3 else 2, layer][bitrate - 1]
    padding, mono = word[2] >> 1 & 1, word[3] >> 6 == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12000 * kbits // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + padding
    side = ((17 if mono else 32) if version == 3 else (9 if mono else 17)) if layer == 3 else 0
    channels, bound = 1 if mono else 2, 4 * (word[3] >> 4 & 3) + 4 if word[3] >> 6 == 1 else 32
    guarded = 4 * (32 + (0 if mono else bound)) if layer == 1 else 8 * side
    widths = _widths(version, kbits // channels, hertz) if layer == 2 else []
    return {"version": version, "layer": layer, "hertz": hertz, "kbits": kbits, "samples": samples, "length": length, "channels": channels, "bound": bound, "widths": widths, "crc": not word[1] & 1, "side": side, "guarded": guarded, "kind": (version, layer, hertz)}


#: MPEG-1 layer III, 48 kHz, mono: guarded frames of 80 and 96 kbit/s, a plain one of 64.
FRAMES, TABLE = (b"\xff\xfa\x64\xc0", b"\xff\xfa\x74\xc0"), b"\xff\xfb\x54\xc0"
HEAD = 6 + 17


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def store(data: bytes) -> bytes:
    """The media bytes of a payload, which is padded by spaces to a positive multiple of ``UNIT``."""
    n = max(1, -(-len(data) // UNIT))
    payload = data.ljust(n * UNIT, b" ").ljust((n + n % 2) * UNIT, b"\0")
    units = np.frombuffer(payload, np.uint8).reshape(-1, len(FRAMES), UNIT)
    lengths = [header(f)["length"] for f in FRAMES]
    pairs, at = np.zeros((len(units), sum(lengths)), np.uint8), 0
    for k, frame in enumerate(FRAMES):
        side = bytes(header(frame)["side"])
        pairs[:, at : at + HEAD] = np.frombuffer(frame + crc16_of(frame[2:] + side).to_bytes(2) + side, np.uint8)
        pairs[:, at + HEAD : at + HEAD + UNIT] = units[:, k]
        at += lengths[k]
    front = header(TABLE)["length"]
    start = [front + k // 2 * at + k % 2 * lengths[0] for k in (*(n * p // 100 for p in range(100)), n)]
    size = start.pop()
    toc = bytes(256 * x // size for x in start)
    table = (TABLE + bytes(17) + b"Xing" + struct.pack(">III", 7, n, size) + toc).ljust(front, b"\0")
    text = b"\x03n_bytes\0" + str(len(data)).encode()
    tag = b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _syncsafe(len(tag)) + tag + table + pairs.tobytes()[: size - front]


def _tags(buf: bytes) -> tuple[dict, int, int]:
    """Text tags, where the audio starts and where it ends."""
    tags, start, end = {}, 0, len(buf)
    while buf[start : start + 3] == b"ID3" and start + 10 <= len(buf):
        size = sum((b & 0x7F) << s for b, s in zip(buf[start + 6 : start + 10], (21, 14, 7, 0), strict=True))
        at, stop, four = start + 10, min(len(buf), start + 10 + size), buf[start + 3] >= 4
        while at + 10 <= stop and buf[at : at + 4].isalnum():
            own = sum((b & 0x7F) << s for b, s in zip(buf[at + 4 : at + 8], (21, 14, 7, 0), strict=True)) if four else int.from_bytes(buf[at + 4 : at + 8])
            name, body = buf[at : at + 4].decode(), buf[at + 10 : min(stop, at + 10 + own)]
            if name[0] == "T" and body:
                text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3], "replace").strip("\0")
                key, _, value = text.partition("\0")
                tags[key if name == "TXXX" else name] = value if name == "TXXX" else text
            at += 10 + own
        start = stop + (10 if buf[start + 5] & 0x10 else 0)
    if end - start >= 128 and buf[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags.setdefault("TIT2", buf[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    if end - start >= 32 and buf[end - 32 : end - 24] == b"APETAGEX":
        end = max(start, end - int.from_bytes(buf[end - 20 : end - 16], "little"))
    return tags, start, end


def _table(frame: bytes, info: dict) -> dict | None:
    """A Xing, Info or VBRI table in a first frame."""
    at = 4 + info["side"]
    for skip in (0, 2):
        if frame[at + skip : at + skip + 4] in (b"Xing", b"Info"):
            body = frame[at + skip + 4 :]
            flags, k, out = int.from_bytes(body[:4]), 4, {"table": frame[at + skip : at + skip + 4].decode(), "frames": None, "bytes": None, "toc": []}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], k = int.from_bytes(body[k : k + 4]), k + 4
            out["toc"] = list(body[k : k + 100]) if flags & 4 else []
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", frame[46:62])
        raw = frame[62 : 62 + entries * width]
        toc = [int.from_bytes(raw[k : k + width]) * scale for k in range(0, len(raw), max(1, width))]
        return {"table": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def read(buf: bytes) -> dict:
    """Everything that ``buf`` says of itself; no bytes, or none that chain, give no frames."""
    tags, at, end = _tags(buf)
    out = {"tags": tags, "table": None, "resyncs": 0, "skipped": 0, "crc_ok": 0, "crc_bad": 0, "kbits": set(), "rates": set(), "samples": 0}
    duration, offsets, parts, locked, lost, first = Counter(), [], [], None, False, True
    info = header(buf[at : at + 4])
    while at + 4 <= end:
        stop = at + info["length"] if info else at
        follows = header(buf[stop : stop + 4]) if info else None
        if not info or stop > end or not (locked == info["kind"] or stop == end or follows and follows["kind"] == info["kind"]):
            out["resyncs"] += not lost
            lost, locked = True, None
            step = buf.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out["skipped"] += step - at
            at = step
            info = header(buf[at : at + 4])
            continue
        lost, locked = False, info["kind"]
        frame = buf[at:stop]
        table = _table(frame, info) if first else None
        first = False
        if table:
            out["table"] = table
        else:
            head = 4
            if info["crc"]:
                head = 6
                out["crc_ok" if checksum_holds(frame, info) else "crc_bad"] += 1
            out["kbits"].add(info["kbits"])
            duration[info["hertz"]] += info["samples"]
            offsets.append(at)
            parts.append(frame[head + info["side"] : head + info["side"] + UNIT])
            out["layer"], out["version"], out["channels"] = info["layer"], info["version"], info["channels"]
        at, info = stop, follows
    out["skipped"] += end - at if at < end else 0
    out["samples"], out["rates"] = sum(duration.values()), set(duration)
    out["offsets"], out["ancillary"] = np.array(offsets, np.int64), b"".join(parts)
    out["duration"] = sum((Fraction(n, hertz) for hertz, n in duration.items()), Fraction(0))
    return out


READ = (
    "doc_id long, ancillary binary, media_bytes long, media_sha256 string, tags map<string,string>, layer int, channels int, kbits array<int>, frames long, samples long,"
    "duration_num long, duration_den long, table string, table_frames long, table_bytes long, toc array<long>, crc_ok long, crc_bad long, resyncs long, skipped long, offsets array<long>"
)
_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.list_(pa.int64())]


def _row(buf: bytes) -> tuple:
    x = read(buf)
    t = x["table"] or {"table": None, "frames": None, "bytes": None, "toc": None}
    return (x["ancillary"], len(buf), hashlib.sha256(buf).hexdigest(), list(x["tags"].items()), x.get("layer"), x.get("channels"), sorted(x["kbits"]), len(x["offsets"]), x["samples"], x["duration"].numerator, x["duration"].denominator, t["table"], t["frames"], t["bytes"], t["toc"], x["crc_ok"], x["crc_bad"], x["resyncs"], x["skipped"], x["offsets"])


def _store_batches(batches):
    for batch in sliced(batches):
        data = [t.encode() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(map(store, data), pa.binary())], ["doc_id", "n_bytes", "media"])


def _read_batches(batches):
    names = [x.split()[0] for x in READ.replace("string,string", "s").split(",")]
    for batch in sliced(batches):
        columns = list(zip(*(_row(m or b"") for m in batch.column(1).to_pylist()), strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES[1:], strict=True))], [n.strip() for n in names])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text as UTF-8 in frames. A null text is the empty
    one, stored as one unit of spaces; repeated rows each have theirs."""
    return id_text(docs, id_col, text_col).mapInArrow(_store_batches, "doc_id long, n_bytes long, media binary")


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What each media value holds (see ``READ``). Null, empty or foreign bytes give a
    row with no frames; nothing raises on damage, which ``resyncs``, ``skipped`` and
    ``crc_bad`` count."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(_read_batches, READ)
