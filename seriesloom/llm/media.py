"""Media columns: Aho-Corasick finds magic bytes, validators confirm structure and length, embedded media is carved.

`sniff` corrects declared types; `store_wav` keeps any bytes losslessly as 8-bit mono samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices

# Magic bytes by format, as their specifications give them.
MAGIC = {
    b"RIFF": "wav",
    b"\x89PNG\r\n\x1a\n": "png",
    b"GIF87a": "gif",
    b"GIF89a": "gif",
    b"\xff\xd8\xff": "jpeg",
    b"BM": "bmp",
    b"%PDF-": "pdf",
    b"fLaC": "flac",
    b"OggS": "ogg",
    b"PK\x03\x04": "zip",
    b"\x1f\x8b\x08": "gzip",
}
TYPES = {"wav": "audio/wav", "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "pdf": "application/pdf", "flac": "audio/flac", "ogg": "audio/ogg", "zip": "application/zip", "gzip": "application/gzip"}


def _wav(b: bytes, at: int) -> int:
    """Length of a well-formed RIFF WAVE file at `at`; 0 if there is none. The others alike."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end, pos, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    if end > len(b):
        return 0
    while pos + 8 <= end:
        seen.add(b[pos : pos + 4])
        pos += 8 + (n := struct.unpack_from("<I", b, pos + 4)[0]) + n % 2
    return end - at if pos == end and {b"fmt ", b"data"} <= seen else 0


def _png(b: bytes, at: int) -> int:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I", b, pos)[0], b[pos + 4 : pos + 8]
        if pos + 12 + n > len(b) or (first and kind != b"IHDR") or zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return 0
        pos, first = pos + 12 + n, False
        if kind == b"IEND":
            return pos - at
    return 0


def _gif(b: bytes, at: int) -> int:
    def blocks(pos: int) -> int:
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        return pos + 1

    if len(b) < at + 13:
        return 0
    flags = b[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            flags = b[pos + 9]
            pos = blocks(pos + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    pos, frame = at + 2, False
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        kind, n = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2:
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        pos += 2 + n
        if kind == 0xDA:
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b):
                if b[pos + 1] == 0xD9:
                    return pos + 2 - at if frame else 0
                if b[pos + 1] != 0 and not 0xD0 <= b[pos + 1] <= 0xD7:
                    break
                pos += 2
            if pos < 0:
                return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 54:
        return 0
    n, _, start, head, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if head not in (40, 52, 56, 108, 124) or not 14 + head <= start <= n <= len(b) - at or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return 0
    if packed in (0, 3, 6):  # rows of whole 4-byte words, the file at most padded to one
        return n if 0 <= n - start - (width * bits + 31) // 32 * 4 * abs(height) < 4 else 0
    return n if packed in (1, 2, 4, 5) and 0 < struct.unpack_from("<I", b, at + 34)[0] <= n - start else 0


def _pdf(b: bytes, at: int) -> int:
    end = b.find(b"%%EOF", at)
    return end + 5 - at if end >= 0 and b.find(b"startxref", at, end) >= 0 else 0


def _zip(b: bytes, at: int) -> int:
    """The end record that agrees with a central directory whose entries are there and point to entries of the file."""
    end = at
    while (end := b.find(b"PK\x05\x06", end + 1)) >= 0 and end + 22 <= len(b):
        disk, first, here, total, size, offset, comment = struct.unpack_from("<HHHHIIH", b, end + 4)
        pos, n = at + offset, 0
        if disk or first or here != total or not total or pos + size != end or end + 22 + comment > len(b):
            continue
        while pos + 46 <= end and b[pos : pos + 4] == b"PK\x01\x02":
            name, extra, note = struct.unpack_from("<HHH", b, pos + 28)
            local = at + struct.unpack_from("<I", b, pos + 42)[0]
            if b[local : local + 4] != b"PK\x03\x04":
                break
            pos, n = pos + 46 + name + extra + note, n + 1
        if pos == end and n == total:
            return end + 22 + comment - at
    return 0


def _gzip(b: bytes, at: int) -> int:
    """One member, read to its trailer, whose sum and length zlib checks; what comes out is not kept."""
    d, pos = zlib.decompressobj(31), at
    try:
        while not d.eof:
            chunk = d.unconsumed_tail or b[pos : pos + 65536]
            if not chunk:
                return 0
            pos += 0 if d.unconsumed_tail else len(chunk)
            d.decompress(chunk, 1 << 20)
    except zlib.error:
        return 0
    return pos - len(d.unused_data) - at


def _crc_table(bits: int, poly: int) -> list[int]:
    """Of sums that take the highest bit first."""
    top, out = 1 << bits - 1, []
    for i in range(256):
        c = i << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & (top << 1) - 1
        out.append(c)
    return out


_CRC8, _CRC16, _CRC32 = _crc_table(8, 0x07), _crc_table(16, 0x8005), _crc_table(32, 0x04C11DB7)


def _ogg(b: bytes, at: int) -> int:
    """Pages from a first one to a last one, each with its sum."""
    pos, first = at, True
    while pos + 27 <= len(b) and b[pos : pos + 5] == b"OggS\0":
        flags, n = b[pos + 5], b[pos + 26]
        end = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if end > len(b) or first != bool(flags & 2):
            return 0
        crc = 0
        for x in b[pos : pos + 22] + b"\0\0\0\0" + b[pos + 26 : end]:
            crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC32[crc >> 24 ^ x]
        if crc != struct.unpack_from("<I", b, pos + 22)[0]:
            return 0
        pos, first = end, False
        if flags & 4:
            return pos - at
    return 0


def _flac_header(b: bytes, pos: int) -> tuple[int, int]:
    """Length of a frame's header at pos and its number of samples; 0, 0 if its sum does not hold."""
    if len(b) < pos + 6 or b[pos] != 0xFF or b[pos + 1] & 0xFE != 0xF8:
        return 0, 0
    size, rate, lead = b[pos + 2] >> 4, b[pos + 2] & 15, b[pos + 4]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    at = pos + 5 + more
    end = at + {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if size == 0 or rate == 15 or end >= len(b):
        return 0, 0
    crc = 0
    for x in b[pos:end]:
        crc = _CRC8[crc ^ x]
    if crc != b[end]:
        return 0, 0
    if size in (6, 7):
        return end + 1 - pos, int.from_bytes(b[at : at + size - 5], "big") + 1
    return end + 1 - pos, 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8


def _flac(b: bytes, at: int) -> int:
    """Metadata, then as many frames as the stream's samples need, each with the sums of its header and of itself."""
    pos, last = at + 4, False
    if len(b) < at + 42 or b[pos] & 127 or b[pos + 1 : pos + 4] != b"\0\0\x22":
        return 0
    left = int.from_bytes(b[pos + 17 : pos + 22], "big") & (1 << 36) - 1
    if not left:  # of unknown length: structure can't be confirmed
        return 0
    while not last:
        if pos + 4 > len(b):
            return 0
        last, pos = bool(b[pos] & 128), pos + 4 + int.from_bytes(b[pos + 1 : pos + 4], "big")
    while left > 0:
        head, samples = _flac_header(b, pos)
        if not head:
            return 0
        left -= samples
        crc, end = 0, pos
        while end < len(b):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[end]]
            end += 1
            # a frame with its own sum leaves nothing over
            if not crc and end > pos + head + 2 and (left <= 0 or _flac_header(b, end)[0]):
                break
        else:
            return 0
        pos = end
    return pos - at


VALID = {"wav": _wav, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "pdf": _pdf, "zip": _zip, "flac": _flac, "ogg": _ogg, "gzip": _gzip}


def automaton():
    a = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (kind, len(magic)))
    a.make_automaton()
    return a


def sniff(b: bytes, a=None) -> list[tuple[str, int, int]]:
    """Media found in b as (format, start, length), outermost first in order of start; what lies within one is its own."""
    found, end = [], 0
    for last, (kind, n) in (a or automaton()).iter(b.decode("latin-1")):
        at = last - n + 1
        if at >= end and (length := VALID[kind](b, at)):
            found.append((kind, at, length))
            end = at + length
    return found


def store_wav(payload: bytes, rate: int = 8000) -> bytes:
    """payload as unsigned 8-bit mono samples."""
    pad = b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + pad


def read_wav(stored: bytes) -> bytes:
    pos = 12
    while stored[pos : pos + 4] != b"data":
        pos += 8 + (n := struct.unpack_from("<I", stored, pos + 4)[0]) + n % 2
    return stored[pos + 8 : pos + 8 + struct.unpack_from("<I", stored, pos + 4)[0]]


def features(payload: bytes, found: list[tuple[str, int, int]], declared: str) -> str:
    """The corrected type, what was carved, and level and zero crossings of the samples."""
    x = np.frombuffer(payload, np.uint8)
    mean = x.mean(dtype=np.float64) if len(x) else 0.0
    above = x >= 128
    kind = TYPES.get(found[0][0], declared) if found and found[0][1] == 0 else declared
    inner = ",".join(f"{k}@{a}+{n}" for k, a, n in found if a)
    return f"type={kind};samples={len(x)};mean={mean:.4f};peak={int(x.max()) if len(x) else 0};crossings={int((above[1:] != above[:-1]).sum())};embedded={inner}"


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, unit: int = 576, keep: bool = False) -> DataFrame:
    """Each text of docs (doc_id, text) stored as media, read back and described; `keep` adds the stored bytes.

    The bytes are declared as octets; sniffing the stored form corrects that. Media inside the text itself is carved and
    listed in `feature`. Null text is empty (one unit of padding); other columns are ignored; rows are independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in text_slices(batches, limit=8 << 20):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                stored = store_wav(raw + b"\xff" * (-len(raw) % unit or unit * (not raw)))
                found = sniff(stored, a)
                if not found or found[0] != ("wav", 0, len(stored)):
                    raise ValueError("stored media does not validate")
                back = read_wav(stored)
                inner = [(k, at + 44, n) for k, at, n in sniff(back, a)]
                out.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back, found + inner, "application/octet-stream"), stored))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            names = [x.split()[0] for x in MEDIA.split(", ")] + ["media"]
            yield pa.RecordBatch.from_arrays(columns[: 8 + keep], names=names[: 8 + keep])

    return docs.select("doc_id", "text").mapInArrow(run, MEDIA + (", media binary" if keep else ""))
