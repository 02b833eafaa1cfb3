"""Media columns: signature sniffing and carving, and a lossless byte store (operator 7).

One Aho-Corasick automaton finds every magic number of a byte string in a single
pass.  A format validator then walks the structure behind it (chunk lengths,
checksums, end markers) and gives the object's length, or rejects the place.  A
valid object at byte 0 that accounts for the whole value corrects a wrong
declared type; valid objects elsewhere are carved out as embedded media.  What a
validator has to look for ahead is found once a value, so time is linear in it; reading
that can't be shared (decompression, chains of chunks) stops at ``PATIENCE`` times it.

Payloads are stored as 8-bit mono samples in a WAV container and read back
through the same sniffer, so that what is measured is what was stored; media objects
that a payload holds are listed with their types, places and lengths.

Cases: null content gives null type and no embedded objects (null text is stored
as an empty text: 64 zero bytes); truncated or false signatures are ignored;
equal bytes give equal results; result columns replace others of their name.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import appended

RATE = 8000
BLOCK = 64
UNKNOWN = "application/octet-stream"
PATIENCE = 64  # times a value's length that false signatures may make validators read before the rest count as false
NESTED = 16  # levels of a PDF in a PDF
GULP = 1 << 14


class Content:
    """A byte string under search; what validators need of the whole of it is found once, so that many false signatures cost no more than one.

    ``work`` counts what validators have read in vain where that can't be shared.
    """

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)
        self.left = PATIENCE * self.size + (1 << 20)

    def work(self, n: int) -> bool:
        """Whether n more steps are granted."""
        self.left -= n
        return self.left > 0

    @cached_property
    def archives(self) -> dict[int, int]:
        """Start of each zip archive -> its end, by the first end record that fits; one stored inside has an end record of its own."""
        out: dict[int, int] = {}
        b, end = self.data, self.data.find(b"PK\x05\x06")
        while 0 <= end <= self.size - 22:
            size, offset, note = struct.unpack_from("<IIH", b, end + 12)
            start = end - size - offset
            if start >= 0 and end + 22 + note <= self.size and b[start + offset : start + offset + 4] == b"PK\x01\x02":
                out.setdefault(start, end + 22 + note)
            end = b.find(b"PK\x05\x06", end + 1)
        return out

    @cached_property
    def papers(self) -> tuple[list[int], list[int], list[int], dict[int, int]]:
        """(starts of PDF heads, starts of %%EOF marks, their ends, head -> end of the last mark whose startxref fits it)."""
        heads = [m.start() for m in _PDF.finditer(self.data)]
        starts, ends, fits, k, open_ = [], [], {}, 0, []
        for m in _PDF_END.finditer(self.data):
            starts.append(m.start())
            ends.append(m.end())
            while k < len(heads) and heads[k] < m.start():
                open_.append(heads[k])
                k += 1
            if said := _START.search(self.data, max(0, m.start() - 48), m.start()):
                for head in open_[: -NESTED - 1 : -1]:
                    if head + int(said[1]) < m.start() and _XREF.match(self.data, head + int(said[1])):
                        fits[head] = m.end()
                        del open_[bisect_left(open_, head) + 1 :]  # what lies between is over
                        break
        return heads, starts, ends, fits

    @cached_property
    def marks(self) -> list[int]:
        """Places of JPEG markers other than stuffed bytes and restarts."""
        x = np.frombuffer(self.data, np.uint8)
        at = np.flatnonzero(x[:-1] == 0xFF)
        return at[(x[at + 1] != 0) & ~((x[at + 1] >= 0xD0) & (x[at + 1] <= 0xD7))].tolist()

    @cached_property
    def zeros(self) -> list[int]:
        return np.flatnonzero(np.frombuffer(self.data, np.uint8) == 0).tolist()

    @cached_property
    def walked(self) -> dict[int, int]:
        """Place in a JPEG -> end of the image, or 0."""
        return {}


def _wav(c: Content, i: int) -> int:
    b = c.data
    if c.size < i + 44 or b[i + 8 : i + 12] != b"WAVE":
        return 0
    end = i + 8 + int.from_bytes(b[i + 4 : i + 8], "little")
    if end > c.size:
        return 0
    at, seen = i + 12, set()
    while at + 8 <= end:
        if not c.work(8):
            return 0
        seen.add(b[at : at + 4])
        at += 8 + (n := int.from_bytes(b[at + 4 : at + 8], "little")) + n % 2
    return end - i if {b"fmt ", b"data"} <= seen and at in (end, end + 1) else 0


def _png(c: Content, i: int) -> int:
    b, at, first = c.data, i + 8, True
    while at + 12 <= c.size:
        n = int.from_bytes(b[at : at + 4], "big")
        kind = b[at + 4 : at + 8]
        if at + 12 + n > c.size or first and (kind != b"IHDR" or n != 13) or not c.work(12 + n):
            return 0
        if crc32(memoryview(b)[at + 4 : at + 8 + n]) != int.from_bytes(b[at + 8 + n : at + 12 + n], "big"):
            return 0
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return at - i
    return 0


def _gif(c: Content, i: int) -> int:
    b = c.data
    if c.size < i + 13 or b[i + 4 : i + 6] not in (b"7a", b"9a"):
        return 0
    at = i + 13 + (3 << (b[i + 10] & 7) + 1 if b[i + 10] & 0x80 else 0)

    def blocks(at: int) -> int:
        while at < c.size and b[at] and c.work(1):
            at += 1 + b[at]
        return at + 1

    while at < c.size and c.work(1):
        if b[at] == 0x3B:
            return at + 1 - i
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 <= c.size:
            flags = b[at + 9]
            at = blocks(at + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(c: Content, i: int) -> int:
    b, at, path, end = c.data, i + 2, [], 0
    while at + 4 <= c.size and b[at] == 0xFF:
        if at in c.walked:
            end = c.walked[at]
            break
        path.append(at)
        kind = b[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        n = int.from_bytes(b[at + 2 : at + 4], "big")
        if n < 2 or at + 2 + n > c.size or not 0xC0 <= kind <= 0xFE or kind == 0xD8:
            break
        at += 2 + n
        if kind == 0xDA:
            k = bisect_left(c.marks, at)
            if k == len(c.marks):
                break
            at = c.marks[k]
            if b[at + 1] == 0xD9:
                end = at + 2
                break
    c.walked.update(dict.fromkeys(path, end))
    return end - i if end else 0


def _bmp(c: Content, i: int) -> int:
    if c.size < i + 30:
        return 0
    n, pixels, header, planes, bits = *struct.unpack_from("<I", c.data, i + 2), *struct.unpack_from("<II", c.data, i + 10), *struct.unpack_from("<HH", c.data, i + 26)
    right = header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= pixels <= n
    return n if right and i + n <= c.size else 0


def _zip(c: Content, i: int) -> int:
    return c.archives[i] - i if i in c.archives else 0


_PDF = re.compile(rb"%PDF-[0-9]\.")
_PDF_END = re.compile(rb"%%EOF[\r\n]*")
_START = re.compile(rb"startxref\s{1,9}([0-9]{1,15})\s{1,9}\Z")
_XREF = re.compile(rb"\s{0,9}(?:xref\b|[0-9]{1,10}\s{1,9}[0-9]{1,10}\s{1,9}obj\b)")


def _pdf(c: Content, i: int) -> int:
    """To the last %%EOF whose startxref fits this file and no later one; where none fits, to the last before the next file."""
    heads, starts, ends, fits = c.papers
    k = bisect_left(heads, i)
    if k == len(heads) or heads[k] != i:
        return 0
    if i in fits:
        return fits[i] - i
    stop = bisect_left(starts, heads[k + 1]) if k + 1 < len(heads) else len(starts)
    return ends[stop - 1] - i if stop > bisect_left(starts, i) else 0


def _gzip(c: Content, i: int) -> int:
    b = c.data
    if c.size < i + 18 or (flags := b[i + 3]) & 0xE0:
        return 0
    at = i + 10
    if flags & 4:
        at += 2 + int.from_bytes(b[at : at + 2], "little")
    for bit in (8, 16):  # a name, a comment
        if flags & bit:
            k = bisect_left(c.zeros, at)
            if k == len(c.zeros):
                return 0
            at = c.zeros[k] + 1
    at += 2 if flags & 2 else 0
    d, check, n, began, made, tail = zlib.decompressobj(-15), 0, 0, at, b" ", b""
    try:
        while not d.eof:
            part = tail or b[at : at + GULP]
            if not (part or made) or not c.work(1 + len(part)):
                return 0
            at += 0 if tail else len(part)
            made = d.decompress(part, 1 << 20)
            check, n, tail = crc32(made, check), n + len(made), d.unconsumed_tail
    except zlib.error:
        return 0
    at -= len(d.unused_data)
    right = at > began and at + 8 <= c.size and struct.unpack_from("<II", b, at) == (check, n & 0xFFFFFFFF)
    return at + 8 - i if right else 0


FORMATS = {
    b"RIFF": ("audio/wav", _wav),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF8": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"BM": ("image/bmp", _bmp),
    b"PK\x03\x04": ("application/zip", _zip),
    b"%PDF-": ("application/pdf", _pdf),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
}
_automaton = None


def automaton():
    """The automaton of all signatures; bytes are read as Latin-1, one character a byte."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for magic in FORMATS:
            _automaton.add_word(magic.decode("latin-1"), magic)
        _automaton.make_automaton()
    return _automaton


def objects(content: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of the valid media objects, outermost first, none inside another of the same level."""
    whole, found, after = Content(content), [], 0
    for end, magic in automaton().iter(content.decode("latin-1")):
        start = end - len(magic) + 1
        if start >= after and (n := FORMATS[magic][1](whole, start)):
            found.append((FORMATS[magic][0], start, n))
            after = start + (n if start else 0)  # a carrier at byte 0 is searched inside
    return found


def sniff_column(content: Column, declared: Column) -> Column:
    """Struct (media_type, corrected, embedded): the type found or else declared, whether that changed it, and what is embedded."""

    @F.arrow_udf("media_type string, corrected boolean, embedded array<struct<media_type:string,start:long,length:long>>")
    def sniffed(values: pa.Array, types: pa.Array) -> pa.Array:
        out = []
        for value, said in zip(values.to_pylist(), types.to_pylist()):
            if value is None:
                out.append({"media_type": None, "corrected": False, "embedded": []})
                continue
            found = objects(value)
            own = next((t for t, s, n in found if s == 0 and n == len(value)), None)
            inner = [{"media_type": t, "start": s, "length": n} for t, s, n in found if not (s == 0 and n == len(value))]
            out.append({"media_type": own or said or UNKNOWN, "corrected": bool(own and said and own != said), "embedded": inner})
        inner = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
        return pa.array(out, pa.struct([("media_type", pa.string()), ("corrected", pa.bool_()), ("embedded", inner)]))

    return sniffed(content, declared)


def sniff(df: DataFrame, content: str = "content", declared: str = "declared_type") -> DataFrame:
    """Adds media_type, corrected and embedded."""
    out = df.withColumn("_m", sniff_column(F.col(content), F.col(declared)))
    for c in ("media_type", "corrected", "embedded"):
        out = out.withColumn(c, F.col(f"_m.{c}"))
    return out.drop("_m")


def carve(df: DataFrame, content: str = "content", declared: str = "declared_type") -> DataFrame:
    """A row per embedded object: the row's columns without the content, embedded_type, start, length and the object's bytes as ``embedded``."""
    rows = sniff(df, content, declared).withColumn("_e", F.explode("embedded"))
    part = F.expr(f"substring(`{content}`, cast(_e.start as int) + 1, cast(_e.length as int))")
    kept = [c for c in df.columns if c not in (content, "embedded_type", "start", "length", "embedded")]
    return rows.select(*kept, F.col("_e.media_type").alias("embedded_type"), F.col("_e.start").alias("start"), F.col("_e.length").alias("length"), part.alias("embedded"))


def store_bytes(payload: bytes) -> bytes:
    """A WAV file whose samples are the payload, padded with zeros to a positive multiple of 64."""
    n = max(BLOCK, -(-len(payload) // BLOCK) * BLOCK)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + payload.ljust(n, b"\0")


def read_samples(media: bytes) -> bytes:
    """The samples of a stored WAV file; raises if it isn't one."""
    if _wav(Content(media), 0) != len(media):
        raise ValueError("not a whole WAV file")
    at = 12
    while media[at : at + 4] != b"data":
        n = int.from_bytes(media[at + 4 : at + 8], "little")
        at += 8 + n + n % 2
    return media[at + 8 : at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")]


def features(samples: bytes) -> str:
    """Type, rate, number, mean, deviation, sign changes about the middle and peak of 8-bit samples, in integers only."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n = len(x)
    total, squares = int(x.sum()), int((x * x).sum())
    side = x >= 128
    return f"audio/wav;rate={RATE};n={n};mean_milli={1000 * total // n};var_milli={1000 * (n * squares - total * total) // (n * n)};crossings={int((side[1:] != side[:-1]).sum())};peak={int(x.max())}"


def store(df: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``media``, the stored form of the UTF-8 text (null: empty)."""
    return appended(df, lambda texts: [pa.array([store_bytes((t or "").encode()) for t in texts.to_pylist()], pa.binary())], text, "media binary", drop)


def read_back(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds media_type and, of the bytes read back, payload_bytes, payload_sha256, tail_crc32, feature, n_embedded and embedded (all null for null media).

    ``embedded`` lists the media objects in the payload as type:start:length, comma-joined.
    """

    def read(values: pa.Array) -> list[pa.Array]:
        rows = []
        for value in values.to_pylist():
            if value is None:
                rows.append((None,) * 7)
                continue
            found = objects(value)
            kind = next((t for t, s, n in found if s == 0 and n == len(value)), None)
            if kind != "audio/wav":
                raise ValueError(f"stored media is {kind or 'unknown'}")
            payload = read_samples(value)
            inner = [f"{t}:{s - len(value) + len(payload)}:{n}" for t, s, n in found if s]
            rows.append((kind, len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-BLOCK:]), features(payload), len(inner), ",".join(inner)))
        return [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))]

    return appended(df, read, media, "media_type string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, n_embedded long, embedded string")
