"""ZIP files of a few small members, for which zipfile takes many times what their lines take."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

#: The header of a member, its entry in the directory, and the end of the file.
_LOCAL, _ENTRY, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")
#: A name in UTF-8, the two bits of a level of compression, and sizes that stand behind the member and in the directory.
_UTF8, _KNOWN = 0x800, 0x80E
#: Bytes of a file and of a member up to which it is small.
_SMALL = 1 << 20


def stored(members) -> bytes:
    """The ZIP file of ``members``, pairs of an ASCII name and bytes, that are stored as they are."""
    body, entries, at = [], [], 0
    for title, data in members:
        name = title.encode("ascii")
        # The version, no flags, stored, midnight of 1980-01-01, no extra fields.
        fields = (20, 0, 0, 0, 33, zlib.crc32(data), len(data), len(data), len(name), 0)
        body += (_LOCAL.pack(b"PK\3\4", *fields), name, data)
        entries += (_ENTRY.pack(b"PK\1\2", 20, *fields, 0, 0, 0, 0, at), name)
        at += _LOCAL.size + len(name) + len(data)
    directory, n = b"".join(entries), len(entries) // 2
    return b"".join((*body, directory, _END.pack(b"PK\5\6", 0, 0, n, n, len(directory), at, 0)))


def _simple(raw: bytes, wanted) -> list[tuple[str, bytes]] | None:
    """The wanted members in the order of their names, or None where the file has anything but small, plain members, each name once."""
    end = len(raw) - _END.size
    if end < 0 or len(raw) > _SMALL:
        return None
    mark, disk, first, here, n, size, at, comment = _END.unpack_from(raw, end)
    if mark != b"PK\5\6" or disk or first or here != n or comment or at + size != end:
        return None
    names, found = set(), []
    for _ in range(n):
        if at + _ENTRY.size > end:
            return None
        mark, _, _, flags, method, _, _, crc, packed, full, length, extra, comment, disk, _, _, start = _ENTRY.unpack_from(raw, at)
        title = raw[at + _ENTRY.size : at + _ENTRY.size + length]
        at += _ENTRY.size + length
        if mark != b"PK\1\2" or flags & ~_KNOWN or method not in (0, 8) or extra or comment or disk or b"\0" in title or title in names:
            return None
        names.add(title)
        name = title.decode("utf-8" if flags & _UTF8 or title.isascii() else "cp437")
        if not wanted(name):
            continue
        if start + _LOCAL.size > end or full > _SMALL:
            return None
        mark, _, local, *_, again, more = _LOCAL.unpack_from(raw, start)
        start += _LOCAL.size
        if mark != b"PK\3\4" or local & _UTF8 != flags & _UTF8 or raw[start : start + again] != title:
            return None
        data = raw[start + again + more : start + again + more + packed]
        try:
            data = zlib.decompressobj(-zlib.MAX_WBITS).decompress(data, full + 1) if method else data
        except zlib.error:
            return None
        if len(data) != full or zlib.crc32(data) != crc:
            return None
        found.append((name, data))
    return sorted(found) if at == end else None


def csv_members(raw: bytes, part: str = ""):
    """Name and bytes of each member that ends with .csv and has ``part`` in its name, in lower case, by name; none if ``raw`` is no ZIP file.

    Small files of plain members are read as they lie. All others, damaged ones among them, are left to zipfile, a member at a time.
    """
    if raw[:4] != b"PK\3\4":
        return

    def wanted(name: str) -> bool:
        return (low := name.lower()).endswith(".csv") and part in low

    if (found := _simple(raw, wanted)) is not None:
        yield from found
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        return
    for name in sorted(n for n in archive.namelist() if wanted(n)):
        yield name, archive.read(name)
