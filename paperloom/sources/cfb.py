"""Compound files (OLE): the streams of one, the payload of an Ole10Native stream, and a writer for small files."""

from __future__ import annotations

import struct

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_FREE, _END, _FAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


def streams(data: bytes) -> dict[str, bytes]:
    """Contents by stream name; {} where the file isn't a sound compound file."""
    try:
        return _streams(data)
    except (struct.error, IndexError, ValueError):
        return {}


def _streams(data: bytes) -> dict[str, bytes]:
    if data[:8] != MAGIC or len(data) < 512:
        return {}
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    n_fat, first_dir, _, cutoff, first_mini, _, first_difat, _ = _header(data)
    size, mini = 1 << shift, 1 << mini_shift

    def sector(k: int) -> bytes:
        return data[(k + 1) * size : (k + 2) * size]

    fat_at = [k for k in struct.unpack_from("<109I", data, 76) if k < _FAT]
    while first_difat < _FAT and len(fat_at) < n_fat:
        more = struct.unpack(f"<{size // 4}I", sector(first_difat))
        fat_at += [k for k in more[:-1] if k < _FAT]
        first_difat = more[-1]
    fat = [v for k in fat_at for v in struct.unpack(f"<{size // 4}I", sector(k).ljust(size, b"\xff"))]

    def chain(k: int, table: list[int]):
        seen = set()
        while k < _FAT and k not in seen:
            seen.add(k)
            yield k
            k = table[k]

    directory = b"".join(map(sector, chain(first_dir, fat)))
    mini_fat = [v for k in chain(first_mini, fat) for v in struct.unpack(f"<{size // 4}I", sector(k))]
    entries = []
    for at in range(0, len(directory) - 127, 128):
        name_len, kind = struct.unpack_from("<HB", directory, at + 64)
        start, length = struct.unpack_from("<IQ", directory, at + 116)
        if kind:
            entries.append((directory[at : at + max(0, name_len - 2)].decode("utf-16-le", "replace"), kind, start, length & 0xFFFFFFFF if shift == 9 else length))
    root = next((e for e in entries if e[1] == 5), None)
    pool = b"".join(map(sector, chain(root[2], fat))) if root else b""
    out = {}
    for name, kind, start, length in entries:
        if kind == 2:
            if length < cutoff:
                raw = b"".join(pool[k * mini : (k + 1) * mini] for k in chain(start, mini_fat))
            else:
                raw = b"".join(map(sector, chain(start, fat)))
            out[name] = raw[:length]
    return out


def _header(data: bytes) -> tuple:
    (n_fat, first_dir) = struct.unpack_from("<II", data, 44)
    (cutoff, first_mini, n_mini, first_difat, n_difat) = struct.unpack_from("<5I", data, 56)
    return n_fat, first_dir, n_mini, cutoff, first_mini, n_mini, first_difat, n_difat


def ole10_native(stream: bytes) -> tuple[str, bytes] | None:
    """(file name, payload) of an Ole10Native stream: its size, maybe a flag of two bytes, two NUL-ended names, 8, 4 or no
    bytes of flags, one more NUL-ended path, and the payload behind its own size.
    """
    if len(stream) < 8:
        return None
    names, at = [], 6 if stream[4:6] in (b"\1\0", b"\2\0") else 4
    for _ in range(2):
        end = stream.find(b"\0", at)
        if end < 0:
            return None
        names.append(stream[at:end].decode("utf-8", "replace"))
        at = end + 1
    for flags in (8, 4, 0):
        end = stream.find(b"\0", at + flags) if at + flags < len(stream) else -1
        if 0 <= end and end + 5 <= len(stream):
            size = int.from_bytes(stream[end + 1 : end + 5], "little")
            if 0 < size <= len(stream) - end - 5:
                return names[0] or "ole_payload.bin", stream[end + 5 : end + 5 + size]
    return None


def write_native(name: str, payload: bytes) -> bytes:
    label, temp = name.encode("latin-1", "replace") + b"\0", b"C:\\temp\\x\0"
    inner = struct.pack("<H", 2) + label + label + struct.pack("<II", 0x30000, len(temp)) + temp + struct.pack("<I", len(payload)) + payload
    return struct.pack("<I", len(inner)) + inner


def write(contents: dict[str, bytes]) -> bytes:
    """A compound file of version 3 with these streams, each padded to be stored in full sectors."""
    size = 512
    sectors: list[bytes] = []
    fat: list[int] = []

    def store(raw: bytes) -> int:
        first = len(sectors)
        count = max(1, -(-len(raw) // size))
        for k in range(count):
            sectors.append(raw[k * size : (k + 1) * size].ljust(size, b"\0"))
            fat.append(first + k + 1 if k < count - 1 else _END)
        return first

    rows = []
    for name, raw in contents.items():
        rows.append((name, 2, store(raw.ljust(4096, b"\0")), len(raw), 0))
    names = [("Root Entry", 5, _END, 0, 1 if rows else 0)] + rows
    directory = b""
    for k, (name, kind, start, length, _) in enumerate(names):
        label = (name + "\0").encode("utf-16-le")
        right = k + 1 if 0 < k < len(names) - 1 else _FREE
        child = 1 if k == 0 and rows else _FREE
        directory += label.ljust(64, b"\0") + struct.pack("<HBBIII", len(label), kind, 1, _FREE, right, child) + b"\0" * 36 + struct.pack("<IQ", start, max(length, 4096) if kind == 2 else length)
    first_dir = store(directory.ljust(-(-len(directory) // size) * size, b"\0"))
    n_fat = 1
    while n_fat * (size // 4) < len(fat) + n_fat:
        n_fat += 1
    at = len(sectors)
    table = fat + [_FAT] * n_fat
    table += [_FREE] * (n_fat * (size // 4) - len(table))
    raw = struct.pack(f"<{len(table)}I", *table)
    sectors += [raw[k * size : (k + 1) * size] for k in range(n_fat)]
    if n_fat > 109:
        raise ValueError("too large for a header without further tables")
    places = [at + k for k in range(n_fat)] + [_FREE] * (109 - n_fat)
    header = MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, n_fat, first_dir, 0, 4096, _END, 0, _END, 0, places[0])
    header += struct.pack("<108I", *places[1:])
    return header + b"".join(sectors)
