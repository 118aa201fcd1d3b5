"""LZ4 frames in plain Python: concatenated and skippable frames, linked blocks, cut-off ends."""

from __future__ import annotations

import xxhash

# Fixed values of the frame format.
MAGIC = b"\x04\x22\x4d\x18"
SKIP_SUFFIX = b"\x2a\x4d\x18"
BLOCK_LIMITS = {4: 1 << 16, 5: 1 << 18, 6: 1 << 20, 7: 1 << 22}
WINDOW = 1 << 16


class FrameError(ValueError):
    """A frame that breaks the format."""


def _length(data: bytes, at: int, base: int) -> tuple[int, int]:
    if base == 15:
        while True:
            if at >= len(data):
                raise FrameError("cut length")
            step = data[at]
            at, base = at + 1, base + step
            if step != 255:
                break
    return base, at


def decode_block(data: bytes, history: bytes, limit: int) -> bytes:
    """A block's bytes; matches may reach back into ``history``."""
    out = bytearray(history[-WINDOW:])
    start, at = len(out), 0
    while at < len(data):
        token = data[at]
        literals, at = _length(data, at + 1, token >> 4)
        if at + literals > len(data):
            raise FrameError("cut literals")
        out += data[at : at + literals]
        at += literals
        if at == len(data):
            break
        if at + 2 > len(data):
            raise FrameError("cut match")
        distance = data[at] | data[at + 1] << 8
        size, at = _length(data, at + 2, token & 15)
        size += 4
        if not 0 < distance <= len(out):
            raise FrameError("match before the start")
        while size > 0:
            piece = out[-distance : len(out) - distance + size] if size < distance else out[-distance:]
            out += piece
            size -= len(piece)
        if len(out) - start > limit:
            raise FrameError("block larger than its limit")
    return bytes(out[start:])


def _frame(data: bytes, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the standard frame at ``at``; None if it is cut off."""
    begin = at + 4
    if begin + 2 > len(data):
        return None
    flags, descriptor = data[begin], data[begin + 1]
    if flags >> 6 != 1 or flags & 2 or descriptor & 0x8F:
        raise FrameError("invalid frame descriptor")
    limit = BLOCK_LIMITS.get(descriptor >> 4 & 7)
    if limit is None:
        raise FrameError("invalid block size")
    extra = (8 if flags & 8 else 0) + (4 if flags & 1 else 0)
    end = begin + 2 + extra
    if end >= len(data):
        return None
    if flags & 1:
        raise FrameError("dictionaries are not supported")
    if data[end] != xxhash.xxh32_intdigest(data[begin:end]) >> 8 & 255:
        raise FrameError("frame header checksum mismatch")
    size = int.from_bytes(data[begin + 2 : begin + 10], "little") if flags & 8 else None
    at, out = end + 1, bytearray()
    while True:
        if at + 4 > len(data):
            return None
        word = int.from_bytes(data[at : at + 4], "little")
        at += 4
        if word == 0:
            break
        n, plain = word & 0x7FFFFFFF, word >> 31
        if n > limit:
            raise FrameError("invalid block size")
        if at + n + (4 if flags & 16 else 0) > len(data):
            return None
        block = data[at : at + n]
        at += n
        if flags & 16:
            if int.from_bytes(data[at : at + 4], "little") != xxhash.xxh32_intdigest(block):
                raise FrameError("block checksum mismatch")
            at += 4
        linked = not flags & 32
        out += block if plain else decode_block(block, bytes(out[-WINDOW:]) if linked else b"", limit)
    if flags & 4:
        if at + 4 > len(data):
            return None
        if int.from_bytes(data[at : at + 4], "little") != xxhash.xxh32_intdigest(bytes(out)):
            raise FrameError("content checksum mismatch")
        at += 4
    if size is not None and size != len(out):
        raise FrameError("content size mismatch")
    return bytes(out), at


def decode_frames(data: bytes) -> tuple[bytes, bool]:
    """(content of all complete frames, whether the end is cut off)."""
    out, at, frames = bytearray(), 0, 0
    while at < len(data):
        magic = data[at : at + 4]
        skip = 0x50 <= magic[0] <= 0x5F and magic[1:] == SKIP_SUFFIX[: len(magic) - 1]
        if not skip and MAGIC[: len(magic)] != magic:
            raise FrameError(f"invalid frame magic at byte {at}")
        if skip:
            size = int.from_bytes(data[at + 4 : at + 8], "little") if at + 8 <= len(data) else None
            if size is None or at + 8 + size > len(data):
                break
            at += 8 + size
            continue
        found = _frame(data, at) if len(magic) == 4 else None
        if found is None:
            break
        out += found[0]
        at, frames = found[1], frames + 1
    if not frames:
        raise FrameError("no complete frame")
    return bytes(out), at < len(data)


def encode_frame(data: bytes, block: int = 1 << 16) -> bytes:
    """A frame of stored and run-length blocks; for tests and padding, not for size."""
    descriptor = bytes([0x60 | 4, 0x40])
    out = bytearray(MAGIC + descriptor + bytes([xxhash.xxh32_intdigest(descriptor) >> 8 & 255]))
    for at in range(0, len(data), block):
        part = data[at : at + block]
        out += (len(part) | 1 << 31).to_bytes(4, "little") + part
    return bytes(out + bytes(4) + xxhash.xxh32_intdigest(data).to_bytes(4, "little"))


def skippable(size: int) -> bytes:
    return b"\x50" + SKIP_SUFFIX + size.to_bytes(4, "little") + bytes(size)
