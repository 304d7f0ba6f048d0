"""Members of zip archives encrypted with AES (the AE-1 and AE-2 forms), which the standard library does not read.

The key comes from the password by PBKDF2; a member is checked by its authentication code and decrypted
in counter mode. The cipher works on all blocks of a member at once with NumPy.
"""

from __future__ import annotations

import hashlib
import hmac
import struct
import zipfile
import zlib

import numpy as np

# Fixed values of the format
AES_METHOD, AES_EXTRA, ITERATIONS, CODE_BYTES, CHECK_BYTES = 99, 0x9901, 1000, 10, 2
KEY_BYTES = {1: 16, 2: 24, 3: 32}
LOCAL_HEADER, NAME_AT = 30, 26


class ZipError(ValueError):
    """A member that cannot be read: a wrong password, a damaged member or an unknown form."""


def _times2(x):
    return ((x << 1) ^ np.where(x & 0x80, 0x1B, 0)) & 0xFF


def _sbox():
    """The substitution of each byte: its inverse in the field, then the affine map."""
    powers, x = [], 1
    for _ in range(255):  # 3 generates the field
        powers.append(x)
        x ^= int(_times2(np.array(x)))
    out = np.zeros(256, dtype=np.uint8)
    for v in range(256):
        inverse = 0 if v == 0 else powers[-powers.index(v) % 255]
        bits = inverse
        for k in range(1, 5):
            bits ^= (inverse << k | inverse >> (8 - k)) & 0xFF
        out[v] = bits ^ 0x63
    return out


SBOX = _sbox()
#: Where each byte of a block comes from when row r moves r columns to the left.
ROWS = np.array([(4 * c + 5 * r) % 16 for c in range(4) for r in range(4)]).reshape(4, 4)
SHIFTED = np.array([ROWS[c][r] for c in range(4) for r in range(4)])


def round_keys(key: bytes):
    """The expanded key, 16 bytes a round."""
    n = len(key) // 4
    words = [np.frombuffer(key[4 * i : 4 * i + 4], dtype=np.uint8) for i in range(n)]
    constant = np.array(1)
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = SBOX[np.roll(w, -1)].copy()
            w[0] ^= np.uint8(constant)
            constant = _times2(constant)
        elif n > 6 and i % n == 4:
            w = SBOX[w]
        words.append(words[i - n] ^ w)
    return np.concatenate(words).reshape(-1, 16)


def encrypt_blocks(blocks, keys):
    """The cipher over rows of 16 bytes."""
    state = blocks ^ keys[0]
    for k in keys[1:-1]:
        state = SBOX[state][:, SHIFTED].reshape(-1, 4, 4).astype(np.int32)
        double = _times2(state)
        mixed = double ^ np.roll(state ^ double, -1, axis=2) ^ np.roll(state, -2, axis=2) ^ np.roll(state, -3, axis=2)
        state = mixed.astype(np.uint8).reshape(-1, 16) ^ k
    return SBOX[state][:, SHIFTED] ^ keys[-1]


def counter_mode(data: bytes, key: bytes) -> bytes:
    """data encrypted or decrypted; blocks are numbered from 1 in little-endian order."""
    keys, out = round_keys(key), []
    for start in range(0, len(data), 1 << 20):
        part = np.frombuffer(data[start : start + (1 << 20)], dtype=np.uint8)
        n = -(-len(part) // 16)
        numbers = np.zeros((n, 2), dtype="<u8")
        numbers[:, 0] = np.arange(start // 16 + 1, start // 16 + n + 1)
        stream = encrypt_blocks(numbers.view(np.uint8).reshape(-1, 16), keys).reshape(-1)
        out.append((part ^ stream[: len(part)]).tobytes())
    return b"".join(out)


def derive(password: bytes, salt: bytes, size: int) -> tuple[bytes, bytes, bytes]:
    """The cipher key, the key of the authentication code, and the check of the password."""
    d = hashlib.pbkdf2_hmac("sha1", password, salt, ITERATIONS, 2 * size + CHECK_BYTES)
    return d[:size], d[size : 2 * size], d[2 * size :]


def _aes_field(extra: bytes) -> tuple[int, int]:
    """Strength and compression method from the member's extra fields."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == AES_EXTRA and size >= 7:
            _, _, strength, method = struct.unpack_from("<H2sBH", extra, at + 4)
            return strength, method
        at += 4 + size
    raise ZipError("no field of the encryption")


def is_aes(info: zipfile.ZipInfo) -> bool:
    return info.compress_type == AES_METHOD


def read_member(archive: zipfile.ZipFile, info: zipfile.ZipInfo, password: bytes | None) -> bytes:
    """The content of a member, encrypted with AES or as the standard library reads it."""
    if not is_aes(info):
        return archive.read(info, pwd=password)
    if not password:
        raise ZipError(f"{info.filename} needs a password")
    archive.fp.seek(info.header_offset)
    head = archive.fp.read(LOCAL_HEADER)
    name, extra = struct.unpack_from("<HH", head, NAME_AT)
    archive.fp.seek(info.header_offset + LOCAL_HEADER + name + extra)
    data = archive.fp.read(info.compress_size)
    strength, method = _aes_field(info.extra)
    size = KEY_BYTES.get(strength)
    if size is None or len(data) < size // 2 + CHECK_BYTES + CODE_BYTES:
        raise ZipError(f"{info.filename} is cut off or of an unknown strength")
    salt, check = data[: size // 2], data[size // 2 : size // 2 + CHECK_BYTES]
    body, code = data[size // 2 + CHECK_BYTES : -CODE_BYTES], data[-CODE_BYTES:]
    key, code_key, expected = derive(password, salt, size)
    if check != expected:
        raise ZipError(f"{info.filename}: wrong password")
    if not hmac.compare_digest(hmac.new(code_key, body, "sha1").digest()[:CODE_BYTES], code):
        raise ZipError(f"{info.filename}: the authentication code differs")
    plain = counter_mode(body, key)
    if method == zipfile.ZIP_STORED:
        return plain
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(plain, -15)
    raise ZipError(f"{info.filename}: compression {method}")
