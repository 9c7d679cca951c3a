"""Ciphers, checksums and keys.

Ciphers are Spark's own expressions. Every block has an iv of its own; blocks
are bound to their address by additional data.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CHECKSUM_XOR

KDF_ROUNDS = 131072
KEY_BYTES, IV_BYTES, TAG_BYTES = 16, 12, 16


def address_bytes(address: Column) -> Column:
    """A long as 8 big-endian bytes."""
    return F.unhex(F.lpad(F.hex(address.cast("long")), 16, "0"))


def block_iv(address: Column, version: Column) -> Column:
    """12 bytes that no other (address, version) has, up to a SHA-256 collision."""
    return F.unhex(F.substring(F.sha2(F.concat(address_bytes(address), address_bytes(version)), 256), 1, 2 * IV_BYTES))


def segment_key(secret: bytes, segment: Column) -> Column:
    """A 16-byte key for each segment, derived, so that runs can be repeated."""
    return F.unhex(F.substring(F.sha2(F.concat(F.lit(secret), address_bytes(segment)), 256), 1, 2 * KEY_BYTES))


def gcm_encrypt(data: Column, key: Column, iv: Column, address: Column) -> Column:
    """iv, ciphertext and tag in one binary."""
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), iv, address_bytes(address))


def gcm_decrypt(sealed: Column, key: Column, address: Column) -> Column:
    """The data, or null where the tag does not fit data, key and address."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), address_bytes(address))


def gcm_tag(sealed: Column) -> Column:
    return F.substring(sealed, -TAG_BYTES, TAG_BYTES)


def cbc_encrypt(data: Column, key: Column, iv: Column) -> Column:
    return F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv)


def cbc_decrypt(sealed: Column, key: Column) -> Column:
    return F.try_aes_decrypt(sealed, key, F.lit("CBC"), F.lit("PKCS"))


def ecb_block(data: Column, key: Column) -> Column:
    """One 16-byte block under AES-ECB."""
    return F.substring(F.aes_encrypt(data, key, F.lit("ECB"), F.lit("PKCS")), 1, 16)


_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def crc32_be(data: bytes, seed: int = 0xFFFFFFFF) -> int:
    """CRC-32 with the most significant bit first, without final inversion.

    It is the mirror image of zlib's CRC over mirrored bytes.
    """
    import zlib

    def mirrored(x: int) -> int:
        return int(f"{x & 0xFFFFFFFF:032b}"[::-1], 2)

    return mirrored(~zlib.crc32(data.translate(_MIRROR), ~mirrored(seed) & 0xFFFFFFFF))


def checksum(data: bytes) -> int:
    return crc32_be(data) ^ CHECKSUM_XOR


def seeded_iv(seed: int, size: int = 16) -> bytes:
    """``size`` bytes of chained checksums of a seed; repeatable, not secret."""
    out = bytearray(size)
    for at in range(0, size // 4 * 4, 4):
        out[at : at + 4] = crc32_be(bytes(out), seed).to_bytes(4, "little")
    return bytes(out)


def crc32_be_column(data: Column) -> Column:
    """checksum() of a binary column, in Arrow batches."""
    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return values.map(checksum, na_action="ignore").astype("Int64")

    return run(data)


def derive_keys(password: str, salt: bytes, rounds: int = KDF_ROUNDS) -> bytes:
    """64 bytes from a password by PBKDF2-HMAC-SHA512; once on the driver, never per row."""
    return hashlib.pbkdf2_hmac("sha512", password.encode(), salt, rounds, 64)


def split_key(material: bytes) -> tuple[str, str]:
    """Key and iv as lower-case hex: the first 16 bytes and the next 12."""
    if len(material) < KEY_BYTES + IV_BYTES:
        raise ValueError(f"{len(material)} bytes of key material; {KEY_BYTES + IV_BYTES} are needed")
    return material[:KEY_BYTES].hex(), material[KEY_BYTES : KEY_BYTES + IV_BYTES].hex()


def journal_key(master: bytes, block: Column) -> Column:
    """16 bytes for each journal block: its number and two checksums, under the master key."""
    @F.pandas_udf("binary")
    def source(numbers: pd.Series) -> pd.Series:
        def one(n: int) -> bytes:
            low = n & 0xFFFFFFFF
            return n.to_bytes(8, "little") + b"".join(crc32_be(master, s).to_bytes(4, "little") for s in (low, low ^ 0xFFFFFFFF))

        return numbers.map(one)

    return ecb_block(source(block), F.lit(master))
