"""Hash expressions: record, leaf and node hashes, HMAC pseudonyms, key ids. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Genesis link, domain prefixes of leaf and node, signature algorithm tag.
ZERO_HASH = "0" * 64
LEAF_PREFIX = "00"
NODE_PREFIX = "01"
ED25519_TAG = "01"
EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def bytes_of(hexa: str) -> Column:
    return F.unhex(F.lit(hexa))


def sha_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def sha_bin(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def record_hash(record_bytes: Column) -> Column:
    return sha_hex(record_bytes)


def leaf_hash(entry: Column) -> Column:
    return sha_bin(F.concat(bytes_of(LEAF_PREFIX), entry))


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def base64_text(data: Column) -> Column:
    """Base64 on one line; the builtin breaks lines after 76 characters."""
    return F.translate(F.base64(data), "\r\n", "")


def pad_keys(df, salt: str = "salt"):
    """Adds the two HMAC pads of a 32-byte salt: XOR per byte, done on hex nibbles with translate."""
    zeros = F.rpad(F.hex(F.col(salt)), 128, "0")
    hexes = "0123456789ABCDEF"

    def flipped(byte: int) -> Column:
        # XOR with a constant byte maps each high and each low nibble through a fixed permutation.
        high, low = byte >> 4, byte & 15
        high_map = "".join(hexes[i ^ high] for i in range(16))
        low_map = "".join(hexes[i ^ low] for i in range(16))
        pairs = F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda i: F.concat(
                F.translate(F.substring(zeros, i * 2 + 1, F.lit(1)), hexes, high_map),
                F.translate(F.substring(zeros, i * 2 + 2, F.lit(1)), hexes, low_map),
            ),
        )
        return F.unhex(F.array_join(pairs, ""))

    return df.withColumns({"ipad": flipped(0x36), "opad": flipped(0x5C)})


def hmac_hex(ipad: Column, opad: Column, message: Column) -> Column:
    inner = sha_bin(F.concat(ipad, F.encode(message, "UTF-8")))
    return sha_hex(F.concat(opad, inner))


def key_id(name: Column, public_key: Column) -> Column:
    """First four bytes (8 hex digits) of SHA-256 over name, newline, algorithm tag and key."""
    return F.substring(
        sha_hex(F.concat(F.encode(name, "UTF-8"), bytes_of("0A" + ED25519_TAG), public_key)), 1, 8
    )


def is_digest(data: Column) -> Column:
    return F.coalesce(F.octet_length(data) == 32, F.lit(False))


def is_lower_hex64(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def is_hex64(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{64}$")
