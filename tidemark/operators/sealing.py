"""Payload sealing as a column job: AES-GCM, bound to the record by its authenticated data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.hashing import base64_text


def seal_payload(text: Column, key: Column, bound_to: Column) -> Column:
    """Base64 ciphertext with a fresh random nonce per value."""
    return base64_text(F.aes_encrypt(F.encode(text, "UTF-8"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.encode(bound_to, "UTF-8")))


def open_payload(sealed: Column, key: Column, bound_to: Column) -> Column:
    """The sealed text; fails on a wrong key, changed bytes or another record's data."""
    return F.aes_decrypt(F.unbase64(sealed), key, F.lit("GCM"), F.lit("DEFAULT"), F.encode(bound_to, "UTF-8")).cast("string")
