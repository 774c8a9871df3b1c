"""AES-CBC sealing of JSON text: ``{"iv": base64, "bytes": base64}``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MODE, _PADDING, _IV_BYTES = "CBC", "PKCS", 16


def base64_text(data: Column) -> Column:
    """Base64 in one line; Spark's own function may break long text into lines."""
    return F.translate(F.base64(data), "\r\n", "")


def _key(secret: str) -> Column:
    if len(secret.encode()) not in (16, 24, 32):
        raise ValueError("the secret key must have 16, 24 or 32 bytes")
    return F.lit(secret).cast("binary")


def encrypted_object(text: Column, secret: str) -> Column:
    """Seal ``text`` under a fresh random iv as a JSON object with iv and bytes.

    One sealed value holds both parts, the iv first, so it is made once and then split.
    """
    sealed = F.aes_encrypt(text.cast("binary"), _key(secret), F.lit(_MODE), F.lit(_PADDING))
    # one array element keeps the random value from being evaluated twice
    made = F.transform(
        F.array(sealed),
        lambda b: F.concat(
            F.lit('{"iv":"'), base64_text(b.substr(F.lit(1), F.lit(_IV_BYTES))),
            F.lit('","bytes":"'), base64_text(b.substr(F.lit(_IV_BYTES + 1), F.length(b))), F.lit('"}'),
        ),
    )
    return made[0]


def decrypt_text(data: Column, iv: Column, secret: str) -> Column:
    """Open base64 ``data`` with base64 ``iv``; NULL when key or data do not fit."""
    sealed = F.concat(F.unbase64(iv), F.unbase64(data))
    return F.try_aes_decrypt(sealed, _key(secret), F.lit(_MODE), F.lit(_PADDING)).cast("string")
