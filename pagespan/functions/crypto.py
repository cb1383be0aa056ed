"""Font obfuscation: keys as Column expressions, the mask as an Arrow UDF."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import Udf, lit, string

# Algorithm URIs, and the bytes that each masks.
IDPF_URI, ADOBE_URI = "http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC"
AES_MARKS = ("aes256-cbc", "aes128-cbc", "xmlenc#aes")
MASKED = {"idpf": 1040, "adobe": 1024}


def algorithm_of(uri: Column | str) -> Column:
    """idpf, adobe, aes_cbc or unknown."""
    u = string(uri)
    aes = u.contains(AES_MARKS[0]) | u.contains(AES_MARKS[1]) | u.contains(AES_MARKS[2])
    return F.when(u == IDPF_URI, "idpf").when(u == ADOBE_URI, "adobe").when(aes, "aes_cbc").otherwise("unknown")


def idpf_key(identifier: Column | str) -> Column:
    """20 bytes: SHA-1 of the identifier without any white space."""
    return F.unhex(F.sha1(F.regexp_replace(string(identifier), r"(?U)\s", "").cast("binary")))


def adobe_key(identifier: Column | str) -> Column:
    """The 16 bytes of a UUID; 16 zeros if it isn't one."""
    hexed = F.replace(F.replace(string(identifier), lit("urn:uuid:"), lit("")), lit("-"), lit(""))
    return F.when(hexed.rlike("^[0-9A-Fa-f]{32}$"), F.unhex(hexed)).otherwise(F.unhex(lit("00" * 16)))


def mask(data: bytes, key: bytes, n: int) -> bytes:
    """The first n bytes of data XORed with the key over and over; its own inverse."""
    if not key or not data:
        return data
    head = np.frombuffer(data[:n], np.uint8)
    return (head ^ np.resize(np.frombuffer(key, np.uint8), len(head))).tobytes() + data[n:]


_masked = Udf(lambda data, key, n: None if data is None or key is None else mask(bytes(data), bytes(key), n), "binary")


def deobfuscate(content: Column | str, identifier: Column | str, algorithm: Column | str) -> Column:
    """Fonts unmasked (or masked); content of other algorithms as it is."""
    c, a = string(content), string(algorithm)
    key = F.when(a == "idpf", idpf_key(identifier)).when(a == "adobe", adobe_key(identifier))
    n = F.when(a == "idpf", MASKED["idpf"]).otherwise(MASKED["adobe"])
    return F.when(a.isin("idpf", "adobe"), _masked(c, key, n)).otherwise(c)


def read_encrypted(content: Column | str, identifier: Column | str, algorithm: Column | str, hook: Callable[[Column], Column] | None = None) -> Column:
    """Plain content stays, fonts are unmasked, other algorithms go through the hook (null from it: the ciphertext)."""
    c, a = string(content), string(algorithm)
    other = c if hook is None else F.coalesce(hook(c), c)
    return F.when(a.isNull(), c).when(a.isin("idpf", "adobe"), deobfuscate(c, identifier, a)).otherwise(other)
