"""Ed25519 signatures over payload strings, by the JVM's own provider; keys are a driver matter.

Documents are JSON: format, pubkey, payload (itself a JSON string, so that what is signed
never depends on how it is serialised again) and sig, the last two in hex.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import SparkSession

#: The encodings (RFC 8410) around a 32-byte private and public key.
PRIVATE_HEAD = bytes.fromhex("302e020100300506032b657004220420")
PUBLIC_HEAD = bytes.fromhex("302a300506032b6570032100")
LONGEST_DOCUMENT = 4 << 20


class BadSignature(ValueError):
    """A document that isn't signed as it must be."""


def _factory(spark: SparkSession):
    return spark.sparkContext._jvm.java.security.KeyFactory.getInstance("Ed25519")


def _private(spark: SparkSession, seed: bytes):
    return _factory(spark).generatePrivate(spark.sparkContext._jvm.java.security.spec.PKCS8EncodedKeySpec(PRIVATE_HEAD + seed))


def generate(spark: SparkSession, path: str) -> str:
    """Make a key file (mode 0600) unless there is one already; the public key in hex."""
    jvm, factory = spark.sparkContext._jvm, _factory(spark)
    pair = jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    encoded = lambda key, kind: bytes(factory.getKeySpec(key, jvm.java.lang.Class.forName(f"java.security.spec.{kind}EncodedKeySpec")).getEncoded())
    seed, public = encoded(pair.getPrivate(), "PKCS8")[-32:], encoded(pair.getPublic(), "X509")[-32:]
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as file:
        file.write(seed.hex() + public.hex())
    return public.hex()


def load(path: str) -> tuple[bytes, str]:
    """(seed, public key) of a key file that no one else can read."""
    if os.stat(path).st_mode & 0o077:
        raise PermissionError(f"{path} must have mode 0600")
    with open(path) as file:
        text = file.read().strip()
    if not re.fullmatch("[0-9a-f]{128}", text):
        raise BadSignature(f"{path} is no key file")
    return bytes.fromhex(text[:64]), text[64:]


def sign(spark: SparkSession, seed: bytes, payload: str) -> str:
    signer = spark.sparkContext._jvm.java.security.Signature.getInstance("Ed25519")
    signer.initSign(_private(spark, seed))
    signer.update(payload.encode())
    return bytes(signer.sign()).hex()


def verify(spark: SparkSession, pubkey: str, payload: str, sig: str) -> bool:
    try:
        jvm = spark.sparkContext._jvm
        checker = jvm.java.security.Signature.getInstance("Ed25519")
        checker.initVerify(_factory(spark).generatePublic(jvm.java.security.spec.X509EncodedKeySpec(PUBLIC_HEAD + bytes.fromhex(pubkey))))
        checker.update(payload.encode())
        return bool(checker.verify(bytes.fromhex(sig)))
    except Exception:  # malformed keys and signatures are Java errors of several kinds
        return False


def signed_document(spark: SparkSession, format_: str, payload: dict, key: tuple[bytes, str]) -> str:
    text = json.dumps(payload, separators=(",", ":"), ensure_ascii=False)
    return json.dumps({"format": format_, "pubkey": key[1], "payload": text, "sig": sign(spark, key[0], text)})


def opened(spark: SparkSession, document: str, format_: str, pubkey: str | None = None) -> dict:
    """The payload of a signed document of a format, signed by pubkey if that is given."""
    if len(document) > LONGEST_DOCUMENT:
        raise BadSignature("the document is too long")
    try:
        outer = json.loads(document)
        payload = json.loads(outer["payload"])
        ok = outer["format"] == format_ and verify(spark, outer["pubkey"], outer["payload"], outer["sig"])
    except (ValueError, KeyError, TypeError) as e:
        raise BadSignature(str(e)) from e
    if not ok:
        raise BadSignature("wrong format or signature")
    if pubkey is not None and outer["pubkey"] != pubkey:
        raise BadSignature("signed by another key")
    return payload | {"pubkey": outer["pubkey"]}
