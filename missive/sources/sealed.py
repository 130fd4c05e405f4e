"""Encrypted and authenticated data: a sink, its source and keys, by Spark's own AES and SHA functions.

A blob is a token in the public Fernet format: version 0x80, 8 bytes of seconds, 16 of initial vector, AES-128-CBC text with
PKCS padding, and the HMAC-SHA256 of all that, in URL-safe base64. The HMAC is two hashes with pads made on the driver; it is compared before
anything is decrypted. Keys reach the plan as the columns of a one-row frame, so no plan and no log shows them.

A file is one token (so at most 2 GB); a table has a token for each row, a line each, which tasks seal, split and open independently.
"""

from __future__ import annotations

import base64
import binascii
import os
import secrets
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import exists

VARIABLE = "MISSIVE_DATASET_KEY"


class SealError(Exception):
    """A key or a blob cannot be used."""


@dataclass(frozen=True)
class Key:
    signing: bytes = field(repr=False)
    encryption: bytes = field(repr=False)


def new_key() -> str:
    """A fresh key as text."""
    return base64.urlsafe_b64encode(secrets.token_bytes(32)).decode()


def key_of(text: str) -> Key:
    """A key from its text: 32 bytes in URL-safe base64, padding optional."""
    try:
        raw = base64.b64decode(text.strip().translate(str.maketrans("-_", "+/")) + "=" * (-len(text.strip()) % 4), validate=True)
    except (binascii.Error, ValueError) as e:
        raise SealError("the key is no base64") from e
    if len(raw) != 32:
        raise SealError(f"the key has {len(raw)} bytes, not 32")
    return Key(raw[:16], raw[16:])


def found_key(file: str | None = None, environment: dict[str, str] | None = None) -> Key:
    """The key of the variable MISSIVE_DATASET_KEY, else of a file on the driver's machine."""
    text = (os.environ if environment is None else environment).get(VARIABLE, "")
    if not text and file and os.path.isfile(file):
        with open(file, encoding="utf-8") as f:
            text = f.read().strip()
    if not text:
        raise SealError(f"no key: neither {VARIABLE} nor a key file is set")
    return key_of(text)


def kept_key(file: str) -> str:
    """A fresh key, written to a file that only its owner can read."""
    text = new_key()
    with open(os.open(file, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        f.write(text + "\n")
    return text


def _with_key(rows: DataFrame, key: Key) -> DataFrame:
    pad = lambda x: bytes(a ^ x for a in key.signing.ljust(64, b"\0"))
    one = rows.sparkSession.createDataFrame([(bytearray(pad(0x36)), bytearray(pad(0x5C)), bytearray(key.encryption))], "_inner binary, _outer binary, _secret binary")
    return rows.crossJoin(F.broadcast(one))  # one row


def _mac(data: Column) -> Column:
    digest = lambda x: F.unhex(F.sha2(x, 256))
    return digest(F.concat(F.col("_outer"), digest(F.concat(F.col("_inner"), data))))


def seal(rows: DataFrame, column: str, key: Key) -> DataFrame:
    """rows with the token of a column of bytes or text in its place."""
    kept = rows.columns
    seconds = F.unhex(F.lpad(F.hex(F.unix_seconds(F.current_timestamp())), 16, "0"))
    body = F.concat(F.unhex(F.lit("80")), seconds, F.aes_encrypt(F.col(column).cast("binary"), F.col("_secret"), F.lit("CBC"), F.lit("PKCS")))
    made = _with_key(rows, key).withColumn("_body", body)  # a new vector each: written once below, not again for the code
    token = F.translate(F.base64(F.get(F.transform(F.array("_body"), lambda b: F.concat(b, _mac(b))), 0)), "+/\r\n", "-_")  # without the line ends that base64 may have
    return made.withColumn(column, token).select(*kept)


def opened(rows: DataFrame, column: str, key: Key) -> DataFrame:
    """rows with the bytes of a column of tokens in its place; a null stays null. The job ends at a token that the key does not fit or that is damaged."""
    kept = rows.columns
    made = _with_key(rows, key).withColumn("_raw", F.try_to_binary(F.translate(F.btrim(F.col(column), F.lit(" \t\r\n")), "-_", "+/"), F.lit("base64")))
    raw, n = F.col("_raw"), F.octet_length("_raw")
    whole = (n >= 73) & ((n - 57) % 16 == 0) & (F.substr(raw, F.lit(1), F.lit(1)) == F.unhex(F.lit("80")))
    good = whole & (_mac(F.substr(raw, F.lit(1), n - 32)) == F.substr(raw, n - 31, F.lit(32)))
    text = F.aes_decrypt(F.substr(raw, F.lit(10), n - 41), F.col("_secret"), F.lit("CBC"), F.lit("PKCS"))
    out = F.when(F.col(column).isNull(), F.lit(None).cast("binary")).when(F.coalesce(good, F.lit(False)), text).otherwise(F.raise_error(F.lit("sealed data: wrong key or damaged blob")))
    return made.withColumn(column, out).select(*kept)


def seal_file(spark: SparkSession, source: str, target: str, key: Key) -> None:
    """A file's bytes as one token in the folder target."""
    if not exists(spark, source):
        raise SealError(f"no file {source}")
    whole = spark.read.format("binaryFile").load(source).select(F.col("content").alias("value"))
    seal(whole, "value", key).coalesce(1).write.mode("overwrite").text(target)


def open_file(spark: SparkSession, source: str, key: Key) -> DataFrame:
    """(path, content) of sealed files: one, or a folder of them; content is bytes."""
    if not exists(spark, source):
        raise SealError(f"no sealed file {source}")
    rows = spark.read.text(source, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return opened(rows, "content", key)


def prepared(spark: SparkSession, plain: str, sealed: str, key_file: str | None = None, environment: dict[str, str] | None = None) -> str:
    """The place of a plain text file; it is made from the sealed one if it is not there, and only then a key is wanted.

    The copy is a folder with one part that ends with a newline. SealError: no key, no sealed file, a key that does not fit, a damaged one.
    """
    if exists(spark, plain):
        return plain
    text = open_file(spark, sealed, found_key(key_file, environment)).select(F.regexp_replace(F.decode("content", "UTF-8"), "\n$", "").alias("value"))
    try:
        text.coalesce(1).write.text(plain)
    except Exception as e:
        raise SealError(f"cannot open {sealed}: wrong key or damaged blob") from e
    return plain


def write_sealed(rows: DataFrame, path: str, key: Key) -> None:
    """A table as tokens of its rows' JSON, a line each."""
    lines = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    seal(lines, "value", key).write.mode("overwrite").text(path)


def read_sealed(spark: SparkSession, path: str, schema: str, key: Key) -> DataFrame:
    """The table again."""
    if not exists(spark, path):
        raise SealError(f"no sealed table {path}")
    rows = opened(spark.read.text(path), "value", key)
    return rows.select(F.from_json(F.decode("value", "UTF-8"), schema).alias("x")).select("x.*")
