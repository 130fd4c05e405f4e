"""Files that many tasks read, sealed data, and artifacts record by record."""

import base64
import hmac
import os
import random
import time

import pytest
from missive.sources import sealed
from missive.sources.messages import SourceError, mandatory_ids, read_csv
from pyspark.sql import functions as F


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "0"))
    for k, v in old.items():
        spark.conf.set(k, v)


def plain(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def fields(rng):
    pieces = ["a", "b c", "é😀", "5\" pipe", "", "x"]
    quoted = ['""', "\n", ",", "a", "\n\n", '"",', "\r\n", "é"]
    return rng.choice(pieces) if rng.random() < 0.5 else '"' + "".join(rng.choices(quoted, k=rng.randint(0, 6))) + '"'


def test_records_cut_at_every_byte(spark, small_splits, tmp_path):
    text = 'message_id,timestamp,sender,message\nA,1,s,"x\n""y"", z\n\n"\nB,2,5" s,q\n\nC,3,,"""\n"""\n'
    path = tmp_path / "m.csv"
    path.write_text(text)
    want = [tuple(r) for r in plain(spark, str(path)).collect()]
    assert len(want) == 3
    for n in (1, 2, 7, 20):  # one: cut at every byte
        small_splits(n)
        rows = read_csv(spark, str(path), missing_values=False).orderBy("row_pos").collect()
        assert [tuple(r)[:-1] for r in rows] == want, n


def test_records_as_the_reader_of_whole_files(spark, small_splits, tmp_path):
    rng = random.Random(1)
    small_splits(150)
    for k in range(2):
        body = "".join(f"{i}," + ",".join(fields(rng) for _ in range(3)) + "\n" for i in range(120))
        path = tmp_path / f"m{k}.csv"
        path.write_bytes(("﻿" * (k == 1) + "message_id,timestamp,sender,message\n" + body).encode())
        got = read_csv(spark, str(path), missing_values=False)
        rows = got.orderBy("row_pos").collect()
        assert [tuple(r)[:-1] for r in rows] == [tuple(r) for r in plain(spark, str(path)).collect()]


def test_files_that_cannot_be_used(spark, tmp_path):
    with pytest.raises(SourceError, match="no file"):
        read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(SourceError, match="folder"):
        read_csv(spark, str(tmp_path))
    for name, text, says in (("empty", "", "empty"), ("blank", "\n\n", "empty"), ("open", 'a,b\n1,"x\n', "quotes")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(SourceError, match=says):
            read_csv(spark, str(tmp_path / f"{name}.csv"))
    (tmp_path / "more.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="more fields"):
        read_csv(spark, str(tmp_path / "more.csv")).collect()
    (tmp_path / "header.csv").write_text("a,b\n")
    assert read_csv(spark, str(tmp_path / "header.csv")).columns == ["a", "b", "row_pos"] and read_csv(spark, str(tmp_path / "header.csv")).isEmpty()
    folder = tmp_path / "many"
    folder.mkdir()
    for k in (2, 1):
        (folder / f"{k}.csv").write_text(f"a,b\n{k},x\n{k},NA\n")
    assert [(r.a, r.b) for r in read_csv(spark, str(folder), folder=True).orderBy("row_pos").collect()] == [("1", "x"), ("1", None), ("2", "x"), ("2", None)]


def test_mandatory_ids_strict_and_lenient(spark, tmp_path):
    cases = {"other\n1\n": "no column", "message_id,x\nA,1\n,2\n": "blank", "message_id\nA\n": "1 ids", "message_id\nA\n A \n": "twice"}
    for i, (text, says) in enumerate(cases.items()):
        path = tmp_path / f"{i}.csv"
        path.write_text(text)
        with pytest.raises(SourceError, match=says):
            mandatory_ids(spark, str(path), expected=2)
    assert [r.message_id for r in mandatory_ids(spark, str(tmp_path / "3.csv"), expected=None).orderBy("row_pos").collect()] == ["A", "A"]


def test_sealed_files(spark, tmp_path):
    text = 'message_id,timestamp,sender,message\nM1,2026-09-01 08:00:00,A,"x, ""é😀""\nz"\n'
    (tmp_path / "m.csv").write_text(text)
    secret = sealed.kept_key(f"{tmp_path}/key")
    key = sealed.found_key(f"{tmp_path}/key", {})
    assert os.stat(tmp_path / "key").st_mode & 0o777 == 0o600 and secret not in repr(key)
    sealed.seal_file(spark, f"{tmp_path}/m.csv", f"{tmp_path}/m.sealed", key)
    blob = next((tmp_path / "m.sealed").glob("part*")).read_text().strip()
    assert "message_id" not in blob and bytes(sealed.open_file(spark, f"{tmp_path}/m.sealed", key).first().content) == text.encode()
    raw = base64.urlsafe_b64decode(blob)  # the public format, by hand
    full = base64.urlsafe_b64decode(secret)
    assert raw[0] == 0x80 and abs(int.from_bytes(raw[1:9], "big") - time.time()) < 600 and hmac.new(full[:16], raw[:-32], "sha256").digest() == raw[-32:]
    assert read_csv(spark, sealed.prepared(spark, f"{tmp_path}/plain", f"{tmp_path}/m.sealed", f"{tmp_path}/key", {}), folder=True).first().message == 'x, "é😀"\nz'
    assert sealed.prepared(spark, f"{tmp_path}/plain", "nowhere", None, {}) == f"{tmp_path}/plain"  # there already: no key needed
    other = sealed.new_key()
    with pytest.raises(sealed.SealError, match="wrong key"):
        sealed.prepared(spark, f"{tmp_path}/plain2", f"{tmp_path}/m.sealed", f"{tmp_path}/key", {sealed.VARIABLE: other})  # the variable comes first
    with pytest.raises(sealed.SealError, match="no key"):
        sealed.prepared(spark, f"{tmp_path}/plain3", f"{tmp_path}/m.sealed", f"{tmp_path}/none", {})
    with pytest.raises(sealed.SealError, match="no sealed file"):
        sealed.prepared(spark, f"{tmp_path}/plain3", f"{tmp_path}/none", f"{tmp_path}/key", {})
    flipped = base64.urlsafe_b64encode(raw[:40] + bytes([raw[40] ^ 1]) + raw[41:]).decode()
    for bad in (blob[:-8], flipped, "", "no base64 !", blob[:40]):
        rows = spark.createDataFrame([(bad,)], "content string")
        with pytest.raises(Exception, match="wrong key or damaged"):
            sealed.opened(rows, "content", key).collect()
    for text in ("short", "ü" * 43, other[:-4] + "AA", other + "AAAA"):
        with pytest.raises(sealed.SealError):
            sealed.key_of(text)


def test_sealed_tables(spark, tmp_path):
    key = sealed.key_of(sealed.new_key())
    rows = spark.range(500).selectExpr("id", "CASE WHEN id % 7 > 0 THEN concat('text ', id, '\n\"é') END AS text", "id % 2 = 0 AS even")
    sealed.write_sealed(rows.repartition(3), f"{tmp_path}/t", key)
    again = sealed.read_sealed(spark, f"{tmp_path}/t", "id long, text string, even boolean", key)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
    tokens = spark.read.text(f"{tmp_path}/t")
    assert tokens.distinct().count() == 500 and tokens.where(F.contains("value", F.lit("text"))).isEmpty()
    plan = sealed.opened(tokens, "value", key)._jdf.queryExecution().toString().lower()
    assert key.encryption.hex() not in plan and str(list(key.encryption))[1:-1] not in plan
    with pytest.raises(Exception, match="wrong key"):
        sealed.read_sealed(spark, f"{tmp_path}/t", "id long", sealed.key_of(sealed.new_key())).collect()
    assert sealed.opened(spark.sql("SELECT CAST(NULL AS string) AS value"), "value", key).first().value is None
