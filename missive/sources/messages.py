"""Sources of messages: CSV, Parquet, and template messages made from order rows (the same SQL in Spark and elsewhere)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as X
from ..functions.text import utrim
from .delimited import records

COLUMNS = ("message_id", "timestamp", "sender", "message")
RAW = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


class SourceError(Exception):
    """The input cannot be used."""


def _status(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getFileStatus(place) if files.exists(place) else None


def read_csv(spark: SparkSession, path: str, *, missing_values: bool = True, folder: bool = False) -> DataFrame:
    """All columns as text, with row_pos in file order; optionally the usual markers of missing values as null.

    One large file is read by many tasks. SourceError: there is no such file, it is a folder (unless ``folder`` says that its files
    are wanted; they have the same header, and come in the order of their names), it is empty, or ends within quotes. A record of more
    fields than the header has ends the job that reads it.
    """
    found = _status(spark, path)
    if found is None:
        raise SourceError(f"no file {path}")
    if found.isDirectory() and not folder:
        raise SourceError(f"{path} is a folder")
    rows = records(spark, path).where("text is null or text <> ''")
    first = rows.groupBy("file").agg(F.min(F.struct("record", "text")).alias("x"), F.max("record").alias("last"), F.count_if(F.col("text").isNull()).alias("cut"))
    files = first.select("file", F.col("x.record").alias("header_at"), F.col("x.text").alias("header"), "last", "cut", F.coalesce(F.sum(F.col("last") + 1).over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"))
    headers = files.agg(F.count(F.lit(1)).alias("n"), F.min("header").alias("a"), F.max("header").alias("b"), F.sum("cut").alias("cut")).first()
    if not headers.n:
        raise SourceError(f"{path} is empty")
    if headers.cut:
        raise SourceError(f"{path} ends within quotes")
    if headers.a != headers.b:
        raise SourceError(f"the files of {path} have different headers")
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    names = spark.range(1).select(F.from_csv(F.lit(headers.a), ", ".join(f"c{i} string" for i in range(headers.a.count(",") + 1)), options).alias("x")).select("x.*").first()
    columns = [n for n in names if n is not None]
    more = "_more"
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))] + [T.StructField(more, T.StringType())])
    raw = rows.join(files.select("file", "header_at", "rows_before"), "file").where("record > header_at")
    raw = raw.select((F.col("rows_before") + F.col("record")).alias("row_pos"), F.from_csv("text", schema.simpleString(), options).alias("x"))
    fine = F.when(F.col(f"x.{more}").isNotNull(), F.raise_error(F.concat(F.lit("more fields than the header has, in record "), F.col("row_pos").cast("string")))).otherwise(F.col("x.c0"))
    values = [fine if i == 0 else F.col(f"x.c{i}") for i in range(len(columns))]
    if missing_values:
        values = [F.when(~v.isin(*X.MISSING), v) for v in values]
    return raw.select(*(v.alias(c) for v, c in zip(values, columns, strict=True)), "row_pos")


def parsed_timestamp(raw: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"), raw.try_cast("timestamp_ntz"))


def typed(raw: DataFrame) -> DataFrame:
    """Messages (message_id, ts, sender, message, row_pos) of validated raw rows."""
    return raw.select(utrim(F.col("message_id")).alias("message_id"), parsed_timestamp(F.col("timestamp")).alias("ts"), utrim(F.col("sender")).alias("sender"), utrim(F.col("message")).alias("message"), "row_pos")


def mandatory_ids(spark: SparkSession, path: str, *, expected: int | None = 15, folder: bool = False) -> DataFrame:
    """The column message_id of a CSV; unless expected is null, that many, none blank, none twice."""
    raw = read_csv(spark, path, folder=folder)
    if "message_id" not in raw.columns:
        raise SourceError("no column message_id")
    ids = raw.select(utrim(F.col("message_id")).alias("message_id"), "row_pos")
    if expected is not None:
        n, distinct, full = ids.agg(F.count(F.lit(1)), F.countDistinct("message_id"), F.count_if(F.coalesce("message_id", F.lit("")) != "")).first()
        if full < n:
            raise SourceError("blank message_id")
        if n != expected:
            raise SourceError(f"{n} ids, not {expected}")
        if distinct < n:
            raise SourceError("an id occurs twice")
    return ids


#: Message texts by o_orderkey % N; k is the key as text, d a date, n a six-digit number.
TEMPLATES = (
    "'Your OTP is ' || n || '. Please do not forward it.'",
    "'Password is Blue' || k || '#x and the verification code: ' || n",
    "'The ATM PIN is ' || substr(n, 1, 4) || ' for card ' || k",
    "'The access token is tok_demo_A' || n",
    "'Use sk-' || n || 'abc as api key: key' || k || 'Z9'",
    "'My card number is 4111 1111 1111 1111 and OTP ' || n",
    "'Pay to 4111-1111-1111-1111 or 4111 1111 1111 1112 (order ' || k || ')'",
    "'Bank account number: ' || n || n || ' at the branch.'",
    "'UPI id user' || k || '@okbank, thanks'",
    "'Send money to shop' || k || '@paybank today'",
    "'Call me at +91 98765 ' || substr(n, 1, 5) || ' please.'",
    "'My email is user' || k || '@example.com for this.'",
    "'Docs at help' || k || '@example.org are public.'",
    "'My home address is ' || k || ' Lake View Road, Chennai-45. Visit soon.'",
    "'PAN ABCDE' || substr(n, 1, 4) || 'F and aadhaar ' || substr(n, 1, 4) || ' 5678 9012'",
    "'Passport number is K' || n || '1 for booking.'",
    "'My recent test result says vitamin D deficiency-' || k || '. Rest well.'",
    "'CVV is ' || substr(n, 1, 3) || ' and wifi password guest' || k || '!'",
    "'Recovery code RC-' || n || ' expires by 2026-09-04.'",
    "'Driving licence KA' || n || ' 99 was renewed'",
    "'Please submit the report for order ' || k || ' by ' || d || '.'",
    "'Submit the report by ' || d || ' and pay the bill by tomorrow, then sign the form before next friday.'",
    "'Calendar update: family dinner ' || k || ', ' || d || ' at 10:00, the library.'",
    "'Reminder: mentor catch-up happens on ' || d || ' at 11:00 in the city clinic.'",
    "'The client discussion is scheduled for ' || d || ' at 2 pm in Zoom.'",
    "'Please join the internship orientation on ' || d || ', 9:00 at Conference Room 2.'",
    "'Are you available for the design review at 14:00 on ' || d || '? Location: the main office.'",
    "'Calendar update: demo day, next monday, classroom ' || k",
    "'Reminder: the standup happens on tomorrow in the auditorium.'",
    "'The product demo is scheduled for ' || d || ' in Zoom.'",
    "'Please call Maya when you are free.'",
    "'FYI: could you please reply by in three days; it is urgent'",
    "'Exclusive offer: get 50% off order ' || k || ' this weekend, use code SAVE17!'",
    "'I am vegetarian and my t-shirt size is M.'",
    "'The training material ' || k || ' is on the portal.'",
    "'The cafeteria closes at 8 PM.'",
    "'Can you check the review gathering schedule asap?'",
    "'Meet at 45 tomorrow at the library'",
    "'The audit is scheduled for 2026-13-45 at 9:00 in Room 1'",
    "'Calendar update: late sync, today at 45, hall'",
    "'   '",
    "'Bank account number ' || n || n || ', security code ' || n || ' and seed phrase word' || k || '9'",
    "'Your deal is due on this friday; no rush, whenever'",
    "'hi, please make sure to renew the pass before in 3 days'",
    "'My shoe size is 9 and i love the flash sale discount.'",
    "'Contact Ravi and reach out to Meera immediately'",
    "'Personal email: write to me at user' || k || '@example.com or user' || k || '@okaxis'",
    "'Session eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiI' || n || 'In0.c2lnbmF0dXJl' || k || ' has ended'",
    "'Password: #*%# for now, ticket ' || k",
    "'login details admin' || k || ' / pass' || k || 'word; my place: 12 Hill Road'",
)


def template_sql(orders: str) -> str:
    """SQL of (message_id, ts, sender, message, row_pos) over a table of orders."""
    cases = "\n    ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(TEMPLATES))
    return f"""
  SELECT 'MSG_' || k AS message_id, ts, sender, CASE m
    {cases} END AS message, row_pos
  FROM (SELECT CAST(o_orderkey AS STRING) AS k, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, CAST(100000 + (o_orderkey * 7919) % 900000 AS STRING) AS n,
    o_orderkey % {len(TEMPLATES)} AS m, o_orderdate AS ts, 'Customer#' || CAST(o_custkey AS STRING) AS sender, o_orderkey AS row_pos FROM {orders})"""


def template_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(template_sql("{orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
