"""JSON lines, three-line records, verdict maps and the vector cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry import schemas
from lexiquarry.functions import text as T
from lexiquarry.session import exists
from lexiquarry.sources import committed


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.DOCUMENT, tolerant: bool = False) -> DataFrame:
    """Rows of a JSON lines file; blank lines are passed over. ``tolerant``: broken lines too, and a missing file is empty."""
    if not exists(spark, path):
        if tolerant:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def present_ids(spark: SparkSession, path: str, key: str = "document_number") -> DataFrame:
    """Ids that an earlier run wrote, even if its last line was cut."""
    return read_jsonl(spark, path, f"{key} string", tolerant=True).where(F.col(key).isNotNull()).distinct()


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(place, gold_doc, question, answer)`` from DOC / Q / A records; the answer NONE is null."""
    pattern = r"(?md)^DOC:\s*(\S+)\s*\n^Q:\s*(.+?)\s*\n^A:\s*(.+?)\s*$"
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract_all("value", F.lit(pattern), F.lit(0)).alias("m"))
    rows = whole.select(F.posexplode("m").alias("place", "r"))
    answer = T.strip(F.regexp_extract("r", pattern, 3))
    return rows.select("place", F.regexp_extract("r", pattern, 1).alias("gold_doc"), T.strip(F.regexp_extract("r", pattern, 2)).alias("question"), F.when(F.upper(answer) != "NONE", answer).alias("answer"))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdict rows of JSON objects keyed by answer: one file that people or another tool wrote, or what :func:`write_verdicts` committed; nothing there has none."""
    found = committed.parts(spark, path) or ([path] if exists(spark, path) and not exists(spark, f"{path.rstrip('/')}/commits") else [])
    if not found:
        return spark.createDataFrame([], schemas.VERDICT)
    kind = "map<string, struct<verdict:string,id:string,question:string,expected:string,generated:string>>"
    rows = spark.read.text(found, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("answer_key", "v"))
    return rows.select("answer_key", "v.*")


def write_verdicts(df: DataFrame, path: str, each: int = 10_000) -> None:
    """The same objects again, about ``each`` verdicts to a file; they replace those that are there in one step."""
    rows = df.select("answer_key", "verdict", "id", "question", "expected", "generated")
    files = max(1, -(-rows.count() // each))
    committed.write(rows.repartitionByRange(files, "answer_key").sortWithinPartitions("answer_key"), path, key="answer_key", append=False)


def content_digest(chunks: DataFrame) -> str:
    """A digest of chunk ids and texts that does not depend on their order, and is computed without gathering them."""
    n, x, s = chunks.agg(F.count("*"), F.bit_xor(F.xxhash64("chunk_id", "text")), F.sum(F.xxhash64("text", "chunk_id").cast("decimal(38,0)"))).first()
    return f"{n}-{x or 0}-{s or 0}"


def cached_vectors(chunks: DataFrame, path: str, model: str, make, rebuild: bool = False) -> DataFrame:
    """Vectors of ``chunks`` from ``path`` if they were made by the same model of the same content; else made by ``make(chunks)`` and written."""
    spark = chunks.sparkSession
    digest = content_digest(chunks)
    note = f"{path}/about"
    if not rebuild and exists(spark, note):
        about = spark.read.json(note).first()
        if about and about.model == model and about.digest == digest:
            return spark.read.parquet(f"{path}/vectors")
    make(chunks).write.mode("overwrite").parquet(f"{path}/vectors")
    spark.createDataFrame([(model, digest)], "model string, digest string").coalesce(1).write.mode("overwrite").json(note)
    return spark.read.parquet(f"{path}/vectors")
