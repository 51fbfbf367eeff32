"""Scans and sinks: whole texts, corpora, question files, word lists, verified datasets."""

import hashlib

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X

CATEGORIES = ("redundant", "unique", "mixed")
QA = "question string, answer string"


class DatasetIntegrityError(RuntimeError):
    """A dataset's bytes are not the expected ones."""


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row for each file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def category_of(name: Column) -> Column:
    first = F.substring_index(name, "_", 1)
    return F.when(first.isin(*CATEGORIES), first).otherwise(F.lit("other"))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(name, category, path, text) of the folder's *.txt, by name."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    d = files.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return d.select("name", category_of(F.col("name")).alias("category"), "path", "text").orderBy("name")


def read_source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, lang, src)."""
    return read_texts(spark, path).select("path", X.language(F.col("path")).alias("lang"), F.col("text").alias("src"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a broken one is an error."""
    return spark.read.schema(QA).option("mode", "FAILFAST").json(path)


def parse_questions(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from lines that are already rows."""
    parsed = F.from_json(F.col(column), QA, {"mode": "FAILFAST"})
    return lines.where(X.strip(F.col(column)) != "").select(parsed.alias("r")).select("r.question", "r.answer")


def missing(error: AnalysisException) -> bool:
    """Whether a read failed because there is no such file."""
    return "PATH_NOT_FOUND" in (error.getCondition() or str(error))


def read_verified(spark: SparkSession, path: str, sha256: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """A question file whose digest and number of rows must be as expected; without the file, the built-in sample.

    Returns (records, where they come from). Only the digest reaches the driver.
    """
    try:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).collect()
    except AnalysisException as e:
        if not missing(e):
            raise
        return builtin_questions(spark), "bundled_fallback"
    if [r["d"] for r in found] != [sha256]:
        raise DatasetIntegrityError(f"{path} has another digest than {sha256}")
    records = read_questions(spark, path)
    if rows is not None and (n := records.count()) != rows:
        raise DatasetIntegrityError(f"{path} has {n} rows, not {rows}")
    return records, f"verified:{sha256[:12]}"


# Ten questions of our own, for runs without a dataset.
BUILTIN = [
    ("A baker fills 6 trays with 12 rolls each and sells 50 rolls. How many are left?", "6*12 = 72 rolls, 72-50 = 22.\n#### 22"),
    ("Lena reads 15 pages a day for 8 days. How many pages is that?", "15*8 = 120.\n#### 120"),
    ("A train of 9 cars has 40 seats in each car. 275 seats are taken. How many are free?", "9*40 = 360, 360-275 = 85.\n#### 85"),
    ("A shirt costs $40 and is sold at 25% off. What is its price?", "40*0.25 = 10, 40-10 = 30.\n#### 30"),
    ("Three friends share 2,100 points equally. How many does each get?", "2100/3 = 700.\n#### 700"),
    ("A tank holds 80 litres and loses 2.5 litres an hour. What is left after 4 hours?", "2.5*4 = 10, 80-10 = 70.\n#### 70"),
    ("It was 3 degrees and fell by 8 degrees. What is it now?", "3-8 = -5.\n#### -5"),
    ("A rope of 18 metres is cut into pieces of 1.5 metres. How many pieces are there?", "18/1.5 = 12.\n#### 12"),
    ("Omar saves $35 a week. How much does he have after 52 weeks?", "35*52 = 1,820.\n#### 1,820"),
    ("A class of 28 has 4 more girls than boys. How many boys are there?", "(28-4)/2 = 12.\n#### 12"),
]


def builtin_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUILTIN, QA)


def marked_block(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """(line) between two marks of a text file, in order; blank lines, comments and fences are skipped."""
    t = read_texts(spark, path).where(F.col("text").contains(start) & F.col("text").contains(end))
    block = F.substring_index(F.substring(F.col("text"), F.instr("text", F.lit(start)) + len(start), F.length("text")), end, 1)
    lines = t.select(F.posexplode(F.split(block, "\\r?\\n")).alias("ord", "line")).withColumn("line", X.strip(F.col("line")))
    return lines.where("line != '' AND NOT startswith(line, '#') AND NOT startswith(line, '```')")


def read_fillers(spark: SparkSession, path: str, start: str, end: str) -> tuple[str, ...]:
    """Filler phrases in file order; the built-in ones, if there are none. A word list is small by nature."""
    try:
        found = [r["line"] for r in marked_block(spark, path, start, end).orderBy("ord").collect()]
    except AnalysisException as e:
        if not missing(e):
            raise
        found = []
    return tuple(found) or K.FILLERS


def read_phrases(spark: SparkSession, path: str, start: str, end: str) -> tuple[tuple[str, str], ...]:
    """``from => to`` lines, longest first, ties in file order; the built-in ones, if there are none."""
    try:
        rows = marked_block(spark, path, start, end).where(F.col("line").contains("=>"))
        pair = rows.select("ord", X.strip(F.substring_index("line", "=>", 1)).alias("a"), X.strip(F.expr("substring(line, instr(line, '=>') + 2)")).alias("b"))
        found = [(r["a"], r["b"]) for r in pair.where("a != '' AND lower(a) != lower(b)").orderBy(F.length("a").desc(), "ord").collect()]
    except AnalysisException as e:
        if not missing(e):
            raise
        found = []
    return tuple(found) or tuple(K.longest_first())


def write_texts(df: DataFrame, path: str, column: str = "reduced") -> None:
    """A line-broken text for each row."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> int:
    """Results as JSON, a file for each task; returns 0, or 1 where the sink cannot be written. A fault of the results
    themselves is raised."""
    df.schema  # analysed before the sink is tried
    try:
        df.write.mode("overwrite").json(path)
    except (Py4JError, PySparkException, OSError) as e:
        if "SparkException" in type(e).__name__ or "Job aborted due to stage failure" in str(e):
            raise
        return 1
    return 0


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
