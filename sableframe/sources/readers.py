"""Sources and sinks, through Spark's readers and writers, and seams for formats and models that are not here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CAS = "`%FEATURE_STRUCTURES` array<struct<`%TYPE`:string,`begin`:int,`end`:int,`value`:string>>"


def files(spark: SparkSession, folder: str, extension: str = "pdf") -> DataFrame:
    """(path, modificationTime, length, content) of files below a folder, by an extension in any case."""
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension.lstrip("."))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{either}").load(folder)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header and a known schema."""
    return spark.read.csv(path, header=True, schema=schema)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(path, type, start, end, value): the feature structures of annotation files in JSON."""
    raw = spark.read.schema(_CAS).option("multiLine", "true").json(path).withColumn("path", F.col("_metadata.file_path"))
    rows = raw.select("path", F.explode("`%FEATURE_STRUCTURES`").alias("f"))
    return rows.select("path", F.col("f.`%TYPE`").alias("type"), F.col("f.begin").alias("start"), F.col("f.end").alias("end"), F.col("f.value").alias("value"))


#: The type of named entities in annotation files, and the labels that are read.
ENTITY_TYPE = "de.tudarmstadt.ukp.dkpro.core.api.ner.type.NamedEntity"
ENTITY_LABELS = ("ORG", "POST_CODE", "ADDR", "LOC", "DATE", "PERSON")


def named_annotations(rows: DataFrame, keys: list[str], kind: str = ENTITY_TYPE, labels: tuple[str, ...] = ENTITY_LABELS) -> DataFrame:
    """(keys, ord, start, end, value): annotations (keys, type, start, end, value) of one type with one of the labels, in the order of their start."""
    kept = rows.where((F.col("type") == kind) & F.col("value").isin(*labels))
    return kept.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end", "value")) - 1).alias("ord"), "start", "end", "value")


def tokenised(spark: SparkSession, path: str) -> DataFrame:
    """(example_id, tokens, labels) of a Parquet export of a tokenised dataset (id, tokens, labels)."""
    return spark.read.parquet(path).select(F.col("id").cast("string").alias("example_id"), "tokens", F.col("labels").cast("array<int>").alias("labels"))


def annotated_texts(spark: SparkSession, annotation_folder: str, text_folder: str) -> tuple[DataFrame, DataFrame]:
    """(stem, text, type, start, end, value) of annotation files with the text file of the same name, and the stems that have no text."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?$", 1)
    marks = annotations(spark, annotation_folder).withColumn("stem", stem(F.col("path")))
    texts = spark.read.text(text_folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("text"))
    return marks.drop("path").join(texts, "stem").select("stem", "text", "type", "start", "end", "value"), marks.select("stem").distinct().join(texts, "stem", "left_anti")


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One line of text per row."""
    df.select(column).write.mode("append").text(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


class Seam:
    """A step done by a model or format library: a function on batches of rows, given by the user.

    Without one, using the seam is an error; it never returns nothing in silence.
    """

    def __init__(self, name: str, schema: str):
        self.name, self.schema, self.run = name, schema, None

    def provide(self, run: Callable) -> None:
        """``run`` takes and yields pandas batches, as ``mapInPandas`` does; it may load its model once."""
        self.run = run

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.run is None:
            raise RuntimeError(f"no implementation of '{self.name}' has been provided")
        return df.mapInPandas(self.run, self.schema)


PDF_LINES = Seam("pdf lines", "path string, page int, block int, line int, line_text string, x0 double, y0 double, x1 double, y1 double")
NAMED_ENTITIES = Seam("named entities", "doc_id long, label string, start int, end int")
OCR = Seam("optical character recognition", "path string, line_text string, x0 double, y0 double, x1 double, y1 double, score double")
HANDWRITING = Seam("handwriting", "path string, is_signature boolean")
PARAPHRASES = Seam("paraphrases", "example_id long, variant int, text string")
PDF_IMAGES = Seam("pdf images", "path string, page int, xref int, extension string, content binary, x0 double, y0 double, x1 double, y1 double")
PDF_DRAWINGS = Seam("pdf drawings", "path string, page int, drawing int, ord int, op string, points array<struct<x:double,y:double>>")
PDF_SINK = Seam("pdf sink", "path string, output string, n_commands long")
SYSTEM_FONTS = Seam("system fonts", "ord int, full_name string, family string, path string")
ACRONYM_TAGS = Seam("acronym tags", "doc_id long, ord int, tag string, text string, tok_start int, tok_end int, sent int")
TEXT_VECTORS = Seam("text vectors", "text string, vector array<double>")
