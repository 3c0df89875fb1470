"""Readers. All are lazy; schemas are given or fixed, never inferred from data on a cluster."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.schema import RECORD

GROUND_TRUTH = ("f_name", "molecule_name", "test_type", "test_text", "opsin_smiles", "notes")
_CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}


def files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """Rows (path, length, content) of all files that end in suffix, a dot isn't needed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "length", "content")


def document_pages(documents: DataFrame) -> DataFrame:
    """Rows (path, page, text, error) of (path, content): the pages of PDF files, one page at a time.

    Needs a PDF library on the executors; a file that can't be read, or a missing library, gives one row with the error instead of ending
    the job. Text files give one page.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    for n, text in enumerate(_page_texts(path, bytes(content))):
                        yield pd.DataFrame({"path": [path], "page": [n], "text": [text], "error": [None]})
                except Exception as e:  # one bad file must not end the job
                    yield pd.DataFrame({"path": [path], "page": [None], "text": [None], "error": [f"{type(e).__name__}: {e}"[:500]]})

    return documents.select("path", "content").mapInPandas(pages, "path string, page int, text string, error string")


def _page_texts(path: str, content: bytes) -> Iterator[str]:
    if not content.startswith(b"%PDF"):
        yield content.decode("utf-8")
        return
    try:
        import fitz  # optional
    except ImportError:
        from pypdf import PdfReader  # optional

        import io

        for page in PdfReader(io.BytesIO(content)).pages:
            yield page.extract_text()
        return
    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            yield page.get_text()


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """The ground-truth CSV, by column name; columns that the file lacks are null."""
    raw = spark.read.options(**_CSV).csv(path)
    return raw.select(*(F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in GROUND_TRUTH))


def wide_csv(spark: SparkSession, path: str, name_column: str = "molecule_name", image_column: str = "image_path") -> DataFrame:
    """The wide database CSV without index columns; the name column is needed, a missing image column is empty."""
    df = csv_or_tab(spark, path)
    df = df.drop(*(c for c in df.columns if c in ("Unnamed: 0", "index", "_c0", "")))
    if name_column not in df.columns:
        raise ValueError(f"{path} has no column {name_column}")
    return df if image_column in df.columns else df.withColumn(image_column, F.lit(""))


def csv_or_tab(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with commas or, if its first line has more of them, tabs."""
    first = spark.read.text(path).limit(1).collect()
    head = first[0][0] if first else ""
    return spark.read.options(**_CSV, sep="\t" if head.count("\t") > head.count(",") else ",").csv(path)


def extraction_json(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Nested extraction records, one a line or file; strict: a record that doesn't fit the schema ends the job."""
    return spark.read.schema(RECORD).options(multiLine=True, mode="FAILFAST" if strict else "PERMISSIVE").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of a file that is one JSON array, with their position as _idx."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("_idx", "e")).select(F.col("_idx").cast("bigint").alias("_idx"), "e.*")


def third_party_records(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, kind, nucleus, names, labels, shifts) of another extractor's records: entries whose key holds ``Spectrum``.

    A shift that isn't a number is -999; a range gives both ends.
    """
    entry = "struct<nucleus:string,compound:struct<Compound:struct<names:array<string>,labels:array<string>>>,peaks:array<struct<NmrPeak:struct<shift:string>>>>"
    each = df.select(key, F.explode(F.from_json(column, f"array<map<string,{entry}>>")).alias("m")).select(key, F.explode("m").alias("kind", "s")).filter(F.contains("kind", F.lit("Spectrum")))
    cleaned = lambda p: F.trim(F.replace(F.replace(F.replace(p["NmrPeak"]["shift"], F.lit("\n"), F.lit(" ")), F.lit("cm-1"), F.lit("")), F.lit("–"), F.lit("-")))
    parts = F.filter(F.flatten(F.transform(F.filter("s.peaks", lambda p: p["NmrPeak"]["shift"] != ""), lambda p: F.split(cleaned(p), "(?<=[0-9.])-"))), lambda x: x != "")
    return each.select(key, "kind", "s.nucleus", F.col("s.compound.Compound.names").alias("names"), F.col("s.compound.Compound.labels").alias("labels"), F.transform(parts, lambda x: F.coalesce(x.try_cast("double"), F.lit(-999.0))).alias("shifts"))


def annotation_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows (task_id, result) of an annotation server's exported JSON array; result is the JSON of the first annotation's entries."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["value"]:
                tasks = json.loads(text)
                yield pd.DataFrame({"task_id": [int(t.get("id", i)) for i, t in enumerate(tasks)], "result": [json.dumps((t.get("annotations") or [{}])[0].get("result", [])) for t in tasks]})

    return spark.read.text(path, wholetext=True).mapInPandas(load, "task_id bigint, result string")
