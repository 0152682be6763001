"""Sources: report folders, delimited files, configuration files, study folders, score folds."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from io import BytesIO
from xml.etree import ElementTree
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radweave.functions.text import strip


def scan_reports(spark: SparkSession, folder: str, keep_empty: bool = False) -> DataFrame:
    """(study_id, report_text) of a folder of ``*.txt``: id is the file's stem, text stripped, empty ones dropped.

    Bytes that are no UTF-8 become replacement characters. A folder without such files is an error. Spark lists files of zero
    bytes but gives no row for them: with ``keep_empty`` every listed path without a row becomes an empty text.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    listed = spark.sparkContext._jvm.org.apache.hadoop.util.StringUtils.join("\n", files._jdf.inputFiles())  # encoded URIs hold no line end
    if not listed:
        raise FileNotFoundError(f"no .txt files in {folder}")
    df = files.select("path", strip(F.make_valid_utf8(F.col("content").cast("string"))).alias("report_text"))
    if keep_empty:
        uri = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
        known = spark.createDataFrame(pa.table({"uri": listed.split("\n")})).select(_one_slash(uri).alias("path"))
        unread = known.join(files.select(_one_slash(F.col("path")).alias("path")), "path", "left_anti")
        df = df.unionByName(unread.select("path", F.lit("").alias("report_text")))
    df = df.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("study_id"), "report_text")
    return df if keep_empty else df.filter("report_text <> ''")


def _one_slash(path: Column) -> Column:
    """A path with one slash after its scheme: Spark's listing and its rows differ in their number."""
    return F.regexp_replace(path, "^([^:/]+):/+", "$1:/")


def read_csv(spark: SparkSession, path: str, schema: str, one_line_rows: bool = False) -> DataFrame:
    """Delimited file with a declared schema; quoted fields may hold line ends and doubled quotes.

    A file whose rows may hold line ends is one task; ``one_line_rows`` says that none does, so large files are split.
    """
    return spark.read.csv(path, schema=schema, header=True, multiLine=not one_line_rows, quote='"', escape='"')


def read_xlsx(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """First sheet of every spreadsheet at ``path``: the first row names the columns, cells are cast to the schema.

    Sheets are read as the zipped XML they are, one file a task; columns that a sheet lacks are null.
    """
    names = spark.createDataFrame([], schema).schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                head, *rows = _sheet(content) or [[]]
                at = [head.index(n) if n in head else None for n in names]
                cols = [[r[k] if k is not None and k < len(r) else None for r in rows] for k in at]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    raw = files.mapInArrow(run, ", ".join(f"`{n}` string" for n in names))
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema])


def _sheet(content: bytes) -> list[list[str | None]]:
    """Cell texts of the first sheet, row by row; empty cells are null."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n))
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{ns}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{ns}c"):
                place = 0
                for letter in re.match("[A-Z]*", c.get("r") or "")[0]:
                    place = 26 * place + ord(letter) - 64
                cells += [None] * (place - 1 - len(cells))
                value = c.find(f"{ns}v")
                text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else None if value is None else value.text
                cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
            rows.append(cells)
    return rows


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path inside it, of a local path or a URI on shared storage."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else Path(path).resolve().as_uri())


def read_text(path: str) -> str:
    """Text of one small file, local or on shared storage."""
    fs, inner = _open(path)
    with fs.open_input_stream(inner) as f:
        return f.read().decode("utf-8")


def first_existing(candidates: Sequence[str]) -> str:
    """First of the paths that exists, locally or on shared storage."""
    for c in map(str, candidates):
        fs, inner = _open(c)
        if fs.get_file_info(inner).type != pafs.FileType.NotFound:
            return c
    raise FileNotFoundError(f"none of {list(candidates)} exists")


def load_lexicon(spark: SparkSession, candidates: Sequence[str]) -> DataFrame:
    """Lexicon table from a JSON object label -> phrases; order and repeats kept, Normal numbered 0."""
    data = json.loads(read_text(first_existing(candidates)))
    order = ["Normal", *[k for k in data if k != "Normal"]]
    rows = [(label, i, k, phrase) for i, label in enumerate(order) for k, phrase in enumerate(data.get(label, []))]
    return spark.createDataFrame(rows, "label string, label_idx int, phrase_idx int, phrase string")


def load_thresholds(path: str) -> dict[str, float]:
    """Label thresholds of a JSON file."""
    return {k: float(v) for k, v in json.loads(read_text(path)).items()}


def load_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Hierarchy table from a YAML file with ``pathology_to_category``; only flat ``name: group`` lines are read."""
    rows, inside = [], False
    for line in read_text(path).splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if not line[0].isspace():
            inside = line.startswith("pathology_to_category:")
        elif inside:
            key, _, value = line.strip().rpartition(":")
            rows.append((key.strip().strip("\"'"), len(rows), value.strip().strip("\"'")))
    return spark.createDataFrame(rows, "label string, label_idx int, tier2 string")


def load_settings(path: str) -> dict[str, str | list[str]]:
    """Settings of a YAML file of nested names, by dotted name; values are texts, bracketed ones lists of texts. Nothing else of YAML is read."""
    out: dict[str, str | list[str]] = {}
    above: list[tuple[int, str]] = []
    for line in read_text(path).splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip())
        key, _, value = line.strip().partition(":")
        while above and above[-1][0] >= depth:
            above.pop()
        value = value.strip()
        if value.startswith("["):
            out[".".join([*(k for _, k in above), key])] = [v.strip().strip("\"'") for v in value.strip("[]").split(",") if v.strip()]
        elif value:
            out[".".join([*(k for _, k in above), key])] = value.strip("\"'")
        else:
            above.append((depth, key))
    return out


def study_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(study_id, file, length, content) of all files below the study folders of ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("study_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "content")


def fold_numbers(scores: DataFrame) -> DataFrame:
    """Folds present in a score table; an error if there is none."""
    folds = scores.select("fold").filter("fold is not null").distinct()
    if folds.isEmpty():
        raise FileNotFoundError("no model folds")
    return folds
