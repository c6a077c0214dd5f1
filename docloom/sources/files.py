"""Readers of document files as pages, archives, tolerant stores; writers of registers and keyed tables.

Files come through Spark's ``binaryFile`` source, so any store Spark reads will do; extraction runs in Arrow
batches on the executors.  Formats that need other libraries (PDF, images) are entries to add to ``EXTRACTORS``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrow import decode_bytes, html_text, xml_text

#: loc, text, is_table of a unit of a file.
Unit = tuple[str, str, bool]

# File types that are taken in; sizes of units in characters; the largest member of an archive.
SUPPORTED = ["pdf", "docx", "doc", "xlsx", "xls", "txt", "md", "csv", "xml", "html", "png", "jpg", "jpeg", "tif", "tiff"]
DOCX_UNIT, SHEET_UNIT, LARGEST_MEMBER = 1500, 1800, 1_500_000_000


def _text(raw: bytes) -> list[Unit]:
    return [("файл", decode_bytes(raw) or "", False)]


def _csv(raw: bytes) -> list[Unit]:
    return [("файл", decode_bytes(raw) or "", True)]


def _xml(raw: bytes) -> list[Unit]:
    found = xml_text(raw)
    return [("файл", found if found is not None else decode_bytes(raw) or "", False)]


def _html(raw: bytes) -> list[Unit]:
    return [("файл", html_text(decode_bytes(raw)), False)]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _docx(raw: bytes) -> list[Unit]:
    """Paragraphs in units of about ``DOCX_UNIT`` characters, then each table as a unit of rows."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = next(e for e in ET.fromstring(z.read("word/document.xml")) if _local(e.tag) == "body")
    words = lambda e: "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")
    out: list[Unit] = []
    held: list[str] = []
    for p in [words(e) for e in body if _local(e.tag) == "p"]:
        if p.strip():
            held.append(p.strip())
        if sum(map(len, held)) >= DOCX_UNIT:
            out.append((f"фрагмент {len(out) + 1}", "\n".join(held), False))
            held = []
    if held:
        out.append((f"фрагмент {len(out) + 1}", "\n".join(held), False))
    for n, table in enumerate((e for e in body if _local(e.tag) == "tbl"), 1):
        rows = [" | ".join(words(c).strip() for c in r if _local(c.tag) == "tc") for r in table if _local(r.tag) == "tr"]
        out.append((f"таблица {n}", "\n".join(rows), True))
    return out


def sheet_line(cells: list[str | None]) -> str:
    """Cells joined by a pipe; empty ones keep their place, trailing ones go."""
    filled = ["" if c is None else str(c) for c in cells]
    while filled and not filled[-1]:
        filled.pop()
    return " | ".join(filled)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _xlsx(raw: bytes) -> list[Unit]:
    """Rows of each sheet in units of about ``SHEET_UNIT`` characters."""
    out: list[Unit] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        for n, name in enumerate(sorted((x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: int(re.search(r"\d+", x)[0])), 1):
            held: list[str] = []
            for row in (e for e in ET.fromstring(z.read(name)).iter() if _local(e.tag) == "row"):
                cells: dict[int, str] = {}
                for i, c in enumerate(row):
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                    cells[_column(c.get("r", "")) if c.get("r") else i] = shared[int(value)] if c.get("t") == "s" and value else value
                if line := sheet_line([cells.get(i) for i in range(max(cells, default=-1) + 1)]):
                    held.append(line)
                if sum(map(len, held)) >= SHEET_UNIT:
                    out.append((f"лист {n}", "\n".join(held), True))
                    held = []
            if held:
                out.append((f"лист {n}", "\n".join(held), True))
    return out


EXTRACTORS: dict[str, Callable[[bytes], list[Unit]]] = {"txt": _text, "md": _text, "csv": _csv, "xml": _xml, "html": _html, "docx": _docx, "xlsx": _xlsx}


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, extension, bytes, modified, content of the supported files under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")
    return named.withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))).where(F.col("extension").isin(SUPPORTED))


def pages(found: DataFrame, extractors: dict[str, Callable[[bytes], list[Unit]]] | None = None) -> DataFrame:
    """file, page, loc, text, is_table, error of files (path, extension, content); a file that can't be read gives one row with its error."""
    using = EXTRACTORS | (extractors or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, extension, raw in zip(b.path, b.extension, b.content, strict=True):
                try:
                    units = using[extension](bytes(raw))
                    out += [(path, i, loc, text, table, None) for i, (loc, text, table) in enumerate(units)]
                except Exception as error:  # noqa: BLE001  a broken file is reported, not fatal
                    out.append((path, 0, None, None, False, f"{type(error).__name__}: {error}"[:300]))
            yield pd.DataFrame(out, columns=["file", "page", "loc", "text", "is_table", "error"])

    return found.select("path", "extension", "content").mapInPandas(run, "file string, page int, loc string, text string, is_table boolean, error string")


def member_name(name: str, utf8: bool) -> str:
    """A member's flat name: folders joined by two underscores, old Russian names decoded."""
    if not utf8:
        try:
            name = name.encode("cp437").decode("cp866")
        except UnicodeError:
            pass
    return name.replace("\\", "/").strip("/").replace("/", "__")


def unpacked(archives: DataFrame, largest: int = LARGEST_MEMBER) -> DataFrame:
    """archive, path (flat name), extension, content, error of the supported members of zip archives (path, content).

    A member of more than ``largest`` bytes when unpacked (a guard against bombs), one that can't be read, and an archive that is broken give a row with
    the error and no content.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = lambda *values: pd.DataFrame([values], columns=["archive", "path", "extension", "content", "error"])
        told = lambda error: f"{type(error).__name__}: {error}"[:300]
        for b in batches:
            for path, raw in zip(b.path, b.content, strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(raw or b""))) as z:
                        for m in z.infolist():
                            name = member_name(m.filename, bool(m.flag_bits & 0x800))
                            extension = name.rpartition(".")[2].lower()
                            if m.is_dir() or m.filename.startswith("__MACOSX") or extension not in SUPPORTED:
                                continue
                            if m.file_size > largest:
                                yield row(path, name, extension, None, f"{m.file_size} bytes, more than {largest}")
                                continue
                            try:
                                yield row(path, name, extension, z.read(m), None)
                            except Exception as error:  # noqa: BLE001  a broken member is reported, not fatal
                                yield row(path, name, extension, None, told(error))
                except Exception as error:  # noqa: BLE001  as is a broken archive
                    yield row(path, None, None, None, told(error))

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, extension string, content binary, error string")


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines store; lines that are broken are left out, and a store that isn't there is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def last_wins(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """One row for each key: the last in order, as an overlay's entries override the base's."""
    last = rows.groupBy(F.col(key).alias("key")).agg(F.max_by(F.struct("*"), order).alias("row"))
    return last.select("row.*")


def tail(lines: DataFrame, n: int, order: str = "offset") -> DataFrame:
    """The last ``n`` lines, in order."""
    return lines.orderBy(F.desc(order)).limit(n).orderBy(order)


def drive_link(url: str):
    """A shared drive link as its direct download address; other addresses as they are."""
    c = F.col(url)
    found = F.regexp_extract(c, r"drive\.google\.com/(?:file/d/|open\?id=|uc\?(?:export=download&)?id=)([\w-]+)", 1)
    return F.when(found != "", F.concat(F.lit("https://drive.google.com/uc?export=download&id="), found)).otherwise(c)


def write_register(df: DataFrame, path: str) -> None:
    """A register as semicolon-separated UTF-8 with a header."""
    df.write.mode("overwrite").option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, stamped with the time of export and appended."""
    df.withColumn("exported_at", F.current_timestamp()).write.mode("append").json(path)


def kept_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``; one that a swap left halfway is put in its place first: the new one if it was written whole, else the old one."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm(path)):
        for other, whole in ((f"{path}.next", f"{path}.next/_SUCCESS"), (f"{path}.old", f"{path}.old")):
            if fs.exists(jvm(whole)):
                fs.rename(jvm(other), jvm(path))
                break
    return spark.read.parquet(path)


def swap_table(df: DataFrame, path: str) -> None:
    """Replace the table at ``path`` by ``df``, which may be computed from it: it is written beside it, then renamed. :func:`kept_table` reads it, also after a crash between the two renames."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.next")
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jvm(path)):
        fs.delete(jvm(f"{path}.old"), True)
        fs.rename(jvm(path), jvm(f"{path}.old"))
    fs.rename(jvm(f"{path}.next"), jvm(path))
    fs.delete(jvm(f"{path}.old"), True)
