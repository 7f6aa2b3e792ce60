"""Binary documents to text rows: PDF, Excel, Word, XSD.

Spark reads and distributes the files; a small per-file helper opens each one through an
optional library.  A file that cannot be read gives a row with an error, never a failed job.
"""

import io
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import markup, paths, text

SCHEMA = "text string, pages int, sheets int, error string"
FORMATS = {"pdf": "PDF", "xlsx": "Excel", "xls": "Excel", "docx": "Word"}


def _pdf(raw):
    from pypdf import PdfReader
    reader = PdfReader(io.BytesIO(raw))
    return "\n".join(p.extract_text() or "" for p in reader.pages), len(reader.pages), None


def _excel(raw):
    from openpyxl import load_workbook
    book = load_workbook(io.BytesIO(raw), read_only=True, data_only=True)
    out = []
    for sheet in book.sheetnames:
        out.append(f"\n=== {sheet} ===")
        for row in book[sheet].iter_rows(values_only=True):
            line = "\t".join("" if c is None else str(c) for c in row)
            if line.strip():
                out.append(line)
    return "\n".join(out), None, len(book.sheetnames)


def _word(raw):
    from docx import Document
    return "\n".join(p.text for p in Document(io.BytesIO(raw)).paragraphs if p.text.strip()), None, None


PARSERS = {"pdf": _pdf, "xlsx": _excel, "xls": _excel, "docx": _word}


def parse_documents(files: DataFrame, parsers=None) -> DataFrame:
    """(path, raw) to (path, text, pages, sheets, error), by extension."""
    table = dict(PARSERS if parsers is None else parsers)

    def run(batches):
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["raw"]):
                try:
                    rows.append((path, *table[path.rsplit(".", 1)[-1].lower()](raw), None))
                except Exception as e:  # one bad file is a row, not a failure
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "pages", "sheets", "error"])

    ext = paths.bare_extension(F.col("path"))
    return files.filter(ext.isin(*table)).select("path", "raw").mapInPandas(run, f"path string, {SCHEMA}")


def for_index(parsed: DataFrame) -> DataFrame:
    """Parsed documents as corpus rows, header block first."""
    fmt = paths.lit_map(FORMATS)
    name = paths.file_name(F.col("path"))
    return parsed.filter("text is not null").select("path", F.concat(markup.document_header(
        name, F.coalesce(F.try_element_at(fmt, paths.bare_extension(F.col("path"))), F.lit("Text")),
        F.coalesce("pages", F.lit(0)), F.coalesce("sheets", F.lit(0))), "text").alias("content"))


def naive_pdf_text(raw: Column) -> Column:
    """Printable parenthesised runs of an uncompressed PDF, then those of its text arrays."""
    body = F.decode(raw, "ISO-8859-1")
    printable = r"^[\x20-\x7E\s]+$"
    runs = F.filter(F.regexp_extract_all(body, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda s: (F.length(s) > 2) & s.rlike(printable))
    blocks = F.regexp_extract_all(body, F.lit(r"(BT[\s\S]*?ET)"), F.lit(1))
    arrays = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(\[[^\]]+\]\s*TJ)"), F.lit(1))))
    shown = F.filter(F.flatten(F.transform(arrays, lambda a: F.regexp_extract_all(a, F.lit(r"\(([^)]+)\)"), F.lit(1)))),
                     lambda s: s.rlike(printable))
    joined = text.trim(F.regexp_replace(F.array_join(F.concat(runs, shown), " "), r"\s+", " "))
    return F.when(F.length(joined) < 100, F.concat(
        F.lit("[PDF file - limited text extracted]\n\nExtracted content:\n"), joined,
        F.lit("\n\n[Note: This PDF may contain images or complex formatting.]"))).otherwise(
            F.concat(F.lit("[Extracted from PDF]\n\n"), joined))


def detect_headings(pages: DataFrame, key="path", content="text") -> DataFrame:
    """Mark short stand-alone lines as headings, by their neighbours; per text, in the JVM."""
    lines = F.split(content, "\n", -1)

    def mark(line, i):
        s = text.trim(line)
        gone = lambda at: text.trim(F.coalesce(F.get(lines, at), F.lit(""))) == ""
        stand = (F.length(s) > 0) & (F.length(s) < 80) & ~s.rlike("[.,;:]$") & ((i == 0) | gone(i - 1))
        upper = (F.length(s) > 3) & (F.upper(s) == s) & (F.lower(s) != s)
        first = F.substr(s, F.lit(1), F.lit(1))
        minor = (F.upper(first) == first) & (F.lower(first) != first) & (F.length(s) < 50) & (i + 1 < F.size(lines)) & gone(i + 1)
        return (F.when(stand & upper, F.concat(F.lit("\n## "), F.initcap(s), F.lit("\n")))
                .when(stand & minor, F.concat(F.lit("\n### "), s, F.lit("\n"))).otherwise(line))

    return pages.select(key, F.array_join(F.transform(lines, mark), "\n").alias("markdown"))


def pages_to_markdown(pages: DataFrame, key="path", page="page", content="text", marker_over=5) -> DataFrame:
    """Cleaned pages joined per document in page order, page markers for long documents."""
    cleaned = pages.select(key, page, text.clean_text(F.col(content)).alias("text"))
    headed = detect_headings(cleaned.withColumn("__k", F.struct(key, page)), "__k").select(
        F.col(f"__k.{key}").alias(key), F.col(f"__k.{page}").alias(page), "markdown")
    n = headed.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(page, "markdown"))).alias("p"))
    return n.select(key, F.array_join(F.transform("p", lambda x: F.when(
        F.col("n") > marker_over, F.concat(F.lit("\n---\n*Page "), x[page].cast("string"), F.lit("*\n\n"), x["markdown"]))
        .otherwise(x["markdown"])), "\n\n").alias("markdown"), F.col("n").alias("pages"))


XS = "{http://www.w3.org/2001/XMLSchema}"


def xsd_components(files: DataFrame) -> DataFrame:
    """Elements, types and enumeration values declared in XSD files, one row each."""
    def rows_of(content):
        root = ElementTree.fromstring(content)
        for node in root.iter():
            kind = node.tag.replace(XS, "")
            if kind in ("element", "complexType", "simpleType") and node.get("name"):
                base = node.find(f".//{XS}restriction")
                values = [e.get("value") for e in node.findall(f".//{XS}enumeration")] if kind == "simpleType" else []
                yield (kind, node.get("name"), node.get("type") or (base.get("base") if base is not None else None),
                       node.get("minOccurs"), node.get("maxOccurs"), values, None)

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out += [(path, *r) for r in rows_of(content)]
                except ElementTree.ParseError as e:
                    out.append((path, None, None, None, None, None, [], str(e)))
            yield pd.DataFrame(out, columns=["path", "kind", "name", "base", "min_occurs", "max_occurs", "enum_values", "error"])

    return files.select("path", "content").mapInPandas(
        run, "path string, kind string, name string, base string, min_occurs string, max_occurs string, enum_values array<string>, error string")


def xsd_markdown(components: DataFrame) -> DataFrame:
    """One Markdown table per file and kind."""
    row = F.concat(F.lit("| "), F.col("name"), F.lit(" | "), F.coalesce("base", F.lit("-")), F.lit(" | "),
                   F.coalesce("min_occurs", F.lit("1")), F.lit(" | "), F.coalesce("max_occurs", F.lit("1")), F.lit(" | "),
                   F.array_join("enum_values", ", "), F.lit(" |"))
    return components.filter("error is null").groupBy("path", "kind").agg(
        F.concat(F.lit("## "), F.first("kind"), F.lit("\n\n| Name | Type | Min | Max | Values |\n|---|---|---|---|---|\n"),
                 F.array_join(F.array_sort(F.collect_list(row)), "\n")).alias("markdown"))


def table_markdown(cells: DataFrame, keys=("path", "sheet"), order="row_no", values="cells") -> DataFrame:
    """Sheet rows to Markdown tables: the first non-empty row is the header, pipes are escaped."""
    full = cells.filter(F.exists(values, lambda c: c.isNotNull()))
    rows = full.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, values))).alias("r"))
    head = F.get("r", F.lit(0))[values]
    filled = F.size(F.filter(head, lambda c: c.isNotNull()))
    width = F.when(filled > 0, filled).otherwise(F.size(head))
    show = lambda row, esc: F.concat(F.lit("| "), F.array_join(F.transform(F.slice(row, F.lit(1), width), lambda c: (
        F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")) if esc else F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))
    body = F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x: show(x[values], True))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    return rows.select(*keys, F.array_join(F.concat(F.array(show(head, False), rule), body), "\n").alias("markdown"),
                       (F.size("r") - 1).alias("data_rows"))
