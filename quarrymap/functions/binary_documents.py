"""Headings and previews of PDF and DOCX bytes, where the optional readers are installed."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# The notices that stand for a preview.
NO_PDF = "[PDF parsing requires PyMuPDF: pip install PyMuPDF]"
BAD_PDF = "[Error reading PDF]"
NO_DOCX = "[DOCX parsing requires python-docx: pip install python-docx]"
BAD_DOCX = "[Error reading DOCX]"


def _looks_like_title(line: str) -> bool:
    return bool(line) and len(line) < 100 and line[0].isupper() and (line.isupper() or len(line.split()) <= 8)


def pdf(data: bytes) -> tuple[list[str], str]:
    try:
        import fitz
    except ImportError:
        return [], NO_PDF
    try:
        with fitz.open(stream=data, filetype="pdf") as doc:
            text = "\n".join(doc[i].get_text() for i in range(min(len(doc), 10)))
    except Exception:
        return [], BAD_PDF
    return [x for x in map(str.strip, text.split("\n")) if _looks_like_title(x)], text[:500]


def docx(data: bytes) -> tuple[list[str], str]:
    try:
        import docx as reader
    except ImportError:
        return [], NO_DOCX
    try:
        paragraphs = reader.Document(io.BytesIO(data)).paragraphs
        return [p.text for p in paragraphs if p.style.name.startswith("Heading")], "\n".join(p.text for p in paragraphs)[:500]
    except Exception:
        return [], BAD_DOCX


@F.pandas_udf(StructType([StructField("headings", ArrayType(StringType())), StructField("content_preview", StringType())]))
def binary_structure(kinds: pd.Series, data: pd.Series) -> pd.DataFrame:
    """For each (type, bytes); other types give nothing."""
    readers = {"pdf": pdf, "docx": docx}
    return pd.DataFrame([readers[k](d or b"") if k in readers else ([], "") for k, d in zip(kinds, data)], columns=["headings", "content_preview"])
