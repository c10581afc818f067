"""PDF payloads to pages of blocks, with whatever extractors are installed, else as text.

Extractors run in order of confidence; the first that does not fail wins, whatever it finds, and reading
the payload as text is the last resort.  None of the PDF libraries is required.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

BLOCK = "page_number int, block_no int, text string, x0 double, y0 double, x1 double, y1 double, family string, size double, weight string, style string, confidence double"
SCHEMA = f"doc_id string, extractor string, n_pages int, coverage double, {BLOCK}"


def _weight(name: str) -> tuple[str, str]:
    low = name.lower()
    return ("bold" if "bold" in low else "normal"), ("italic" if "italic" in low or "oblique" in low else "normal")


def _fitz(data: bytes) -> Iterator[tuple]:
    lib = importlib.import_module("fitz")
    with lib.open(stream=data, filetype="pdf") as doc:
        for number, page in enumerate(doc, 1):
            area = abs(page.rect.width * page.rect.height) or 1.0
            found = [b for b in page.get_text("dict")["blocks"] if b.get("lines")]
            cover = min(1.0, sum((b["bbox"][2] - b["bbox"][0]) * (b["bbox"][3] - b["bbox"][1]) for b in found) / area)
            for b in found:
                spans = [s for line in b["lines"] for s in line["spans"] if s["text"].strip()]
                if spans:
                    families = [s["font"] for s in spans]
                    modal = max(dict.fromkeys(families), key=families.count)
                    weight, style = _weight(" ".join(families))
                    yield number, cover, " ".join(s["text"].strip() for s in spans), b["bbox"], modal, round(sum(s["size"] for s in spans) / len(spans), 2), weight, style, 1.0


def _pdfplumber(data: bytes) -> Iterator[tuple]:
    import io

    lib = importlib.import_module("pdfplumber")
    with lib.open(io.BytesIO(data)) as doc:
        for number, page in enumerate(doc.pages, 1):
            rows: dict[int, list[dict]] = {}
            for word in page.extract_words():
                rows.setdefault(int(word["top"]), []).append(word)
            for top in sorted(rows):
                line = sorted(rows[top], key=lambda w: w["x0"])
                box = (min(w["x0"] for w in line), min(w["top"] for w in line), max(w["x1"] for w in line), max(w["bottom"] for w in line))
                yield number, 1.0, " ".join(w["text"] for w in line), box, "unknown", 0.0, "normal", "normal", 0.9


def _pdfminer(data: bytes) -> Iterator[tuple]:
    import io

    high, layout = importlib.import_module("pdfminer.high_level"), importlib.import_module("pdfminer.layout")
    for number, page in enumerate(high.extract_pages(io.BytesIO(data)), 1):
        for box in page:
            if isinstance(box, (layout.LTTextBoxHorizontal, layout.LTTextLineHorizontal)) and box.get_text().strip():
                yield number, 1.0, box.get_text().strip(), box.bbox, "unknown", 0.0, "normal", "normal", 0.6


def _text(data: bytes) -> Iterator[tuple]:
    """Pages at form feeds or three line feeds, blocks at two; image markers are no text."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    for number, page in enumerate(re.split(r"\f|\n{3,}", text), 1):
        for block in re.split(r"\n{2,}", re.sub(r"(?i)\[image:[^\]]+\]", "", page).strip()):
            if block := block.strip():
                # fixed values: the type of plain text and its confidence
                yield number, 1.0, block, (0.0, 0.0, 1.0, 1.0), "SourceSans", 12.0, "normal", "normal", 0.8


EXTRACTORS: list[tuple[str, Callable[[bytes], Iterator[tuple]]]] = [("fitz", _fitz), ("pdfplumber", _pdfplumber), ("pdfminer", _pdfminer)]


def cascade(data: bytes, extractors=None) -> tuple[str, list[tuple]]:
    """(name, blocks) of the first extractor that does not fail, the payload as text being the last."""
    for name, run in extractors if extractors is not None else EXTRACTORS:
        try:
            return name, list(run(data))
        except Exception:  # a missing library or a damaged file: the next one tries
            continue
    return "text", list(_text(data))


def extract(files: DataFrame, extractors=None) -> DataFrame:
    """Blocks (SCHEMA) of ``files`` (sha256, content); files without text have one row with null block columns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            rows = []
            for doc_id, data in zip(frame.doc_id, frame.content):
                name, found = cascade(bytes(data), extractors)
                pages, seen = len({f[0] for f in found}), {}
                for page, cover, text, box, family, size, weight, style, confidence in found:
                    seen[page] = seen.get(page, 0) + 1
                    rows.append((doc_id, name, pages, cover, page, seen[page], text, *(round(float(v), 3) for v in box), family, size, weight, style, confidence))
                if not found:
                    rows.append((doc_id, name, 0, 0.0, *[None] * 12))
            yield pd.DataFrame(rows, columns=names)

    return files.select(F.substring("sha256", 1, 12).alias("doc_id"), "content").mapInPandas(run, SCHEMA)
