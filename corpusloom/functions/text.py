"""Text functions: folding, tokens, keys, numbers, titles, window chunks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.batches import pieces


def _fold_table() -> tuple[str, str]:
    """Letters whose canonical decomposition is one ASCII letter and marks, with that letter; and D with stroke."""
    pairs = [("đ", "d"), ("Đ", "D")]
    for code in range(0xC0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(c) for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_table()


def fold(col: Column) -> Column:
    """Letters without accents, for text in composed form (JVM-side)."""
    return F.translate(col, FOLD_FROM, FOLD_TO)


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed form; needed once at index time for text that may be decomposed."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def casefold(texts: pd.Series) -> pd.Series:
    """Full case folding (differs from lower-casing for the sharp s)."""
    return texts.map(lambda t: None if t is None else t.casefold())


def tokens(col: Column) -> Column:
    """Index terms: folded, lower-cased runs of letters and digits (text in plain ASCII needs no folding)."""
    folded = F.when(F.octet_length(col) == F.length(col), col).otherwise(fold(col))
    return F.filter(F.split(F.lower(folded), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(col: Column) -> Column:
    """Words of a query, as typed."""
    return F.regexp_extract_all(col, F.lit(r"(?U)\w+"), F.lit(0))


def make_key(col: Column) -> Column:
    """ASCII key of a title or number: folded, lower-cased, other characters to single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(fold(col)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


#: Fixed value: the shape of a document number (serial, optional year, upper-case group code).
NUMBER = r"(?U)(?<![\w/])(\d{1,3}(?:\.\d{1,3})*)(?:/(\d{4}))?/([A-ZĐ][A-ZĐ0-9]*(?:-[A-ZĐ0-9]+)*)(?![\w/])"


def find_numbers(col: Column) -> Column:
    """Document numbers of a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(NUMBER), F.lit(0)))


def is_number(col: Column) -> Column:
    """Whether a query is nothing but a document number."""
    return F.regexp_extract(F.trim(col), "^(?:" + NUMBER + ")$", 0) != ""


#: An embedded image's definition, its use in place, and a use by reference.
DATA_IMAGES = (
    r"(?m)^\[[^\]]+\]:\s*<data:[^>]+>[ \t]*\r?$\n?",
    r"!\[[^\]]*\]\(\s*<?data:[^)]*\)",
    r"!\[[^\]]*\]\[[^\]]*\]",
)


def strip_data_images(col: Column) -> Column:
    """Markdown without embedded images; text that holds no ``data:`` stays as it is."""
    out = col
    for pattern in DATA_IMAGES:
        out = F.regexp_replace(out, pattern, "")
    return F.when(F.contains(col, F.lit("data:")), out).otherwise(col)


#: What Python's str.strip() removes.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"^{BLANK}+|{BLANK}+$", "")


def words(col: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(col, rf"{BLANK}+"), lambda x: x != "")).cast("long")


def first_line(col: Column) -> Column:
    """First line that is not blank, stripped of white space; empty if there is none."""
    return strip(F.regexp_extract(col, rf"([^\n]*[^\s\x1c-\x1f\x85\p{{Z}}][^\n]*)", 1))


def text_lines(col: Column) -> Column:
    """Lines that are not blank, stripped, as structs (line, text); lines count from 1."""
    lines = F.transform(F.split(col, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"), lambda x, i: F.struct((i + 1).alias("line"), strip(x).alias("text")))
    return F.filter(lines, lambda x: x["text"] != "")


def _stop(text: str, start: int, size: int) -> int:
    """Where the window that starts here ends: behind the last space or line break of its second half, if any."""
    if start + size >= len(text):
        return len(text)
    half = text[start + size // 2 : start + size]
    return start + size - next((i for i, c in enumerate(reversed(half)) if c in " \n"), 0)


def _windows(text: str, size: int, overlap: int) -> list[dict[str, int]]:
    """Chunk windows of one text: (ordinal, start, stop) with white space trimmed from both ends."""
    edges = [(0, _stop(text, 0, size))]
    while edges[-1][1] < len(text):
        begin = max(edges[-1][0] + 1, edges[-1][1] - overlap)
        edges.append((begin, _stop(text, begin, size)))
    bodies = ((a + len(p) - len(p.lstrip()), p.strip()) for a, b in edges for p in [text[a:b]])
    return [{"ordinal": n, "start": at, "stop": at + len(body)} for n, (at, body) in enumerate(x for x in bodies if x[1])]


WINDOW = "array<struct<ordinal:int,start:int,stop:int>>"


def windows(col: Column, size: int = 1200, overlap: int = 150) -> Column:
    """Array of chunk windows; offsets count code points from 0."""
    if size < 100 or not 0 <= overlap < size:
        raise ValueError("size must be 100 at least and overlap below it")

    kind = pa.list_(pa.struct({"ordinal": pa.int32(), "start": pa.int32(), "stop": pa.int32()}))

    @F.arrow_udf(WINDOW)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in pieces(batches):
            yield pa.array([_windows(t or "", size, overlap) for t in texts.to_pylist()], kind)

    return cut(col)


def context_line(*cols: Column) -> Column:
    """``title | path`` of the parts that are there."""
    return F.concat_ws(" | ", *[F.when(c != "", c) for c in cols])


def stored_text(context: Column, body: Column) -> Column:
    """Body under its context line, if there is one."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat_ws("\n", context, body)).otherwise(body)


def snippet(col: Column, size: int = 1200) -> Column:
    return F.substring(col, 1, size)


