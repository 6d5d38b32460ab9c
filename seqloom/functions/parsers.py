"""Log grammars as column expressions.

A parser maps a column of raw lines to a struct (timestamp_unix_ms, entity_id, untemplated_message_text,
anomalous), null for a line of another form. Patterns are compiled with Unicode classes and \\n as the only
line end, so they take what Python's re takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = "(?U)(?d)"
#: The two grammars. BGL: [-] [number:prefix] [word] epoch date entity time entity text of three words or more.
HDFS = r"^\s*(\d{6})\s+(\d{6})\s+(\d+)\s+([A-Z]+)\s+(\S+):\s+(.*?)\s*$"
BLOCK = r"\bblk_-?\d+\b"
BGL = r"^\s*(-)?\s*(?:(?:\d+:\S+)\s+)?(?:\S+\s+)?(\d+)\s+(\d{4}\.\d{2}\.\d{2})\s+(\S+)\s+(\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}\.\d+)\s+(\S+)\s+(\S+\s+\S+\s+\S+.*)\s*$"
#: What Python's str.strip() takes off.
STRIP = r"(?U)^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds by way of a double of seconds, truncated: bit for bit what int(timestamp * 1000) gives."""
    return ((F.unix_micros(ts).cast("double") / 1e6) * 1000).cast("long")


def line_struct(matched: Column, ts: Column, entity: Column, text: Column, anomalous: Column) -> Column:
    fields = F.struct(ts.alias("timestamp_unix_ms"), entity.alias("entity_id"), text.alias("untemplated_message_text"), anomalous.cast("long").alias("anomalous"))
    return F.when(matched, fields)


def parse_hdfs(line: Column) -> Column:
    """yymmdd HHMMSS pid LEVEL component: content; the entity is the first block of the content or else the component."""
    pattern = FLAGS + HDFS
    part = lambda i: F.regexp_extract(line, pattern, i)
    century = F.when(F.substring(part(1), 1, 2) >= "69", "19").otherwise("20")
    ts = F.try_to_timestamp(F.concat(century, part(1), F.lit(" "), part(2)), F.lit("yyyyMMdd HHmmss"))
    content = stripped(part(6))
    entity = F.coalesce(F.nullif(F.regexp_extract(content, FLAGS + BLOCK, 0), F.lit("")), part(5))
    return line_struct(line.rlike(pattern), epoch_ms(ts), entity, stripped(F.concat(part(4), F.lit(" "), part(5), F.lit(": "), content)), F.lit(None))


def parse_bgl(line: Column) -> Column:
    """A leading dash is normal. The fine timestamp counts, or else the epoch seconds before it."""
    pattern = FLAGS + BGL
    part = lambda i: F.regexp_extract(line, pattern, i)
    fine = F.when(part(5).rlike(r"\.\d{1,6}$"), F.try_to_timestamp(part(5), F.lit("yyyy-MM-dd-HH.mm.ss.SSSSSS")))
    ts = F.coalesce(epoch_ms(fine), part(2).try_cast("long") * 1000)
    return line_struct(line.rlike(pattern), ts, part(4), stripped(part(7)), F.when(part(1) == "-", 0).otherwise(1))


@dataclass(frozen=True)
class Parser:
    """A named grammar."""

    name: str
    expression: Callable[[Column], Column]
    #: Tells parsers of one name apart: rows that another one has parsed aren't used again.
    code: str = ""

    def parse(self, lines: DataFrame) -> DataFrame:
        """Structured rows of lines (line_order, value); lines of another form are dropped."""
        return lines.select("line_order", self.expression(F.col("value")).alias("p")).where("p IS NOT NULL").select("p.*", "line_order")


PARSERS = {p.name: p for p in (Parser("hdfs_v1", parse_hdfs), Parser("bgl", parse_bgl))}


def parser(name: str) -> Parser:
    if name not in PARSERS:
        raise KeyError(f"unknown parser {name!r}; known: {', '.join(sorted(PARSERS))}")
    return PARSERS[name]


def python_parser(name: str, parse_line: Callable[[str], tuple | None]) -> Parser:
    """A parser made of a Python function from a line to (ms, entity, text, anomalous) or None, run on Arrow batches."""

    @F.pandas_udf("timestamp_unix_ms long, entity_id string, untemplated_message_text string, anomalous long, ok boolean")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = [(*found, True) if (found := parse_line(v)) is not None else (None, None, None, None, False) for v in values]
        out = pd.DataFrame(rows, columns=["timestamp_unix_ms", "entity_id", "untemplated_message_text", "anomalous", "ok"])
        return out.astype({"timestamp_unix_ms": "Int64", "anomalous": "Int64"})

    def expression(line: Column) -> Column:
        found = run(line)
        return F.when(found["ok"], F.struct(*(found[c].alias(c) for c in ("timestamp_unix_ms", "entity_id", "untemplated_message_text", "anomalous"))))

    return Parser(name, expression, code_of(parse_line))


def code_of(function: Callable) -> str:
    """A hash of what a function does: its instructions and constants, its defaults, and the values that it closes over, those of functions within it or among these values too."""

    def parts(code):
        yield code.co_code + repr((code.co_names, code.co_varnames)).encode()
        for constant in code.co_consts:
            if hasattr(constant, "co_code"):
                yield from parts(constant)
            else:
                yield repr(constant).encode()

    def bound(f: Callable, seen: tuple = ()):
        if f in seen:  # a function that refers to itself
            return
        yield from parts(f.__code__)
        for cell in f.__closure__ or ():
            try:
                yield from value(cell.cell_contents, (*seen, f))
            except ValueError:  # not set yet
                yield b"empty"
        for default in (*(f.__defaults__ or ()), *sorted((f.__kwdefaults__ or {}).items())):
            yield from value(default, (*seen, f))

    def value(x, seen: tuple):
        if hasattr(x, "__code__"):
            yield from bound(x, seen)
        else:
            yield repr(sorted(x, key=repr) if isinstance(x, (set, frozenset)) else x).encode()

    own = list(bound(function)) if hasattr(function, "__code__") else [repr(function).encode()]
    return hashlib.sha256(b"\0".join(own)).hexdigest()
