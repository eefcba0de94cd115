"""Decoding of bytes whose encoding is not declared, and delimited text."""

from __future__ import annotations

import csv
import io
from itertools import islice

DELIMITERS = ",;\t|"
SNIFFED_ROWS = 64


class ParseFailed(ValueError):
    """Bytes that are not what their name says."""


def _legacy(data: bytes) -> str:
    """GB18030 if the bytes are valid in it, else Windows-1252."""
    try:
        return data.decode("gb18030")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def decode_log(data: bytes) -> str:
    """UTF-8 unless it is broken or holds a replacement character, else a legacy encoding."""
    try:
        text = data.decode("utf-8")
        if "�" not in text:
            return text
    except UnicodeDecodeError:
        pass
    return _legacy(data)


def decode_csv(data: bytes) -> str:
    """By byte-order mark, else UTF-8, else a legacy encoding. A mark that lies is an error."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(encoding)
            except UnicodeDecodeError as error:
                raise ParseFailed(str(error)) from error
    return decode_resource(data)


def decode_resource(data: bytes) -> str:
    """UTF-8 without its mark, else a legacy encoding without errors."""
    try:
        return data.decode("utf-8").lstrip("﻿")
    except UnicodeDecodeError:
        text = _legacy(data)
        if "�" in text:
            raise ParseFailed("no known encoding") from None
        return text


def records(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of delimited text, quoted as RFC 4180 says; rows may differ in width and empty lines are no rows."""
    csv.field_size_limit(1 << 30)
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]


def quote_marks(text: str, delimiter: str) -> tuple[int, int, int]:
    """Misplaced quotes, delimiters outside quotes, and quoted fields of the first rows.

    A field is quoted if its first character is a quote; what follows its closing quote must
    be a delimiter or a line end, and an unquoted field may hold no quote.
    """
    errors = outside = quoted = rows = 0
    at, n = 0, len(text)
    fresh = True
    while at < n and rows < SNIFFED_ROWS:
        c = text[at]
        if fresh and c == '"':
            quoted += 1
            at += 1
            while True:
                stop = text.find('"', at)
                if stop < 0:
                    return errors + 1, outside, quoted
                at = stop + 1
                if text[at : at + 1] != '"':
                    break
                at += 1
            fresh = False
            if at < n and text[at] not in "\r\n" + delimiter:
                errors += 1
                at += 1
            continue
        if c == delimiter:
            outside += 1
        elif c == '"':
            errors += 1
        elif c == "\n":
            rows += 1
        fresh = c in "\r\n" or c == delimiter
        at += 1
    return errors, outside, quoted


def sniff_delimiter(text: str) -> str:
    """The delimiter under which the first rows look most like a table.

    Candidates are ranked by, in turn: having columns at all; the share of rows with columns;
    the share of rows of the commonest width; the mean squared distance from it (less is
    better); that width; misplaced quotes (fewer are better); delimiters outside quotes;
    quoted fields. Of equals the first in DELIMITERS wins.
    """
    from fractions import Fraction

    def rank(delimiter: str) -> tuple:
        csv.field_size_limit(1 << 30)
        rows = islice((r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r), SNIFFED_ROWS)
        widths = [len(r) for r in rows if len(r) > 1 or any(f.strip() for f in r)]
        errors, outside, quoted = quote_marks(text, delimiter)
        common = max(set(widths), key=lambda w: (widths.count(w), w), default=0)
        total = max(len(widths), 1)
        spread = Fraction(sum((w - common) ** 2 for w in widths), total)
        return (common > 1, Fraction(sum(w > 1 for w in widths), total), Fraction(widths.count(common), total), -spread, common, -errors, outside, quoted)

    return max(DELIMITERS, key=rank)


def normalised_lines(rows: list[list[str]]) -> list[str]:
    """Rows as tab-separated lines of trimmed cells, without empty cells or lines at the end."""
    lines = []
    for row in rows:
        cells = [c.translate({9: " ", 13: " ", 10: " "}).strip() for c in row]
        while cells and not cells[-1]:
            cells.pop()
        lines.append("\t".join(cells))
    while lines and not lines[-1]:
        lines.pop()
    return lines
