"""Column expressions over register tables: addresses, circuit names, types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions.logs import trimmed, unsigned

#: The twelve columns, and the headings of the old comment row.
COLUMNS = ("id", "group", "data_name", "unit", "reg_add", "reg_type", "endian", "dcm", "k", "fun_num", "calc", "style")
COMMENT_ROW = ("流水号", "组号", "参数名")

U32, U64 = 2**32 - 1, 2**64 - 1

#: How circuits are written. Names may be numbered with digits or Chinese numerals.
DIGITS = "0-9一二三四五六七八九十"
DIGITS_AND_HUNDRED = DIGITS + "百"
CIRCUITS = (
    rf"(?idU)^CH\s*([{DIGITS}]+)(.*)\z",
    rf"(?idU)^Channel\s*([{DIGITS}]+)(.*)\z",
    rf"(?dU)^第\s*([{DIGITS}]+)\s*(?:路|回路)(.*)\z",
    rf"(?dU)^([{DIGITS}]+)\s*号回路(.*)\z",
    rf"(?dU)^回路\s*([{DIGITS}]+)(.*)\z",
)
_DASH, _N = "(?:-|~|～|—|–|至|到)", rf"[{DIGITS_AND_HUNDRED}]+"
_CHANNEL_DASH = "(?:-|~|～|—|–|to)"
_DATA = r"(?:\s+(?:Registers?|Data|Parameters?))?"
RANGE_HEADINGS = (
    rf"(?iU)^(?:回路\s*)?(?:第\s*)?{_N}\s*(?:路|回路)?\s*{_DASH}\s*(?:第\s*)?{_N}\s*(?:路|回路)?(?:\s*(?:遥测)?(?:数据|寄存器|参数))?\z",
    rf"(?iU)^CH\s*{_N}\s*{_DASH}\s*(?:CH\s*)?{_N}{_DATA}\z",
    rf"(?iU)^Channel\s*{_N}\s*{_CHANNEL_DASH}\s*(?:Channel\s*)?{_N}{_DATA}\z",
)
RANGE_PREFIX = rf"(?iU)^(?:(?:CH|Channel)\s*{_N}\s*(?:-|~|～|—|–|至|到|to)|(?:回路\s*)?(?:第\s*)?{_N}\s*(?:路|回路)?\s*{_DASH})"
RANGE_REST = r"^(?U:\s*)(?:[-~～—–至到]|[tT][oO])"

FENCE = r"\A(?U:\s*)```[^\n]*\n((?s).*?)(?:\r\n|\n|\r)```(?U:\s*)\z"


def numerals() -> dict[str, int]:
    """Chinese numerals from 1 to 99, a tens digit of one included or not."""
    units = dict(zip("一二三四五六七八九", range(1, 10), strict=True))
    tens = {f"{t}十{u}": (units.get(t, 1)) * 10 + units.get(u, 0) for t in ["", *units] for u in ["", *units]}
    return units | tens


def number(text: Column, most: int = U32) -> Column:
    """An unsigned number as the column holds it, null for anything else."""
    return unsigned(text, most)


def address(text: Column) -> Column:
    """0x1F, 1FH or decimal as DECIMAL(20,0); a number that ends in H is hexadecimal."""
    value = trimmed(text)
    digits = F.when(value.rlike("^0[xX]"), F.substring(value, 3, 1 << 20)).when(value.rlike("[hH]$"), F.regexp_replace(value, "[hH]$", ""))
    bare = F.regexp_replace(digits, r"^\+?0*(?=[0-9a-fA-F])", "")
    as_hex = F.when(digits.rlike(r"^\+?[0-9a-fA-F]+$") & (F.length(bare) <= 16), F.conv(bare, 16, 10).try_cast("decimal(20,0)"))
    return F.when(digits.isNotNull(), as_hex).otherwise(unsigned(value, U64).cast("decimal(20,0)"))


def without_doc(name: Column) -> Column:
    """Without DOC_ prefixes, however often they repeat."""
    return F.regexp_replace(trimmed(name), r"(?U)^(?:DOC_\s*)+", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, their columns worked out here: the optimizer copies none of their expressions into what follows."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def held(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The rows with columns that are worked out here, once; those they came with can still be left out or filtered before."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def circuit_number(text: Column) -> Column:
    """A number of at least 1 in digits, or a Chinese numeral up to 99."""
    known = numerals()
    place = F.array_position(F.array(*map(F.lit, known)), text).cast("int")
    named = F.try_element_at(F.array(*map(F.lit, known.values())), F.when(place > 0, place))
    return F.when(text.rlike("^[0-9]+$"), let(number(text), lambda n: F.when(n >= 1, n.cast("bigint")))).otherwise(named.cast("bigint"))


def circuit(name: Column) -> Column:
    """struct(number, attribute) of a name such as CH2_Ua, null if it is no single circuit's.

    The patterns are tried in order. One that matches ends the search if its rest begins a
    range or its number is malformed; if its attribute is empty the next one is tried.
    """

    def tried(text: Column, pattern: str) -> Column:
        parts = F.struct(F.regexp_extract(text, pattern, 1).alias("digits"), F.regexp_extract(text, pattern, 2).alias("rest"))
        attribute = lambda p: F.regexp_replace(p["rest"], r"(?U)^[\s_:：-]+|[\s_:：-]+\z", "")
        return F.when(text.rlike(pattern), let(parts, lambda p: F.struct(p["rest"].rlike(RANGE_REST).alias("range"), p["digits"].alias("digits"), attribute(p).alias("attribute"))))

    def verdict(hit: Column) -> Column:
        """Empty to go on, else an array of the circuit, or of null to stop."""
        found = F.struct(circuit_number(hit["digits"]).alias("number"), hit["attribute"].alias("attribute"))
        return F.when(hit.isNull(), F.lit(None)).when(hit["range"], F.array(F.lit(None).cast("struct<number:bigint,attribute:string>"))).otherwise(
            let(found, lambda f: F.when(f["number"].isNull(), F.array(F.lit(None).cast("struct<number:bigint,attribute:string>"))).when(f["attribute"] != "", F.array(f)))
        )

    tries = let(without_doc(name), lambda text: F.array(*(tried(text, p) for p in CIRCUITS)))
    ends = F.filter(F.transform(tries, verdict), lambda v: v.isNotNull())
    return F.get(F.flatten(F.slice(ends, 1, 1)), F.lit(0))


def is_range_heading(line: Column) -> Column:
    """Whether a line names a range of circuits."""
    text = trimmed(line)
    return text.rlike(RANGE_HEADINGS[0]) | text.rlike(RANGE_HEADINGS[1]) | text.rlike(RANGE_HEADINGS[2])


def is_ambiguous(name: Column) -> Column:
    """Whether a name looks like a circuit's or a range's but is neither complete."""
    text = without_doc(name)
    out = text.rlike(RANGE_PREFIX)
    for pattern in CIRCUITS:
        out = out | text.rlike(pattern)
    return out


def width(register_type: Column) -> Column:
    """Registers that a value of a type takes."""
    return F.when(register_type.isin(8, 9, 12), 2).when(register_type.isin(10, 11), 4).otherwise(1)


def is_bit(register_type: Column) -> Column:
    return register_type.isin(1, 2, 3)


def valid_endian(register_type: Column, endian: Column) -> Column:
    """Whether an endian code is legal for a type."""
    most = F.when(register_type == 1, 15).when(register_type == 2, 7).when(register_type == 3, 3).when(register_type.isin(4, 5, 6, 7, 10, 11), 1).when(register_type.isin(8, 9, 12), 3)
    return F.coalesce((endian >= 0) & (endian <= most), F.lit(False))


def without_fence(text: Column) -> Column:
    """What an outer Markdown fence encloses, or the text as it is."""
    return F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_tags(html: Column) -> Column:
    """Text of simple markup: <br> is a space, other tags and stray > go, an unclosed < swallows the rest."""
    spaced = F.regexp_replace(html, "<br/?>", " ")
    return trimmed(F.replace(F.regexp_replace(spaced, r"<[^>]*(?:>|\z)", ""), F.lit(">"), F.lit("")))


def redacted(text: Column, *secrets: str) -> Column:
    """With every non-empty secret replaced."""
    for s in secrets:
        if s:
            text = F.replace(text, F.lit(s), F.lit("[REDACTED]"))
    return text


def safe_stem(stem: Column) -> Column:
    """A file stem without control characters and signs that file systems reserve."""
    bare = F.regexp_replace(stem, r'[\x00-\x1f\x7f-\x9f<>:"/\\|?*]', "")
    bare = F.regexp_replace(bare, r"(?U)^[\s.]+|[\s.]+\z", "")
    reserved = F.upper(bare).rlike(r"^(?:CON|PRN|AUX|NUL|(?:COM|LPT)[1-9])\z")
    return F.when((bare == "") | (bare == "_"), "output").when(reserved, F.concat(F.lit("_"), bare)).otherwise(bare)
