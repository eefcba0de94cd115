"""Register tables: sanitising, merging with interval conflicts, and name catalogues.

Rows are (doc_id, batch_ord, row_ord, fields): the fields of one CSV record, in the order
batch_ord, row_ord within a document. Every step is a transform of all documents at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions import registers as fn
from veldspar.functions.logs import trimmed
from veldspar.operators import order
from veldspar.scratch import Scratch

ORDER = ("batch_ord", "row_ord")
#: Most registers of a value, and addresses of a cell.
WIDEST, CELL = 4, 1024

#: Warnings of rows.
UNREADABLE = "忽略了无法解析的 CSV 记录。"
REPAIRED = "检测到缺少 unit 空列的 11 列记录，已安全修复。"
DAMAGED = "忽略了格式损坏的 CSV 记录。"
NAMELESS = "参数名为空，已保持原样。"


def _at(row: Column, k: int) -> Column:
    return F.get(row, F.lit(k))


def repairable(row: Column) -> Column:
    """Whether an 11-field record is a whole one whose unit is missing."""
    numbers = [5, 6, 7, 8, 10]
    out = (F.size(row) == 11) & fn.number(_at(row, 0), fn.U64).isNotNull() & (fn.number(_at(row, 1)) >= 1) & (_at(row, 2) != "")
    out = out & fn.number(_at(row, 4)).between(1, 12) & (_at(row, 8) == "3") & fn.address(_at(row, 3)).isNotNull()
    for k in numbers:
        out = out & fn.number(_at(row, k)).isNotNull()
    return F.coalesce(out, F.lit(False))


def repaired(row: Column) -> Column:
    """The record with an empty unit put in and its address in decimal."""
    return F.concat(F.slice(row, 1, 3), F.array(F.lit(""), fn.address(_at(row, 3)).cast("string")), F.slice(row, 5, 1 << 20))


def sanitize(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Records with status (valid or rejected), repaired, width, fields and warnings.

    Header and comment rows go. ``catalog`` has (code, meaning, ord); names match its codes
    without regard to ASCII case, the first of equal ones wins. A circuit's number becomes
    the group and its attribute the name; other names become catalogue codes, or keep their
    words under DOC_.
    """
    fields = F.transform("fields", trimmed)
    rows = rows.withColumn("fields", fields)
    head = F.slice("fields", 1, 3)
    header = F.col("fields") == F.array(*map(F.lit, fn.COLUMNS))
    comment = (F.size("fields") == 12) & (head == F.array(*map(F.lit, fn.COMMENT_ROW)))
    rows = rows.where((F.size("fields") > 0) & ~header & ~comment).withColumn("width", F.size("fields"))
    rows = rows.withColumn("repaired", repairable(F.col("fields")))
    rows = rows.withColumn("fields", F.when(F.col("repaired"), repaired(F.col("fields"))).otherwise(F.col("fields")))
    good = (F.size("fields") == 12) & fn.number(_at(F.col("fields"), 0), fn.U64).isNotNull()
    rows = fn.settled(rows.withColumn("valid", F.coalesce(good, F.lit(False))))

    name, found = F.col("name"), F.col("found")
    rows = rows.withColumn("name", F.when(F.col("valid"), _at(F.col("fields"), 2)))
    rows = fn.settled(rows.withColumns({"found": fn.circuit(name), "bare": fn.without_doc(name)}))
    kept = found.isNull() & ((F.col("bare") == "") | fn.is_ambiguous(name))
    rows = rows.withColumns({"circuit": found["number"], "wanted": F.coalesce(fn.without_doc(found["attribute"]), "bare"), "as_is": kept})
    rows = rows.withColumn("key", fn.ascii_lower(F.col("wanted")))
    codes = catalog.groupBy(fn.ascii_lower(F.col("code")).alias("key")).agg(F.min_by("code", "ord").alias("canonical"))
    rows = rows.join(codes, "key", "left")
    as_doc = F.concat(F.lit("DOC_"), trimmed(F.regexp_replace("wanted", "^(?:DOC_)+", "")))
    new_name = F.when(F.col("as_is"), name).otherwise(F.coalesce("canonical", as_doc))
    group = _at(F.col("fields"), 1)
    group = F.when(F.col("circuit").isNotNull(), F.col("circuit").cast("string")).when(F.coalesce(fn.number(group) >= 1, F.lit(False)), group).otherwise("1")
    clean = F.concat(F.slice("fields", 1, 1), F.array(group, new_name), F.slice("fields", 4, 1 << 20))
    ambiguous = F.concat(F.lit("无法从参数名“"), name, F.lit("”提取完整回路属性，已保持原样。"))
    notes = F.array(
        F.when(F.col("repaired"), REPAIRED),
        F.when(~F.col("valid"), DAMAGED),
        F.when(F.col("valid") & F.col("as_is"), F.when(F.col("bare") == "", NAMELESS).otherwise(ambiguous)),
    )
    return fn.settled(rows.select(
        "doc_id", *ORDER, "width", "repaired", F.when(F.col("valid"), "valid").otherwise("rejected").alias("status"),
        F.when(F.col("valid"), clean).otherwise(F.col("fields")).alias("fields"), F.filter(notes, lambda w: w.isNotNull()).alias("warnings"),
    ))


def diagnostics(sanitized: DataFrame) -> DataFrame:
    """Per document: valid, repaired and rejected records and how many had each width."""
    widths = sanitized.groupBy("doc_id", "width").agg(F.count(F.lit(1)).alias("n"))
    widths = widths.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("width", "n")))).alias("column_counts"))
    counts = sanitized.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "valid").alias("valid_records"),
        F.count_if("repaired").alias("repaired_missing_unit"),
        F.count_if(F.col("status") == "rejected").alias("rejected_records"),
    )
    return counts.join(widths, "doc_id")


def merge(sanitized: DataFrame) -> DataFrame:
    """Records of each document merged: doc_id, ord, status (kept or conflict), address, fields.

    Records equal but for their id count once, the first one. They are ordered by address
    (none last), width and arrival. A record is dropped if a kept one holds one of its
    registers, unless all those begin at its address and both are bit types; a dropped
    record holds nothing. Kept records are numbered anew.

    Only the first record at an address can take free registers, and what it takes decides
    which address is looked at next. So kept addresses are the orbit of one step, from an
    address to the first beyond the registers of its first record. It is cut into cells of
    CELL addresses: a cell is entered with fewer than WIDEST of its registers held, so it is a
    map of WIDEST ways in to as many out. Where all ways in lead to the same one out, the
    next cell's is known at once, which touching records nearly always bring about; between
    such places ways are followed from cell to cell by doubling. Then each cell, however
    long its island, is weighed alone.
    """
    scratch = Scratch(sanitized.sparkSession, "register-merge")
    rows = sanitized.where("status = 'valid'").select("doc_id", *ORDER, _at(F.col("fields"), 0).alias("id"), F.slice("fields", 2, 11).alias("rest"))
    rows = rows.groupBy("doc_id", "rest").agg(F.min(F.struct(*ORDER, "id")).alias("first"))  # equal records meet before they are shuffled
    kind = F.coalesce(fn.number(_at(F.col("rest"), 4)), F.lit(0)).cast("bigint")
    rows = rows.select("doc_id", "first.*", "rest", fn.number(_at(F.col("rest"), 3), fn.U64).cast("decimal(20,0)").alias("address"), kind.alias("kind"))
    rows = scratch.save(fn.settled(rows.withColumn("width", fn.width(F.col("kind")))), "rows")
    judged = _judged(rows.where("address is not null"), scratch)
    rows = rows.join(judged, ["doc_id", "address"], "left")
    is_head = (F.col("head.batch_ord") == F.col("batch_ord")) & (F.col("head.row_ord") == F.col("row_ord"))
    kept = F.col("address").isNull() | (F.col("taken") & (is_head | (fn.is_bit(F.col("head.kind")) & fn.is_bit(F.col("kind")))))
    rows = rows.select("doc_id", *ORDER, "id", "rest", "address", "width", kept.alias("kept"))
    both = order.numbered(rows, ["doc_id", "kept"], [F.col("address").isNull(), F.col("address"), F.col("width"), *map(F.col, ORDER)], scratch, "ord")
    first = F.when(F.col("kept"), F.col("ord").cast("string")).otherwise(F.col("id"))
    return both.select("doc_id", "ord", F.when(F.col("kept"), "kept").otherwise("conflict").alias("status"), "address", F.concat(F.array(first), F.col("rest")).alias("fields"))


def _judged(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """The first record (doc_id, address, head) of every address, and whether it is ``taken``."""
    heads = placed.groupBy("doc_id", "address").agg(F.min(F.struct("width", *ORDER, "kind")).alias("head"))
    cell = F.floor(F.col("address") / CELL).cast("decimal(20,0)")
    at = (F.col("address") - F.col("cell") * CELL).cast("int")
    heads = heads.withColumn("cell", cell).select("doc_id", "cell", F.struct(at.alias("at"), "address", "head").alias("item"))
    cells = heads.groupBy("doc_id", "cell").agg(F.array_sort(F.collect_list("item")).alias("items"))  # CELL items at most
    most = lambda x: x["at"] + x["head"]["width"] - 1
    out = lambda way: F.aggregate("items", way - 1, lambda m, x: F.when(x["at"] > m, most(x)).otherwise(m), lambda m: F.greatest(m - (CELL - 1), F.lit(0)))
    cells = scratch.save(cells.withColumn("out", F.transform(F.sequence(F.lit(0), F.lit(WIDEST - 1)), out)), "cells")

    # Ways into cells as nodes: cell * WIDEST + the registers held.
    sure = F.array_min("out") == F.array_max("out")
    before = cells.select("doc_id", (F.col("cell") + 1).cast("decimal(20,0)").alias("cell"), F.when(sure, F.get("out", F.lit(0))).alias("sure"), F.lit(True).alias("follows"))
    ways = cells.select("doc_id", "cell", "out", sure.alias("ends")).join(before, ["doc_id", "cell"], "left")
    entered = F.when(F.col("follows").isNull(), 0).otherwise(F.col("sure"))
    ways = ways.select("doc_id", "cell", "ends", entered.alias("entered"), F.posexplode("out").alias("way", "out"))
    node = lambda cell, way: (cell * WIDEST + way).cast("decimal(20,0)")
    nodes = ways.select("doc_id", node(F.col("cell"), F.col("way")).alias("at"), F.when(~F.col("ends"), node(F.col("cell") + 1, F.col("out"))).alias("to"), F.coalesce(F.col("entered") == F.col("way"), F.lit(False)).alias("start"))
    ways = order.orbit(scratch.save(nodes, "ways"), ["doc_id"], scratch)
    entries = ways.select("doc_id", F.floor(F.col("at") / WIDEST).cast("decimal(20,0)").alias("cell"), F.pmod("at", F.lit(WIDEST)).cast("int").alias("way"))

    start = lambda way: F.struct((way - 1).alias("most"), F.array().cast("array<boolean>").alias("taken"))
    step = lambda s, x: F.struct(F.when(x["at"] > s["most"], most(x)).otherwise(s["most"]).alias("most"), F.concat(s["taken"], F.array(x["at"] > s["most"])).alias("taken"))
    weighed = cells.join(entries, ["doc_id", "cell"]).select("doc_id", F.inline(F.arrays_zip("items", F.aggregate("items", start(F.col("way")), step, lambda s: s["taken"]).alias("taken"))))
    return weighed.select("doc_id", "items.address", "items.head", "taken")


def conflict_warning(address: Column) -> Column:
    return F.concat(F.lit("寄存器地址 "), address.cast("string"), F.lit(" 与已保留记录占用冲突，已保留先排序的记录。"))


def csv_line(fields: Column) -> Column:
    """One CSV line, quoted only where a field needs it."""
    quoted = lambda f: F.when(f.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f)
    return F.array_join(F.transform(fields, quoted), ",")


def documents(merged: DataFrame) -> DataFrame:
    """The merged table of each document as CSV text with its header. A document's records are its own group."""
    lines = merged.where("status = 'kept'").select("doc_id", "ord", csv_line(F.col("fields")).alias("line"))
    body = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.select("doc_id", F.concat(F.lit(",".join(fn.COLUMNS) + "\n"), F.col("body")).alias("csv"))


def catalog(entries: DataFrame) -> DataFrame:
    """Catalogue (code, meaning, ord) of entries (ord, code, meaning): distinct meanings of a code joined in order.

    Empty codes and meanings go. Meanings that already hold a separator count as their parts
    when others are compared with them.
    """
    known = entries.select("ord", trimmed(F.col("code")).alias("code"), trimmed(F.col("meaning")).alias("meaning")).where("code <> '' and meaning <> ''")
    once = known.groupBy("code", "meaning").agg(F.min("ord").alias("ord"))
    listed = once.groupBy("code").agg(F.min("ord").alias("ord"), F.sort_array(F.collect_list(F.struct("ord", "meaning"))).alias("meanings"))
    texts = F.transform("meanings", lambda m: m["meaning"])
    joined = F.aggregate(texts, F.lit(None).cast("string"), lambda done, m: F.when(done.isNull(), m).when(F.array_contains(F.split(done, " / "), m), done).otherwise(F.concat(done, F.lit(" / "), m)))
    return listed.select("code", joined.alias("meaning"), "ord")


def names(entries: DataFrame) -> DataFrame:
    """Distinct codes in lower case."""
    return catalog(entries).select(fn.ascii_lower(F.col("code")).alias("name")).distinct()


def markdown_entries(lines: DataFrame) -> DataFrame:
    """Entries (ord, code, meaning) of the table rows among lines (ord, line): empty cells dropped, the second and third taken."""
    rows = lines.select("ord", trimmed(F.col("line")).alias("line")).where(F.col("line").startswith("|") & ~F.col("line").contains("---"))
    cells = F.filter(F.transform(F.split("line", r"\|"), trimmed), lambda c: c != "")
    rows = rows.withColumn("cells", cells).where(F.size("cells") >= 3)
    rows = rows.select("ord", _at(F.col("cells"), 1).alias("code"), fn.without_tags(_at(F.col("cells"), 2)).alias("meaning"))
    return rows.where(~F.col("code").isin("名称", "method") & ~F.col("code").startswith("."))


def reference_lines(catalogued: DataFrame, most: int = 130) -> DataFrame:
    """The catalogue as text wrapped greedily at ``most`` characters: one row with ``reference``. A catalogue is a small dimension table."""
    item = F.concat("code", F.lit("="), F.replace("meaning", F.lit(","), F.lit("，")))
    listed = catalogued.agg(F.sort_array(F.collect_list(F.struct("ord", item.alias("item")))).alias("items"))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("now"))

    def step(state: Column, x: Column) -> Column:
        item, now = x["item"], state["now"]
        full = (now != "") & (F.length(now) + 2 + F.length(item) > most)
        return F.struct(
            F.when(full, F.concat(state["lines"], F.array(now))).otherwise(state["lines"]).alias("lines"),
            F.when(full | (now == ""), item).otherwise(F.concat(now, F.lit(", "), item)).alias("now"),
        )

    done = lambda s: F.array_join(F.when(s["now"] != "", F.concat(s["lines"], F.array(s["now"]))).otherwise(s["lines"]), "\n")
    return listed.select(F.aggregate("items", start, step, done).alias("reference"))
