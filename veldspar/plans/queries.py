"""Registered queries over the driver's tables, each applying operators to a whole derived input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import frames as hexes
from veldspar.functions import logs as log_fn
from veldspar.functions import registers as reg_fn
from veldspar.operators import chunks, delimited, explain, frames, logs, needles, order, registers
from veldspar.plans import derive
from veldspar.plans.oracles import ORACLE_SQL
from veldspar.scratch import Scratch
from veldspar.sources import encodings, files, sinks

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parsed(derive.log_lines(spark, sf_dir))


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.entries(derive.log_lines(spark, sf_dir))


def log_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.category_counts(_entries(spark, sf_dir))


def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.summary(logs.entries(derive.log_lines(spark, sf_dir)))


def log_serial_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.serial_errors(_entries(spark, sf_dir))


def log_unique_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.unique_serials(_entries(spark, sf_dir))


def log_serial_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.serial_totals(_entries(spark, sf_dir))


def log_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.projects(_entries(spark, sf_dir))


def log_disabled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.disabled_rules(_entries(spark, sf_dir))


def log_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.threads(_entries(spark, sf_dir))


def log_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.heatmap(_entries(spark, sf_dir), 10)


def log_stuck_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.stuck_threads(_entries(spark, sf_dir), 10_000)


def log_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.samples(_entries(spark, sf_dir), 5)


def log_dispatch_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = log_fn.dispatch_cost(F.col("message")).cast("bigint")
    return _entries(spark, sf_dir).select("file_ord", "line_no", cost.alias("cost_ms")).where("cost_ms is not null")


def log_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.overview(derive.log_lines(spark, sf_dir))


def log_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by a table of rules."""
    return logs.categorised_by_table(_entries(spark, sf_dir), logs.rules(spark)).groupBy("category").agg(F.count(F.lit(1)).alias("entries"))


def redacted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as secrets in the descriptions of parts; some are the beginning of others."""
    part = _table(spark, sf_dir, "part")
    secrets = part.groupBy(F.col("p_brand").alias("needle")).agg(F.min("p_partkey").alias("ord"))
    text = F.concat_ws(" ", F.concat("p_brand", "p_name"), "p_type", F.concat("p_brand", F.lit("7")), F.concat(F.lit("x"), "p_brand"))
    return needles.redacted(part.select("p_partkey", text.alias("text")), "text", secrets)


def log_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines written to text files in the shared folder and read back by byte ranges, numbered through all files."""
    from pyspark.sql import Window

    folder = f"{Scratch(spark, 'log-files').root}/lines"
    lines = derive.log_lines(spark, sf_dir).repartitionByRange("file_ord", "line_no").sortWithinPartitions("file_ord", "line_no")
    lines.select("line").write.text(folder)
    found = files.log_lines(spark, folder, 1 << 20, suffixes=(".txt",))
    sizes = found.groupBy("file_ord").agg((F.max("line_no") + 1).alias("n"))
    before = sizes.select("file_ord", (F.sum("n").over(Window.orderBy("file_ord")) - F.col("n")).alias("before"))  # a row a file
    return found.join(before, "file_ord").select((F.col("before") + F.col("line_no")).alias("nth"), "line")


def log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.latest(_entries(spark, sf_dir), "thread", 64).select("thread", "from_end", "file_ord", "line_no", "message")


def log_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of log files in two listings, each once, with their places in natural order and by falling name."""
    event = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user"))
    plain = event.select(F.concat(F.lit("app."), "user", F.lit(".log")).alias("name"))
    both = files.together(plain, event.select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("app."), "user", F.lit(".log"))).otherwise(F.concat(F.lit("App."), "id", F.lit(".log.gz"))).alias("name")))
    found = files.search_names(both, " .LOG ")
    scratch, name = Scratch(spark, "log-file-names"), F.col("name")
    found = order.numbered(scratch.save(found, "names"), [], files.natural_parts(name), scratch, "natural", "by-key", falling=(1,))
    found = order.numbered(found, [], [name], scratch, "falling", "by-name", falling=(0,))
    return found.select("name", F.col("natural").cast("int").alias("natural"), F.col("falling").cast("int").alias("falling"))


def log_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.report(derive.log_lines(spark, sf_dir))


def _catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "Ua", "A相电压"), (1, "Ia", "A相电流"), (2, "IA", "shadowed")], "ord int, code string, meaning string")


def _sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.sanitize(derive.register_rows(spark, sf_dir), _catalog(spark))


def register_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sanitized(spark, sf_dir)
    return rows.select(
        "doc_id", "batch_ord", "row_ord", "status", "repaired", F.col("width").cast("bigint").alias("width"),
        F.get("fields", F.lit(1)).alias("grp"), F.get("fields", F.lit(2)).alias("data_name"), F.size("warnings").cast("bigint").alias("n_warnings"),
    )


def register_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registers.diagnostics(_sanitized(spark, sf_dir))
    count = lambda w: F.coalesce(F.try_element_at("column_counts", F.lit(w)), F.lit(0)).alias(f"width_{w}")
    return found.select("doc_id", "valid_records", "repaired_missing_unit", "rejected_records", count(12), count(11), count(5))


def register_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = registers.merge(_sanitized(spark, sf_dir))
    pick = lambda k: F.get("fields", F.lit(k))
    return merged.select("doc_id", F.when(F.col("status") == "kept", F.col("ord").cast("bigint")).alias("ord"), "status", F.col("address").cast("bigint").alias("address"), pick(2).alias("data_name"), pick(4).alias("reg_add"), pick(5).alias("reg_type"), pick(1).alias("grp"))


def register_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged tables written as one CSV file a document in the shared folder, and read back."""
    folder = f"{Scratch(spark, 'register-files').root}/tables"
    merged = registers.merge(_sanitized(spark, sf_dir))
    stems = derive.register_rows(spark, sf_dir).select("doc_id", F.concat(F.lit("table: "), F.col("doc_id").cast("string")).alias("stem")).distinct()
    sinks.write_register_files(merged, stems, folder, "20260102_030405")
    rows = files.delimited(spark, folder, ",").where("row_ord > 0")
    doc = F.regexp_extract("path", r"table ([0-9]+)_20260102_030405_[0-9a-f]{6}\.csv$", 1).cast("bigint")
    pick = lambda k: F.get("fields", F.lit(k))
    return rows.select(doc.alias("doc_id"), pick(0).cast("bigint").alias("ord"), "row_ord", pick(2).alias("data_name"), pick(4).alias("reg_add"), pick(5).alias("reg_type"), pick(1).alias("grp"))


def register_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("p_partkey")
    text = F.when(number % 4 == 0, F.concat(F.lit("0x"), F.lower(F.hex(number)))).when(number % 4 == 1, F.concat(F.hex(number), F.lit("H"))).when(number % 4 == 2, F.concat(F.lit(" "), number.cast("string"), F.lit(" "))).otherwise(F.concat(number.cast("string"), F.lit("x")))
    return _table(spark, sf_dir, "part").select("p_partkey", reg_fn.address(text).cast("bigint").alias("address"))


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("code"), F.substring("p_type", 1, 6).alias("meaning"))


def register_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register tables as CSV texts of fifty records with headings and comments, every other one fenced, read back and sanitized."""
    lines = derive.register_rows(spark, sf_dir).select((F.col("row_ord") / 50).cast("bigint").alias("doc_id"), "row_ord", registers.csv_line(F.col("fields")).alias("line"))
    texts = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_ord", "line"))).alias("lines"))  # fifty at most
    head, comment = ",".join(reg_fn.COLUMNS), ",".join([*reg_fn.COMMENT_ROW, *[""] * 9])
    body = F.concat(F.lit(f"{head}\n{comment}\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\r\n"))
    texts = texts.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```csv\n"), body, F.lit("\n```\n"))).otherwise(body).alias("csv"))
    rows = files.record_rows(texts).withColumn("batch_ord", F.lit(0))
    rows = registers.sanitize(rows, _catalog(spark))
    return rows.select("doc_id", F.col("row_ord").cast("bigint").alias("row_ord"), "status", "repaired", F.get("fields", F.lit(1)).alias("grp"), F.get("fields", F.lit(2)).alias("data_name"))


def circuit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of circuits and ranges in all their forms, and whether endian codes are legal."""
    rows = derive.circuit_names(spark, sf_dir)
    found = reg_fn.settled(rows.withColumn("found", reg_fn.circuit(F.col("name"))))
    legal = reg_fn.valid_endian(F.col("kind"), F.col("endian"))
    return found.select("p_partkey", F.col("found.number").alias("number"), F.col("found.attribute").alias("attribute"), reg_fn.is_range_heading(F.col("name")).alias("heading"), reg_fn.is_ambiguous(F.col("name")).alias("ambiguous"), legal.alias("legal"))


def validated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed explanations of registers, with evidence that is allowed, unknown or missing."""
    line = _table(spark, sf_dir, "lineitem")
    cited = F.when(F.col("l_quantity") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("e"), (F.col("l_suppkey") % 12).cast("string")), F.lit("e1")))
    candidates = line.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").alias("l_quantity"))
    candidates = candidates.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.col("l_partkey").alias("register_address"), cited.alias("evidence_ids"))
    known = _table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("address"))
    evidence = _table(spark, sf_dir, "supplier").where("s_suppkey % 12 < 10").select(F.concat(F.lit("e"), (F.col("s_suppkey") % 12).cast("string")).alias("id"))
    found = explain.validate_candidates(candidates, known, evidence)
    return found.select("ord", "register_address", "status")


def register_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of messages that no definition has."""
    answers = _pairs(spark, sf_dir).where("role = 'response'").select("registers")
    found = explain.match_diagnostics(answers, _definitions(spark, sf_dir).where("address % 3 > 0"))
    return found.select(F.explode(F.col("unmatched_addresses").cast("array<bigint>")).alias("address"))


def naming_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.catalog(_brands(spark, sf_dir))


def naming_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.reference_lines(registers.catalog(_brands(spark, sf_dir)))


def detected_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in six encodings by id, their encoding found by a model of the other half of the documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    written = ("utf-8", "cp1252", "cp850", "mac_roman", "utf-16-le", "utf-16-be")
    half = F.floor(F.col("doc_id") / len(written)) % 2 == 0
    model = encodings.train(docs.where(half), encodings=written, group_col="lang")
    true = F.get(F.array(*map(F.lit, written)), F.pmod("doc_id", F.lit(len(written))).cast("int"))
    files = encodings.encoded(docs.withColumn("written", true), "written")
    found = encodings.detect(encodings.blocks_of(files, ["doc_id"]), ["doc_id"], model)
    read = encodings.decoded(files.drop("text").join(found, "doc_id"))
    again = encodings.decoded(read.withColumnRenamed("text", "read"), "data", "written")
    return again.select("doc_id", "written", (~half).alias("held_out"), (F.col("read") == F.col("text")).alias("right"))


def delimiter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.delimiter_stats(derive.delimited_texts(spark, sf_dir), ["conv_id", "turn"])


def delimiter_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.sniffed(derive.delimited_texts(spark, sf_dir), ["conv_id", "turn"])


def delimited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as delimited text, a text a source, in blocks that cut a record in two, and read back."""
    fields = ("doc_id", "lang", "source", "text")
    docs = _table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("file"), "doc_id", registers.csv_line(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields))).alias("line"))
    scratch = Scratch(spark, "delimited-query")
    rows = order.numbered(docs, ["file"], [F.col("doc_id"), F.col("line")], scratch)
    cut, line = F.pmod(F.col("doc_id") * 7919, F.length("line")).cast("int"), F.concat("line", F.lit("\n"))
    pieces = F.array(F.struct((F.col("nth") - 1).alias("block"), F.lit(1).alias("side"), line.substr(F.lit(1), cut).alias("part")), F.struct(F.col("nth").alias("block"), F.lit(0).alias("side"), line.substr(cut + 1, F.length(line)).alias("part")))
    halves = rows.select("file", F.inline(pieces)).groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("side", "part"))).alias("parts"))  # two a block
    blocks = halves.select("file", "block", F.array_join(F.transform("parts", lambda p: p["part"]), "").cast("binary").alias("data"))
    found = delimited.records(scratch.save(blocks, "blocks"), ["file"])
    return found.select("file", "row_ord", *(F.get("fields", F.lit(k)).alias(c) for k, c in enumerate(fields)))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", reg_fn.without_tags(F.col("html")).alias("text"))


def _messages(bodies: DataFrame) -> DataFrame:
    """Hex messages of derived bodies: request, response, write, broken request, private command."""
    h2 = lambda c: hexes.to_hex(c, 2)
    h4 = lambda c: hexes.to_hex(c, 4)
    qty, start, value, slave, kind = (F.col(c) for c in ("qty", "start", "value", "slave", "kind"))
    data = F.concat(*(F.when(qty >= i, h4((value + i) % 65536)).otherwise("") for i in range(1, 6)))  # derived messages have five registers at most
    counted = F.concat(h4(start), h4(qty), h2(qty * 2), data)
    body = (
        F.when(kind == 1, F.concat(h2(slave), F.lit("03"), h2(qty * 2), data)).when(kind == 2, F.concat(h2(slave), F.lit("10"), counted))
        .when(kind == 4, F.concat(h2(slave), F.lit("20"), counted)).otherwise(F.concat(h2(slave), F.lit("03"), h4(start), h4(qty)))
    )
    rows = reg_fn.settled(bodies.withColumn("body", body)).withColumn("crc", hexes.modbus_crc(F.col("body")))
    crc = hexes.to_hex(F.col("crc"), 4)
    wrong = F.when(F.col("crc") == 0, "FFFF").otherwise("0000")  # wrong whatever the body
    return rows.withColumn("message", F.concat("body", F.when(kind == 3, wrong).otherwise(F.concat(crc.substr(3, 2), crc.substr(1, 2)))))


def frame_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(derive.hex_bodies(spark, sf_dir))
    return rows.select("batch_id", hexes.modbus_crc(F.col("body")).cast("bigint").alias("crc"), hexes.additive_checksum(F.col("body")).cast("bigint").alias("additive"))


def frame_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.parse_messages(_messages(derive.hex_bodies(spark, sf_dir)).select("batch_id", F.lower("message").alias("text")))
    return rows.select(
        "batch_id", "protocol", *(F.col(c).cast("bigint").alias(c) for c in ("slave", "function_code", "start_address", "quantity", "byte_count")),
        F.col("checksum.valid").alias("crc_valid"), F.size("registers").cast("bigint").alias("n_registers"), F.size("fields").cast("bigint").alias("n_fields"),
        F.array_join("registers.raw_hex", "").alias("register_hex"), F.array_join("warnings.code", ",").alias("warnings"),
    )


def frame_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of several messages of all protocols, some in an envelope or after wake-up bytes, some faulty."""
    rows = reg_fn.settled(derive.segments(spark, sf_dir))
    body, kind = F.col("body"), F.col("kind")
    summed = F.when(kind.isin(0, 1, 2, 5, 6), body)
    rows, found = reg_fn.held(rows, {f"_w{k}": w for k, w in enumerate(hexes.words(summed))}), [F.col(f"_w{k}") for k in range(3)]
    rows = rows.withColumns({"_crc": hexes.to_hex(hexes.modbus_crc(summed, found), 4), "_total": hexes.additive_checksum(summed, found)})
    crc, total = F.col("_crc"), (F.col("_total") + F.when(kind == 5, 1).otherwise(0)) % 256
    framed = F.when(kind.isin(0, 1, 5), F.concat("wake", body, hexes.to_hex(total, 2), F.lit("16"))).when(kind.isin(2, 6), F.concat(body, crc.substr(3, 2), crc.substr(1, 2))).otherwise(body)
    rows = reg_fn.settled(rows.select("batch_id", "line", "kind", "serial", framed.alias("framed")))
    framed = F.when(F.col("kind") == 2, F.concat(F.lit("68"), F.hex("serial"), F.lit("68"), "framed")).otherwise(F.col("framed"))
    calls = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("line", framed.alias("framed")))).alias("parts"))  # the lines of an order
    found = frames.parse_messages(calls.select("batch_id", F.array_join(F.transform("parts", lambda p: p["framed"]), "&&").alias("text")))
    part = lambda name: F.get(F.filter("fields", lambda f: f["name"] == name), F.lit(0))["raw_hex"].alias(name)
    return found.select(
        "batch_id", F.col("index").cast("bigint").alias("index"), "error_code", "protocol", part("wakeupBytes"), part("address"), part("controlCode"), part("data"), "platform_serial",
        F.size("fields").cast("bigint").alias("n_fields"), F.size("registers").cast("bigint").alias("n_registers"), F.col("checksum.kind").alias("checksum"), F.col("checksum.received").alias("received"),
        F.col("checksum.valid").alias("valid"), F.array_join("warnings.code", ",").alias("warnings"),
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = derive.hex_bodies(spark, sf_dir)
    ask = _messages(bodies.withColumns({"asked": F.col("kind"), "kind": F.lit(0)})).withColumnRenamed("message", "request_hex").drop("body", "crc")
    both = _messages(ask.withColumns({"kind": F.lit(1), "qty": F.when(F.col("asked") == 2, F.col("qty") + 1).otherwise(F.col("qty"))}))
    return frames.parse_pairs(both.select("batch_id", "request_hex", F.col("message").alias("response_hex")), ["batch_id"])


def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).where("role = 'response'")
    return rows.select("batch_id", F.get("registers", F.lit(0))["address"].cast("bigint").alias("first_address"), F.size("registers").cast("bigint").alias("n_registers"), F.array_join("warnings.code", ",").alias("warnings"))


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 9 + 4
    text = lambda c: c.cast("string")
    address = F.col("p_partkey") % 65536  # 16 bits at any size
    endian = F.when(kind.isin(8, 9, 12), F.col("p_partkey") % 4).otherwise(F.col("p_partkey") % 2)
    rows = part.select(
        F.col("p_partkey").alias("ord"), F.lit("1").alias("id"), F.lit("1").alias("group"), F.concat(F.lit("DOC_"), "p_brand").alias("data_name"), F.lit("V").alias("unit"),
        text(address).alias("reg_add"), text(kind).alias("reg_type"), text(endian).alias("endian"), text(F.col("p_partkey") % 3).alias("dcm"),
        F.lit("0.5").alias("k"), F.lit("3").alias("fun_num"), F.lit("").alias("calc"), F.lit("1").alias("style"),
    )
    return explain.definitions(rows, _catalog(spark))


#: More definitions than this are shuffled: Spark sizes them by their file, which is smaller than what the driver would hold.
BROADCAST_DEFINITIONS = 100_000


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers of answers by their definitions; both are saved first, as Spark plans all that is left anew after each stage of a plan this deep."""
    scratch = Scratch(spark, "explained")
    answers = scratch.save(_pairs(spark, sf_dir).where("role = 'response'").select("batch_id", "registers"), "answers")
    defined = scratch.save(_definitions(spark, sf_dir), "definitions")
    return explain.explain(answers, ["batch_id"], defined if defined.count() <= BROADCAST_DEFINITIONS else defined.hint("merge"))


def register_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _explained(spark, sf_dir)
    return found.select("batch_id", F.col("position").cast("bigint").alias("position"), F.col("address").cast("bigint").alias("address"), "parameter_name", "raw_hex", F.col("numeric_value"), "meaning", F.array_join("warnings.code", ",").alias("warnings"))


def register_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explained(spark, sf_dir).select("batch_id", "position", "address", "converted_value")


def register_match_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _pairs(spark, sf_dir).where("role = 'response'").select("registers")
    found = explain.match_diagnostics(answers, _definitions(spark, sf_dir))
    return found.select("extracted_count", "matched_count", F.size("unmatched_addresses").cast("bigint").alias("n_unmatched"))


def register_interpretations(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.concat(hexes.to_hex(F.col("value"), 4), hexes.to_hex(F.col("start"), 4))
    rows = reg_fn.held(derive.hex_bodies(spark, sf_dir), {"frame": hexes.selected(digits)})
    found = hexes.interpretations(F.col("frame"))  # those that are asked for, not the texts and bits beside them
    names = [f"{order}_{kind}{bits}" for order in ("big", "little") for kind in ("int", "uint") for bits in (8, 16, 32)]
    return rows.select("batch_id", *(found[n].cast("bigint").alias(n) for n in names))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("=== Sheet: s"), F.col("doc_id").cast("string"), F.lit(" ===\n"))).otherwise("")
    return chunks.chunk(docs.select("doc_id", F.concat(head, "text").alias("text"))).select("doc_id", F.col("index").cast("bigint").alias("index"), "text", "prior_context")


def chunk_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("index"), "text")
    return chunks.prior_context(turns, 40).select("doc_id", "index", "prior_context")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turns at the same position of their conversation."""
    from pyspark.sql import Window

    turns = _table(spark, sf_dir, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    turns = turns.withColumn("position", place)
    ask = turns.where("role = 'user'").select("conv_id", "position", F.col("text").alias("question"))
    reply = turns.where("role = 'assistant'").select("conv_id", "position", F.col("text").alias("answer"))
    return ask.join(reply, ["conv_id", "position"], "left").withColumn("position", F.col("position").cast("bigint"))


def redacted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    text: Column = F.col("props")
    return _table(spark, sf_dir, "events").select("event_id", reg_fn.redacted(text, "click", "", "view").alias("props"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        log_entries, log_category_counts, log_summary, log_serial_errors, log_unique_serials, log_serial_totals, log_projects, log_disabled_rules, log_threads,
        log_heatmap, log_stuck_threads, log_samples, log_dispatch_costs, log_overview, log_rule_counts, log_file_lines, log_latest, log_file_names, log_report, register_sanitized, register_diagnostics, register_merged, register_files, register_addresses, register_texts, circuit_names,
        naming_catalog, naming_reference, detected_encodings, delimiter_stats, delimiter_choice, delimited_records, page_text, frame_checksums, frame_decoded, frame_calls, frame_pairs, register_explained, register_values, register_match_diagnostics, register_unmatched, validated_candidates,
        register_interpretations, chunk_documents, chunk_contexts, conversation_pairs, redacted_events, redacted_parts,
    )
}
