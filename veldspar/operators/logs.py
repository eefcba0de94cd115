"""Log analytics: DataFrames of lines to entries, and entries to counts, runs and event pairs.

Lines are rows (file_ord, line_no, line); their order is (file_ord, line_no) throughout,
never the order in which Spark happens to hold them. State that runs along a file is worked
out in blocks of BLOCK_LINES lines first; only one summary row a block is ordered as a whole,
so one very long file is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.functions import logs as fn
from veldspar.functions.registers import let, settled
from veldspar.operators import needles
from veldspar.scratch import Scratch

BLOCK_LINES = 100_000
ORDER = ("file_ord", "line_no")
_FACTS = "array<struct<section:string,name:string,detail:string,at:int>>"


def _kept(lines: DataFrame) -> DataFrame:
    """Stack lines and entries: file_ord, line_no, stack and the trimmed text, each matched once."""
    rows = lines.select(*ORDER, fn.is_stack(F.col("line")).alias("stack"), fn.trimmed(F.col("line")).alias("text"))
    return settled(rows).where(F.col("stack") | F.col("text").rlike(fn.LINE))


def _fields(rows: DataFrame, *more: str) -> DataFrame:
    """Parts of texts that have the line layout. As that is known, the signs that end a part are looked for one after the other, once."""
    text, find = F.col("text"), lambda sign, at: F.call_function("locate", F.lit(sign), F.col("text"), at)
    cut = lambda a, b: F.substring(text, a, b - a)
    parts = lambda level, thread, cls, line: F.struct(  # noqa: E731  where each ends
        F.substring(text, 1, 23).alias("ts"), cut(level + 2, thread).alias("thread"), cut(thread + 2, cls).alias("class"),
        cut(cls + 1, line).alias("line"), F.substring(text, line + 2, F.length(text)).alias("message"),
    )
    found = let(find("]", F.lit(26)), lambda a: let(find("]", a + 2), lambda b: let(find(":", b + 2), lambda c: let(find("]", c + 1), lambda d: parts(a, b, c, d)))))
    rows = settled(rows.select(*ORDER, found.alias("part"), *more)).select(*ORDER, "part.*", *more)
    return rows.withColumn("line", F.coalesce(fn.unsigned(F.col("line"), 2**32 - 1), F.lit(0)).cast("bigint"))


def parsed(lines: DataFrame) -> DataFrame:
    """Entries of the lines with file_ord, line_no, ts, thread, class, line, message. Nothing is shuffled."""
    return _fields(_kept(lines).where("not stack"))


def entries(lines: DataFrame) -> DataFrame:
    """Entries of the lines as ``parsed`` gives them, and has_stack.

    Lines that begin with a tab mark the entry before them in the same file; other lines
    that are not entries are dropped and change nothing.
    """
    rows = _kept(lines).withColumn("block", F.floor(F.col("line_no") / BLOCK_LINES))
    along = Window.partitionBy("file_ord", "block").orderBy("line_no")
    rows = rows.withColumn("follows", F.lead("stack").over(along))
    # A block that begins with stack lines marks the last entry of the blocks before it.
    first = F.min_by("stack", "line_no").alias("first_stack")
    blocks = rows.select("file_ord", "line_no", "block", "stack").groupBy("file_ord", "block").agg(first, F.max(F.when(~F.col("stack"), F.col("line_no"))).alias("last_entry"))
    below = Window.partitionBy("file_ord").orderBy("block")
    spilled = blocks.withColumn("owner", F.last("last_entry", ignorenulls=True).over(below.rowsBetween(Window.unboundedPreceding, -1)))
    spilled = spilled.where("first_stack and owner is not null").select("file_ord", F.col("owner").alias("line_no"), F.lit(True).alias("spilled")).distinct()
    found = rows.where("not stack").join(spilled, list(ORDER), "left")
    marked = F.coalesce("follows", F.lit(False)) | F.coalesce("spilled", F.lit(False))
    return _fields(found.withColumn("has_stack", marked), "has_stack")


def categorised(rows: DataFrame) -> DataFrame:
    """Entries with ``category`` and its display name."""
    code = fn.category(F.col("class"), F.col("message"))
    return rows.withColumn("category", code).withColumn("category_name", fn.category_name(F.col("category")))


def rules(spark: SparkSession) -> DataFrame:
    """The marks of categories as a table (ord, place, needle, category)."""
    rows = [(k, place, text, name) for k, (name, place, texts) in enumerate(fn.RULES) for text in texts]
    return spark.createDataFrame(rows, "ord bigint, place string, needle string, category string")


def categorised_by_table(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Entries with ``category`` by a table of rules as ``rules`` gives it, of any length. A connection leak of nothing is Other."""
    out = needles.categorised(rows, table, {"class": F.col("class"), "message": F.col("message")}, "Other")
    nothing = (F.col("category") == "ConnectionLeak") & (fn.leaked(F.col("message")) <= 0)
    return out.withColumn("category", F.when(nothing, "Other").otherwise(F.col("category")))


def category_counts(rows: DataFrame) -> DataFrame:
    """Entries of each category, most frequent first, ties by code."""
    return categorised(rows).groupBy("category", "category_name").agg(F.count(F.lit(1)).alias("entries")).orderBy(F.desc("entries"), "category")


def serial_errors(rows: DataFrame) -> DataFrame:
    """Occurrences of each serial number in entries of each category."""
    found = categorised(rows).select(F.explode(fn.serials(F.col("message"))).alias("sn"), "category_name")
    return found.groupBy("sn", F.col("category_name").alias("error_type")).agg(F.count(F.lit(1)).alias("occurrences"))


def unique_serials(rows: DataFrame) -> DataFrame:
    """Distinct serial numbers in order."""
    return rows.select(F.explode(fn.serials(F.col("message"))).alias("sn")).distinct().orderBy("sn")


def serial_totals(rows: DataFrame) -> DataFrame:
    """Serial numbers by total, and their categories within, most frequent first."""
    counts = serial_errors(rows).withColumn("total", F.sum("occurrences").over(Window.partitionBy("sn")))
    return counts.orderBy(F.desc("total"), "sn", F.desc("occurrences"), "error_type")


def _first_seen(found: DataFrame, name: str) -> DataFrame:
    """Distinct values with the place where each was seen first, in that order."""
    seen = found.groupBy(name).agg(F.min(F.struct(*ORDER, "at")).alias("seen"))
    return seen.select(name, F.col("seen.file_ord").alias("first_file"), F.col("seen.line_no").alias("first_line"), F.col("seen.at").alias("first_at")).orderBy("first_file", "first_line", "first_at")


def projects(rows: DataFrame) -> DataFrame:
    """Project names in the order in which they are first seen."""
    return _first_seen(rows.select(*ORDER, F.posexplode(fn.projects(F.col("message"))).alias("at", "project")), "project")


def disabled_rules(rows: DataFrame) -> DataFrame:
    """Rule ids of disabled dispatches in the order in which they are first seen."""
    found = categorised(rows).where("category = 'DispatchDisabled'").select(*ORDER, F.posexplode(F.array(fn.disabled_rule(F.col("message")))).alias("at", "rule_id"))
    return _first_seen(found.where("rule_id is not null"), "rule_id")


def threads(rows: DataFrame) -> DataFrame:
    """Thread names in the order in which they are first seen."""
    return _first_seen(rows.select(*ORDER, F.posexplode(F.array("thread")).alias("at", "thread")), "thread")


def summary(rows: DataFrame) -> DataFrame:
    """One row of totals. total_lines counts an entry with a stack twice; the times are those of the first and last entry, not the least and greatest."""
    place = F.struct(*ORDER)
    return categorised(rows).agg(
        F.count(F.lit(1)).alias("entry_count"),
        (F.count(F.lit(1)) + F.count_if("has_stack")).alias("total_lines"),
        F.min_by("ts", place).alias("time_start"),
        F.max_by("ts", place).alias("time_end"),
        F.count_if(F.col("category") == "ConnectionLeak").alias("connection_leaks"),
        F.count_distinct("thread").alias("thread_count"),
    )


def latest(rows: DataFrame, key: str = "thread", n: int = 64) -> DataFrame:
    """The last ``n`` entries of each key, with their place from the end; earlier ones give way. Each task keeps ``n`` a key before the shuffle."""
    along = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in ORDER))
    return rows.withColumn("from_end", F.row_number().over(along)).where(F.col("from_end") <= n)


def overview(lines: DataFrame) -> DataFrame:
    """All counts of the lines in one pass: section, name, detail, n, first_file, first_line, first_at.

    Each line gives its facts: that it is a line, and if it is an entry that it is one, its category,
    its serials with their category, its thread, its projects, a disabled rule and a leak.
    One aggregate over all facts gives every section; what is shuffled are partial rows of distinct
    facts. lines, entries and leaks are one row each; the detail of entries is the times of the first and last one.
    """
    entry = fn.trimmed(F.col("line")).rlike(fn.LINE) & ~fn.is_stack(F.col("line"))
    rows = settled(lines.select(*ORDER, F.when(entry, fn.trimmed(F.col("line"))).alias("text"), F.when(entry, True).alias("entry")))
    rows = settled(categorised(_fields(rows, "entry")))
    fact = lambda section, name=F.lit(""), detail=F.lit(""), at=F.lit(0): F.struct(F.lit(section).alias("section"), name.alias("name"), detail.alias("detail"), at.cast("int").alias("at"))
    each = lambda found, section, detail=F.lit(""): F.transform(found, lambda x, i: fact(section, x, detail, i))
    message, code = F.col("message"), F.col("category")
    of_entry = F.concat(
        F.array(fact("entries"), fact("categories", F.col("category_name")), fact("threads", F.col("thread"))),
        each(fn.serials(message), "serials", F.col("category_name")), each(fn.projects(message), "projects"),
        F.when(code == "ConnectionLeak", F.array(fact("leaks"))).otherwise(F.array().cast(_FACTS)),
        F.when((code == "DispatchDisabled") & fn.disabled_rule(message).isNotNull(), F.array(fact("rules", fn.disabled_rule(message)))).otherwise(F.array().cast(_FACTS)),
    )
    facts = F.when(F.col("entry"), F.concat(F.array(fact("lines")), of_entry)).otherwise(F.array(fact("lines")))
    facts = rows.select(*ORDER, "ts", F.explode(facts).alias("fact")).select(*ORDER, "ts", "fact.*")
    place = F.struct(*ORDER, "at")
    out = facts.groupBy("section", "name", "detail").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("seen"), F.min_by("ts", place).alias("start"), F.max_by("ts", place).alias("end"))
    times = F.when(F.col("section") == "entries", F.concat(F.col("start"), F.lit(" - "), F.col("end"))).otherwise(F.col("detail"))
    return out.select("section", "name", times.alias("detail"), "n", F.col("seen.file_ord").alias("first_file"), F.col("seen.line_no").alias("first_line"), F.col("seen.at").alias("first_at"))


def heatmap(rows: DataFrame, minutes: int = 10) -> DataFrame:
    """Runs of consecutive entries in one time bucket: run, hour, entries.

    Unsorted input repeats buckets. Runs are found within blocks of lines, and go on where a
    block begins with the bucket that ended the one before. What is ordered as a whole is a
    row a block: its first and last bucket and how many runs it has.
    """
    if minutes <= 0:
        raise ValueError("a bucket has a minute at least")
    block = ["file_ord", "block"]
    keyed = rows.select(*ORDER, fn.bucket(F.col("ts"), minutes).alias("hour"), F.floor(F.col("line_no") / BLOCK_LINES).alias("block")).where("hour is not null")
    along = Window.partitionBy(*block).orderBy("line_no")
    keyed = keyed.withColumn("new", F.coalesce((F.col("hour") != F.lag("hour").over(along)).cast("int"), F.lit(1)))
    keyed = keyed.withColumn("piece", F.sum("new").over(along))
    pieces = keyed.groupBy(*block, "piece").agg(F.first("hour").alias("hour"), F.count(F.lit(1)).alias("entries"))
    blocks = pieces.groupBy(*block).agg(F.min_by("hour", "piece").alias("first"), F.max_by("hour", "piece").alias("last"), F.max("piece").alias("pieces"))
    whole = Window.orderBy(*block)
    blocks = blocks.withColumn("goes_on", F.coalesce((F.col("first") == F.lag("last").over(whole)).cast("int"), F.lit(0)))
    before = F.sum(F.col("pieces") - F.col("goes_on")).over(whole) - F.col("pieces")  # so that piece 1 of a block that goes on has the run before
    runs = pieces.join(blocks.select(*block, before.alias("before")), block).withColumn("run", F.col("before") + F.col("piece"))
    return runs.groupBy("run").agg(F.first("hour").alias("hour"), F.sum("entries").alias("entries")).orderBy("run")


def stuck_threads(rows: DataFrame, threshold_ms: int = 10_000) -> DataFrame:
    """Dispatches that took more than ``threshold_ms``: an end whose thread's dispatch mark before it is a start.

    Marks are paired within blocks of lines; what is ordered for a whole thread is a row a
    block, its last mark.
    """
    starts, ends = F.col("message").startswith("[DISPATCH-START]"), F.col("message").startswith("[DISPATCH-END]")
    mark = F.struct(starts.alias("starts"), "ts").alias("mark")
    marks = rows.where(starts | ends).select("thread", *ORDER, F.floor(F.col("line_no") / BLOCK_LINES).alias("block"), mark, fn.dispatch_cost(F.col("message")).alias("duration_ms"))
    block = ["thread", "file_ord", "block"]
    last = marks.groupBy(*block).agg(F.max_by("mark", "line_no").alias("last"))
    last = last.select(*block, F.lag("last").over(Window.partitionBy("thread").orderBy("file_ord", "block")).alias("earlier"))
    marks = marks.withColumn("before", F.lag("mark").over(Window.partitionBy(*block).orderBy("line_no"))).join(last, block)
    marks = marks.withColumn("before", F.coalesce("before", "earlier"))
    found = marks.where(~F.col("mark.starts") & F.col("before.starts") & (F.col("duration_ms") > threshold_ms))
    return found.select("thread", F.col("before.ts").alias("start_time"), F.col("mark.ts").alias("end_time"), F.col("duration_ms").cast("bigint").alias("duration_ms")).orderBy(F.desc("duration_ms"), "end_time", "thread")


def _ranked(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each category."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("category").orderBy(*ORDER))).where(F.col("nth") <= n)


def samples(rows: DataFrame, per_category: int = 5) -> DataFrame:
    """The first entries of each category."""
    return _ranked(categorised(rows), per_category).select("category", "nth", *ORDER, "ts", "thread", "message")


def _noted(lines: DataFrame) -> DataFrame:
    """Stack lines and entries with all that a report says of an entry: ts, thread, message, category, serials, rule. Each line is parsed once."""
    kept = _kept(lines).withColumn("text", F.when(~F.col("stack"), F.col("text")))
    rows = settled(_fields(kept, "stack").withColumn("category", fn.category(F.col("class"), F.col("message"))))
    rule = F.when(F.col("category") == "DispatchDisabled", fn.disabled_rule(F.col("message")))
    return rows.select(*ORDER, "stack", "ts", "thread", "message", "category", fn.serials(F.col("message")).alias("serials"), rule.alias("rule"))


def _stacks(rows: DataFrame) -> DataFrame:
    """One row: how many entries of ``rows`` (file_ord, line_no, stack) have a stack, as ``entries`` marks them. What is shuffled has no text."""
    block = ["file_ord", "block"]
    rows = rows.select(*ORDER, "stack", F.floor(F.col("line_no") / BLOCK_LINES).alias("block"))
    follows = F.lead("stack").over(Window.partitionBy(*block).orderBy("line_no"))
    blocks = rows.withColumn("marked", ~F.col("stack") & F.coalesce(follows, F.lit(False))).groupBy(*block).agg(
        F.count_if("marked").alias("marked"), F.min_by("stack", "line_no").alias("first_stack"),
        F.max(F.when(~F.col("stack"), F.col("line_no"))).alias("last_entry"), F.max("line_no").alias("last_line"),
    )
    # A block that begins with stack lines marks the last entry before it, unless lines of its own block have done so.
    above = Window.partitionBy("file_ord").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.when(F.col("last_entry").isNotNull(), F.struct(F.col("last_entry").alias("at"), (F.col("last_entry") == F.col("last_line")).alias("open")))
    blocks = blocks.withColumn("owner", F.last(owner, ignorenulls=True).over(above))
    spilled = F.when(F.col("first_stack") & F.col("owner.open"), F.struct("file_ord", "owner.at"))
    return blocks.agg((F.coalesce(F.sum("marked"), F.lit(0)) + F.count_distinct(spilled)).alias("stacks"))


def report(lines: DataFrame, minutes: int = 10, threshold_ms: int = 10_000) -> DataFrame:
    """Lines of a plain-text report: section, nth, line. Each section keeps its display limit.

    Sections are overview, categories, stuck, heatmap, serials, rules and, for each category, its first entries.
    Lines are parsed once, into a table; each section reads the columns of it that it needs, and none shuffles texts that it does not show.
    """
    scratch = Scratch(lines.sparkSession, "log-report")
    noted = scratch.save(_noted(lines), "noted")
    rows = noted.where("not stack")
    serial = scratch.save(rows.select(F.explode("serials").alias("name")).distinct(), "serials")

    def numbered(frame: DataFrame, section: Column | str, limit: int | None, text: Column, *order: Column) -> DataFrame:
        top = frame.orderBy(*order).limit(limit) if limit else frame  # a display limit, or a table of one row a distinct fact
        name = F.lit(section) if isinstance(section, str) else section
        return top.select(name.alias("section"), F.row_number().over(Window.orderBy(*order)).alias("nth"), text.alias("line"))

    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    place = F.struct(*ORDER)
    times = text(F.min_by("ts", place), " ~ ", F.max_by("ts", place))
    sums = rows.agg(times.alias("times"), F.count(F.lit(1)).alias("entries"), F.count_if(F.col("category") == "ConnectionLeak").alias("leaks"))
    for one in (rows.select("thread").distinct().agg(F.count(F.lit(1)).alias("threads")), serial.agg(F.count(F.lit(1)).alias("serials")), _stacks(noted)):
        sums = sums.crossJoin(one)  # one row each
    kinds = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).select(fn.category_name(F.col("category")).alias("name"), "n")
    seen = rows.where("rule is not null").groupBy(F.col("rule").alias("name"), "file_ord").agg(F.min("line_no").alias("line_no"))
    seen = seen.groupBy("name").agg(F.min(place).alias("seen"))
    first = _ranked(rows.select("category", *ORDER), 3).select("category", *ORDER).distinct()  # three rows a category at most
    first = _ranked(rows.join(F.broadcast(first), ["category", *ORDER]), 3)
    said = F.array(
        text("- 时间范围: ", F.coalesce("times", F.lit("N/A ~ N/A"))), text("- 总行数: ", F.col("entries") + F.col("stacks"), ", 条目: ", F.col("entries"), ", 线程数: ", F.col("threads")),
        text("- 涉及设备 SN: ", F.col("serials"), " 个"), text("- 连接泄漏次数: ", F.col("leaks")),
    )
    count = lambda name, n: text("- ", F.col(name), ": ", F.col(n), " 条")
    parts = [
        sums.select(F.lit("overview").alias("section"), F.posexplode(said).alias("nth", "line")).withColumn("nth", F.col("nth") + 1),
        numbered(kinds, "categories", 15, count("name", "n"), F.desc("n"), F.col("name")),
        numbered(stuck_threads(rows, threshold_ms), "stuck", 10, text("- `", F.col("thread"), "`: ", F.col("duration_ms"), "ms"), F.desc("duration_ms"), F.col("end_time"), F.col("thread")),
        numbered(heatmap(rows, minutes).where("run <= 20"), "heatmap", 20, count("hour", "entries"), F.col("run")),
        numbered(serial, "serials", 20, text("- `", F.col("name"), "`"), F.col("name")),
        numbered(seen, "rules", None, text("- ", F.col("name")), F.col("seen")),
        first.select(text("samples: ", fn.category_name(F.col("category"))).alias("section"), "nth", text("- `", F.col("ts"), "` [", F.col("thread"), "] ", F.col("message")).alias("line")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
