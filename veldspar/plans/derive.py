"""Inputs derived from the relational tables, as SQL that Spark and DuckDB read alike.

The tables hold no logs, frames or register maps, so queries make their inputs from events,
part and lineitem by fixed rules. ``{ts}`` is the one place where the dialects differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TS = {"spark": "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS')", "duckdb": "strftime(ts, '%Y-%m-%d %H:%M:%S.%g')"}

_MESSAGES = """
CASE event_id % 16
 WHEN 0 THEN 'GET /api/' || event_type
 WHEN 1 THEN 'device not register sn=' || CAST(25012004590000 + user_id AS STRING)
 WHEN 2 THEN '[DISPATCH-START] rule=' || CAST(user_id % 11 AS STRING)
 WHEN 3 THEN '[DISPATCH-END] rule=1 cost=' || CAST((event_id * 37) % 20000 AS STRING) || 'ms'
 WHEN 4 THEN 'disabled ruleId=' || CAST(user_id % 11 AS STRING)
 WHEN 5 THEN 'no rule for ' || event_type
 WHEN 6 THEN 'auth failed'
 WHEN 7 THEN '参数缺失 sn ' || CAST(25012004590000 + user_id % 50 AS STRING)
 WHEN 8 THEN '登录信息错误'
 WHEN 9 THEN 'CommonService.getData error'
 WHEN 10 THEN 'Clear leak clients end: ' || CAST(event_id % 3 AS STRING)
 WHEN 11 THEN 'index out of bounds'
 WHEN 12 THEN 'no data for ' || CAST(25012004590000 + user_id % 50 AS STRING) || ' and ' || CAST(25012004590000 + user_id % 7 AS STRING)
 WHEN 13 THEN '[DISPATCH-END] rule=2'
 WHEN 14 THEN 'TokenFilter Exception'
 ELSE '{"name":"project-' || CAST(user_id % 5 AS STRING) || '"},{"name":"123"} ok' END
"""
_CLASSES = """
CASE event_id % 16 WHEN 0 THEN 'com.app.RequestRouterAspect' WHEN 5 THEN 'com.app.ComposeHandler' WHEN 6 THEN 'com.app.MqttAuthService'
 WHEN 11 THEN 'com.app.AlgorithmHandler' WHEN 12 THEN 'com.app.SafeElectricServiceImpl' ELSE 'com.app.Worker' END
"""

#: Lines of logs: an entry for each event, stack lines after some, and lines that are neither.
LOG_LINES = f"""
SELECT CAST(floor(event_id / 2500.0) AS INT) AS file_ord, event_id * 4 AS line_no,
       {{ts}} || ' [' || CASE WHEN event_id % 3 = 0 THEN 'ERROR' ELSE 'INFO' END || '][exec-' || CAST(user_id % 8 AS STRING) || '][' || {_CLASSES}
       || ':' || CAST(100 + event_id % 900 AS STRING) || '] ' || {_MESSAGES} AS line
FROM events
UNION ALL
SELECT CAST(floor(event_id / 2500.0) AS INT), event_id * 4 + 1, 'Caused by: java.lang.IllegalStateException' FROM events WHERE event_id % 5 = 0
UNION ALL
SELECT CAST(floor(event_id / 2500.0) AS INT), event_id * 4 + 2, chr(9) || 'at com.app.Worker.run(Worker.java:1)' FROM events WHERE event_id % 7 = 0
"""

#: Records of register tables: whole ones, some without their unit, some damaged.
REGISTER_ROWS = """
SELECT p_partkey % 20 AS doc_id, CAST(p_partkey % 3 AS INT) AS batch_ord, p_partkey AS row_ord,
       CAST(p_partkey AS STRING) AS c_id, CAST(p_size % 4 AS STRING) AS c_group,
       CASE p_partkey % 6 WHEN 0 THEN 'CH' || CAST(p_partkey % 5 + 1 AS STRING) || '_Ua' WHEN 1 THEN '第十' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '二' END || '路:ia'
         WHEN 2 THEN p_name WHEN 3 THEN 'DOC_ DOC_' || p_brand WHEN 4 THEN 'CH1-4 Ua' ELSE '回路2' END AS c_name,
       CASE WHEN p_partkey % 23 = 0 THEN '0x' || CAST(p_partkey % 90 AS STRING) ELSE CAST((p_partkey * 7) % 400 AS STRING) END AS c_address,
       CAST(p_partkey % 12 + 1 AS STRING) AS c_type,
       CASE WHEN p_partkey % 17 = 0 THEN 11 WHEN p_partkey % 19 = 0 THEN 5 ELSE 12 END AS c_width
FROM part
"""

#: Bytes of Modbus messages before their checksum: requests, responses, writes, private commands.
HEX_BODIES = """
SELECT l_orderkey * 8 + l_linenumber AS batch_id, l_linenumber AS slave, l_partkey % 65536 AS start, CAST(l_quantity AS INT) % 4 + 1 AS qty,
       CAST(l_orderkey % 5 AS INT) AS kind, CAST(l_suppkey % 65536 AS INT) AS value
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) AS one
"""

#: Names as register tables write them, one of ten forms a part, and type and endian codes.
CIRCUIT_NAMES = """
SELECT p_partkey, CAST(p_partkey % 14 AS INT) AS kind, CAST(p_size % 20 AS INT) AS endian, CAST(p_partkey % 10 AS INT) AS form, n, CASE p_partkey % 10
  WHEN 0 THEN 'CH' || n || '_Ua' WHEN 1 THEN 'channel ' || n || ': Ia' WHEN 2 THEN '第' || n || '路 Ua' WHEN 3 THEN n || ' 号回路电压' WHEN 4 THEN '回路' || n || ': Ep'
  WHEN 5 THEN 'CH1-CH' || n || ' Registers' WHEN 6 THEN '第1路至第' || n || '路遥测数据' WHEN 7 THEN 'Channel 1 to ' || n WHEN 8 THEN 'DOC_ DOC_CH ' || n || ' Ep' ELSE 'plain ' || n END AS name
FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 = 0 THEN '十二' ELSE CAST(p_partkey % 40 + 1 AS STRING) END AS n FROM part) AS t
"""

#: Segments of calls, several a call: DL/T 645 and CJ/T 188 frames, enveloped and bare Modbus requests before their checksums, a frame
#: whose checksum is wrong, and faulty segments. ``wake`` goes before a frame and ``serial`` around it.
SEGMENTS = """
SELECT batch_id, line, kind, wake, serial, address, CASE kind
  WHEN 0 THEN '68' || low6 || '68' || CASE WHEN partkey % 2 = 0 THEN '11' ELSE '91' END || '0633343535' || lpad(hex(partkey % 65536), 4, '0')
  WHEN 5 THEN '68' || low6 || '68' || '110633343535' || lpad(hex(partkey % 65536), 4, '0')
  WHEN 1 THEN '6810' || low6 || '00' || '81' || lpad(hex(line), 2, '0') || '04' || lpad(hex(partkey), 8, '0')
  WHEN 3 THEN 'ABC' WHEN 4 THEN 'ZZ' || lpad(hex(line), 2, '0') WHEN 7 THEN 'AA&BB' WHEN 8 THEN ''
  ELSE lpad(hex(line), 2, '0') || '03' || lpad(hex(partkey % 65536), 4, '0') || '000' || CAST(line AS STRING) END AS body
FROM (
  SELECT *, CASE kind WHEN 0 THEN 'FEFEFEFE' WHEN 1 THEN 'FEFE' WHEN 5 THEN 'FE' ELSE '' END AS wake, CASE WHEN kind = 2 THEN '25' || address ELSE '' END AS serial,
         substring(address, 11, 2) || substring(address, 9, 2) || substring(address, 7, 2) || substring(address, 5, 2) || substring(address, 3, 2) || substring(address, 1, 2) AS low6
  FROM (
    SELECT l_orderkey AS batch_id, CAST(l_linenumber AS INT) AS line, CAST((l_orderkey + l_linenumber) % 9 AS INT) AS kind, min(l_partkey) AS partkey, lpad(CAST(l_orderkey * 8 + l_linenumber AS STRING), 12, '0') AS address
    FROM lineitem GROUP BY l_orderkey, l_linenumber
  ) AS one
) AS two
"""

#: Turns as small tables: words are cells, sentences rows, in one of four delimiters.
DELIMITED_TEXTS = """
SELECT conv_id, turn, replace(replace(replace(coalesce(text, ''), '"', ''), '. ', chr(10)), ' ', CASE (conv_id + turn) % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END) AS text FROM conversations
"""


def _view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


#: Lines of lineitem that a task groups, about: few enough that its groups fit in memory, so nothing is spilled however many lines there are.
DEALT_LINES = 250_000


def _lines(spark: SparkSession, sf_dir: str) -> None:
    """The view of lineitem, dealt by what its lines are grouped by, in more parts the more there are.

    Nearly every group is one line, so groups held before the shuffle would save nothing and spill.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = max(spark.sparkContext.defaultParallelism, lines.count() // DEALT_LINES + 1)
    lines.repartition(parts, "l_orderkey", "l_linenumber").createOrReplaceTempView("lineitem")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows file_ord, line_no, line."""
    _view(spark, sf_dir, "events")
    return spark.sql(LOG_LINES.replace("{ts}", TS["spark"]))


def register_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows doc_id, batch_ord, row_ord, fields."""
    _view(spark, sf_dir, "part")
    rows = spark.sql(REGISTER_ROWS)
    return rows.selectExpr(
        "doc_id", "batch_ord", "row_ord",
        """CASE c_width WHEN 12 THEN array(c_id, c_group, c_name, 'kW', c_address, c_type, '0', '1', '1', '3', '', '1')
           WHEN 11 THEN array(c_id, '1', c_name, c_address, c_type, '0', '1', '1', '3', '', '1') ELSE array(c_id, c_group, c_name, c_address, c_type) END AS fields""",
    )


def hex_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows batch_id, slave, start, qty, kind, value."""
    _lines(spark, sf_dir)
    return spark.sql(HEX_BODIES)


def circuit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows p_partkey, kind, endian, form, n, name."""
    _view(spark, sf_dir, "part")
    return spark.sql(CIRCUIT_NAMES)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows batch_id, line, kind, wake, serial, address, body."""
    _lines(spark, sf_dir)
    return spark.sql(SEGMENTS)


def delimited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows conv_id, turn, text."""
    _view(spark, sf_dir, "conversations")
    return spark.sql(DELIMITED_TEXTS)
