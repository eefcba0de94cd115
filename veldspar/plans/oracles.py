"""SQL for DuckDB that states the registered queries over the same derived inputs."""

from __future__ import annotations

from veldspar.plans import derive

_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) \[(\w+)\]\[([^\]]+)\]\[([^:]+):(\d+)\] (.*)$"
_PART = "regexp_extract(line, '{p}', {k})"

_ENTRIES = f"""
log_lines AS ({derive.LOG_LINES.replace("{ts}", derive.TS["duckdb"])}),
marked AS (
  SELECT *, line LIKE chr(9) || '%' AS stack, regexp_matches(line, '{_LINE}') AS entry FROM log_lines
), followed AS (
  SELECT *, lead(stack) OVER (PARTITION BY file_ord ORDER BY line_no) AS follows FROM marked WHERE stack OR entry
), entries AS (
  SELECT file_ord, line_no, {_PART.format(p=_LINE, k=1)} AS ts, {_PART.format(p=_LINE, k=3)} AS thread, {_PART.format(p=_LINE, k=4)} AS class,
         CAST({_PART.format(p=_LINE, k=5)} AS BIGINT) AS line, {_PART.format(p=_LINE, k=6)} AS message, coalesce(follows, false) AS has_stack
  FROM followed WHERE entry
)
"""

_CATEGORISED = f"""
{_ENTRIES}, categorised AS (
  SELECT *, CASE
    WHEN contains(class, 'RequestRouterAspect') THEN 'HttpRequest'
    WHEN contains(message, 'device not register') THEN 'DeviceNotRegistered'
    WHEN contains(message, '[DISPATCH-START]') OR contains(message, '[DISPATCH-END]') OR contains(message, '[DISPATCH-COST]') THEN 'DispatchLifecycle'
    WHEN contains(message, 'disabled ruleId=') THEN 'DispatchDisabled'
    WHEN contains(class, 'ComposeHandler') THEN 'ProtocolTransformError'
    WHEN contains(class, 'MqttAuthService') THEN 'MqttAuthError'
    WHEN contains(message, '参数缺失') THEN 'DeviceRegisterError'
    WHEN contains(message, '登录信息错误') THEN 'TokenAuthError'
    WHEN contains(message, 'CommonService.getData error') THEN 'ModbusTcpError'
    WHEN contains(message, 'Clear leak clients end:') THEN CASE WHEN CAST(regexp_extract(message, 'end: ([0-9]+)', 1) AS INT) > 0 THEN 'ConnectionLeak' ELSE 'Other' END
    WHEN contains(class, 'AlgorithmHandler') THEN 'ByteBufError'
    WHEN contains(class, 'SafeElectricServiceImpl') THEN 'SafeElectricError'
    WHEN contains(message, 'TokenFilter Exception') THEN 'AttachmentError'
    ELSE 'Other' END AS category
  FROM entries
), names(category, category_name) AS (
  VALUES ('HttpRequest', 'HTTP API请求'), ('DeviceNotRegistered', '设备未注册'), ('DispatchLifecycle', 'Dispatch调度生命周期'), ('DispatchDisabled', 'Dispatch策略禁用'),
    ('ProtocolTransformError', '协议转换错误'), ('MqttAuthError', 'MQTT认证错误'), ('DeviceRegisterError', '设备注册参数缺失'), ('TokenAuthError', 'Token认证失败'),
    ('ModbusTcpError', 'Modbus TCP错误'), ('ConnectionLeak', '连接泄漏'), ('ByteBufError', 'ByteBuf越界'), ('SafeElectricError', '电气设备数据异常'), ('AttachmentError', '附件/Token错误'), ('Other', '其他')
), serials AS (
  SELECT unnest(regexp_extract_all(message, '\\b(\\d{{14,}})\\b', 1)) AS sn, category_name AS error_type FROM categorised JOIN names USING (category)
)
"""

_HEATMAP = """, keyed AS (
  SELECT file_ord, line_no, substr(ts, 1, 14) || lpad(CAST(CAST(substr(ts, 15, 2) AS INT) // 10 * 10 AS VARCHAR), 2, '0') AS hour FROM entries
), changed AS (
  SELECT *, CASE WHEN hour = lag(hour) OVER (ORDER BY file_ord, line_no) THEN 0 ELSE 1 END AS fresh FROM keyed
), runs AS (
  SELECT hour, sum(fresh) OVER (ORDER BY file_ord, line_no) AS run FROM changed
)
SELECT CAST(run AS BIGINT) AS run, hour, count(*) AS entries FROM runs GROUP BY run, hour
"""

_REGISTERS = f"""
register_rows AS ({derive.REGISTER_ROWS}), sanitized AS (
  SELECT doc_id, batch_ord, row_ord, c_width, c_width <> 5 AS valid, c_width = 11 AND c_address NOT LIKE '0x%' OR c_width = 11 AS repaired, c_address, c_type, row_ord % 6 AS shape,
    CASE row_ord % 6 WHEN 0 THEN 'Ua' WHEN 1 THEN 'Ia' WHEN 2 THEN 'DOC_' || c_name WHEN 3 THEN 'DOC_' || substr(c_name, 10) ELSE c_name END AS new_name,
    CASE row_ord % 6 WHEN 0 THEN CAST(row_ord % 5 + 1 AS VARCHAR) WHEN 1 THEN CASE WHEN row_ord % 2 = 0 THEN '10' ELSE '12' END
      ELSE CASE WHEN c_width = 11 THEN '1' WHEN CAST(c_group AS INT) >= 1 THEN c_group ELSE '1' END END AS new_group, c_name, c_group
  FROM register_rows
)
"""

_MERGED = f"""
WITH RECURSIVE {_REGISTERS}, shaped AS (
  SELECT doc_id, batch_ord, row_ord, c_width, new_name AS data_name, new_group AS grp, c_type AS reg_type,
    CASE WHEN c_width = 11 AND c_address LIKE '0x%' THEN CAST(CAST(c_address AS INT) AS VARCHAR) ELSE c_address END AS reg_add
  FROM sanitized WHERE valid
), once AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, c_width, grp, data_name, reg_add, reg_type ORDER BY batch_ord, row_ord) AS nth,
    try_cast(CASE WHEN reg_add LIKE '0x%' THEN NULL ELSE reg_add END AS BIGINT) AS address,
    CASE WHEN CAST(reg_type AS INT) IN (8, 9, 12) THEN 2 WHEN CAST(reg_type AS INT) IN (10, 11) THEN 4 ELSE 1 END AS width
  FROM shaped
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY address, width, batch_ord, row_ord) AS rn FROM once WHERE nth = 1 AND address IS NOT NULL
), fold AS (
  SELECT p.*, true AS kept, address + width - 1 AS most, address AS at, CAST(reg_type AS INT) <= 3 AS bits FROM placed p WHERE rn = 1
  UNION ALL
  SELECT p.*, p.address > f.most OR (p.address = f.at AND f.bits AND CAST(p.reg_type AS INT) <= 3) AS kept,
    CASE WHEN p.address > f.most OR (p.address = f.at AND f.bits AND CAST(p.reg_type AS INT) <= 3) THEN greatest(f.most, p.address + p.width - 1) ELSE f.most END,
    CASE WHEN p.address > f.most OR (p.address = f.at AND f.bits AND CAST(p.reg_type AS INT) <= 3) THEN p.address ELSE f.at END,
    CASE WHEN p.address > f.most THEN CAST(p.reg_type AS INT) <= 3 ELSE f.bits END
  FROM fold f JOIN placed p ON p.doc_id = f.doc_id AND p.rn = f.rn + 1
), every AS (
  SELECT doc_id, batch_ord, row_ord, address, width, data_name, reg_add, reg_type, grp, kept FROM fold
  UNION ALL SELECT doc_id, batch_ord, row_ord, address, width, data_name, reg_add, reg_type, grp, true FROM once WHERE nth = 1 AND address IS NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, kept ORDER BY address IS NULL, address, width, batch_ord, row_ord) AS n FROM every
)
SELECT doc_id, CASE WHEN kept THEN n END AS ord, CASE WHEN kept THEN 'kept' ELSE 'conflict' END AS status, address, data_name, reg_add, reg_type, grp FROM numbered
"""

#: Of each byte the checksum that eight shifts of the reflected polynomial make of it.
_CRC = """
crc_steps AS (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 40961) ELSE c // 2 END) AS v FROM range(256) t(i)
), crc AS (SELECT list(v ORDER BY i) AS steps FROM crc_steps)
"""
_FRAMES = f"""
bodies AS ({derive.HEX_BODIES}), shaped AS (
  SELECT *, printf('%02X', CAST(slave AS INT)) AS s, printf('%04X', CAST(start AS INT)) || printf('%04X', qty) AS range_hex, printf('%02X', qty * 2) AS n_hex,
    array_to_string(list_transform(range(1, qty + 1), lambda i: printf('%04X', CAST((value + i) % 65536 AS INT))), '') AS data_hex
  FROM bodies
), framed AS (
  SELECT *, CASE kind WHEN 1 THEN s || '03' || n_hex || data_hex WHEN 2 THEN s || '10' || range_hex || n_hex || data_hex WHEN 4 THEN s || '20' || range_hex || n_hex || data_hex ELSE s || '03' || range_hex END AS body
  FROM shaped
), summed AS (
  SELECT *, list_transform(range(0, length(body) // 2), lambda i: CAST('0x' || substr(body, i * 2 + 1, 2) AS INT)) AS bytes FROM framed
)
"""

#: Registers of answered requests, their definitions, and the words and bytes that a definition's type takes.
_VALUES = f"""
bodies AS ({derive.HEX_BODIES}), held AS (
  SELECT batch_id, start, qty, unnest(range(qty)) AS place, value FROM bodies WHERE kind <> 2
), defined AS (
  SELECT p_partkey AS ord, p_partkey % 65536 AS address, p_brand, p_partkey % 9 + 4 AS kind, p_partkey % 3 AS dcm,
    CASE WHEN p_partkey % 9 + 4 IN (8, 9, 12) THEN p_partkey % 4 ELSE p_partkey % 2 END AS endian,
    CASE WHEN p_partkey % 9 + 4 IN (8, 9, 12) THEN 2 WHEN p_partkey % 9 + 4 IN (10, 11) THEN 4 ELSE 1 END AS width FROM part
), joined AS (
  SELECT h.*, CASE WHEN start + place <= 65535 THEN start + place END AS addr, d.* FROM held h LEFT JOIN defined d ON d.address = start + place AND start + place <= 65535
), taken AS (
  SELECT *, CASE WHEN place + width <= qty AND addr + width - 1 <= 65535 THEN list_transform(range(width), lambda j: CAST((value + place + 1 + j) % 65536 AS BIGINT)) END AS words FROM joined
), ordered AS (
  SELECT *, array_to_string(list_transform(words, lambda w: printf('%04X', CAST(w AS INT))), '') AS raw,
    list_transform(CASE WHEN kind IN (4, 5) THEN [endian] WHEN kind IN (6, 7) THEN CASE endian WHEN 0 THEN [1, 0] ELSE [0, 1] END
        WHEN kind IN (8, 9, 12) THEN CASE endian WHEN 0 THEN [0, 1, 2, 3] WHEN 1 THEN [3, 2, 1, 0] WHEN 2 THEN [2, 3, 0, 1] ELSE [1, 0, 3, 2] END
        ELSE CASE endian WHEN 0 THEN [7, 6, 5, 4, 3, 2, 1, 0] ELSE [0, 1, 2, 3, 4, 5, 6, 7] END END,
      lambda k: CAST(CASE WHEN k % 2 = 0 THEN words[k // 2 + 1] // 256 ELSE words[k // 2 + 1] % 256 END AS HUGEINT)) AS bytes FROM taken
), summed AS (
  SELECT *, CASE WHEN words IS NOT NULL THEN list_reduce(bytes, lambda a, b: a * 256 + b) END AS whole, CASE kind WHEN 5 THEN 8 WHEN 7 THEN 16 WHEN 9 THEN 32 WHEN 11 THEN 64 END AS signed FROM ordered
), numbers AS (
  SELECT *, CASE WHEN kind = 12 THEN CASE WHEN whole // 2147483648 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN whole // 8388608 % 256 = 0 THEN CAST(whole % 8388608 AS DOUBLE) * pow(2.0::DOUBLE, -149)
      ELSE (1 + CAST(whole % 8388608 AS DOUBLE) / 8388608.0::DOUBLE) * pow(2.0::DOUBLE, CAST(whole // 8388608 % 256 AS DOUBLE) - 127) END
    WHEN signed IS NOT NULL AND whole >= CAST(pow(2.0::DOUBLE, signed - 1) AS HUGEINT) THEN CAST(whole - CAST(pow(2.0::DOUBLE, signed) AS HUGEINT) AS DOUBLE) ELSE CAST(whole AS DOUBLE) END * 0.5::DOUBLE / pow(10.0::DOUBLE, dcm) AS numeric_value FROM summed
)
"""

#: Texts without quotes, so that cells are what stands between delimiters. The first 64 rows count.
_DELIMITED = f"""
texts AS ({derive.DELIMITED_TEXTS}), candidates(delimiter, nth) AS (VALUES (',', 1), (';', 2), (chr(9), 3), ('|', 4)), lines AS (
  SELECT conv_id, turn, delimiter, nth, list_filter(regexp_split_to_array(text, '[\n\r]'), lambda x: x <> '')[1:64] AS lines, string_split(text, chr(10))[1:64] AS marked FROM texts, candidates
), widths AS (
  SELECT *, list_transform(list_filter(lines, lambda x: contains(x, delimiter) OR NOT regexp_full_match(x, '\\s*')), lambda x: CAST(len(string_split(x, delimiter)) AS BIGINT)) AS w,
    CAST(list_sum(list_prepend(0, list_transform(marked, lambda x: len(string_split(x, delimiter)) - 1))) AS BIGINT) AS outside FROM lines
), counted AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n_rows, CAST(len(list_filter(w, lambda x: x > 1)) AS BIGINT) AS n_split,
    list_reverse_sort(list_transform(list_distinct(w), lambda x: [CAST(len(list_filter(w, lambda y: y = x)) AS BIGINT), x])) AS sizes FROM widths
), stats AS (
  SELECT conv_id, turn, delimiter, nth, n_rows, n_split, coalesce(sizes[1][2], 0) AS common, coalesce(sizes[1][1], 0) AS n_common,
    CAST(coalesce(list_sum(list_transform(w, lambda x: (x - sizes[1][2]) * (x - sizes[1][2]))), 0) AS DOUBLE) / greatest(n_rows, 1) AS spread, CAST(0 AS BIGINT) AS errors, outside, CAST(0 AS BIGINT) AS quoted FROM counted
)
"""

ORACLE_SQL: dict[str, str] = {
    "delimiter_stats": f"WITH {_DELIMITED} SELECT * EXCLUDE (nth) FROM stats",
    "delimiter_choice": f"""WITH {_DELIMITED} SELECT conv_id, turn, delimiter FROM stats
        QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY common > 1 DESC, CAST(n_split AS DOUBLE) / greatest(n_rows, 1) DESC, CAST(n_common AS DOUBLE) / greatest(n_rows, 1) DESC, spread, common DESC, outside DESC, nth) = 1""",
    "detected_encodings": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'cp1252' WHEN 2 THEN 'cp850' WHEN 3 THEN 'mac_roman' WHEN 4 THEN 'utf-16-le' ELSE 'utf-16-be' END AS written,
          doc_id // 6 % 2 = 1 AS held_out, true AS right FROM documents""",
    "delimited_records": """SELECT coalesce(source, '') AS file, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id, text) - 1 AS row_ord, CAST(doc_id AS VARCHAR) AS doc_id,
          coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents""",
    "log_overview": f"""WITH {_CATEGORISED}, facts AS (
          SELECT 'lines' AS section, '' AS name, '' AS detail, file_ord, line_no, 0 AS spot, NULL AS ts FROM log_lines
          UNION ALL SELECT 'entries', '', '', file_ord, line_no, 0, ts FROM categorised
          UNION ALL SELECT 'categories', category_name, '', file_ord, line_no, 0, ts FROM categorised JOIN names USING (category)
          UNION ALL SELECT 'threads', thread, '', file_ord, line_no, 0, ts FROM categorised
          UNION ALL SELECT 'leaks', '', '', file_ord, line_no, 0, ts FROM categorised WHERE category = 'ConnectionLeak'
          UNION ALL SELECT 'rules', regexp_extract(message, 'disabled ruleId=([0-9]+)', 1), '', file_ord, line_no, 0, ts FROM categorised WHERE category = 'DispatchDisabled' AND regexp_extract(message, 'disabled ruleId=([0-9]+)', 1) <> ''
          UNION ALL SELECT 'serials', unnest(sns), category_name, file_ord, line_no, unnest(range(len(sns))), ts FROM (SELECT *, regexp_extract_all(message, '\\b(\\d{{14,}})\\b', 1) AS sns FROM categorised JOIN names USING (category))
          UNION ALL SELECT 'projects', unnest(ps), '', file_ord, line_no, unnest(range(len(ps))), ts FROM (SELECT *, list_filter(regexp_extract_all(message, '"name":"([^"]+)"', 1), lambda p: NOT regexp_full_match(p, '[0-9]*')) AS ps FROM categorised)
        ), placed AS (SELECT *, {{'f': file_ord, 'l': line_no, 'a': CAST(spot AS INT)}} AS place FROM facts
        ), grouped AS (SELECT section, name, detail, count(*) AS n, min(place) AS seen, arg_min(ts, place) AS first_ts, arg_max(ts, place) AS last_ts FROM placed GROUP BY ALL)
        SELECT section, name, CASE WHEN section = 'entries' THEN first_ts || ' - ' || last_ts ELSE detail END AS detail, n, seen.f AS first_file, seen.l AS first_line, seen.a AS first_at FROM grouped""",
    "log_entries": f"WITH {_ENTRIES} SELECT file_ord, line_no, ts, thread, class, line, message, has_stack FROM entries",
    "log_category_counts": f"WITH {_CATEGORISED} SELECT category, category_name, count(*) AS entries FROM categorised JOIN names USING (category) GROUP BY category, category_name",
    "log_file_lines": f"WITH {_ENTRIES} SELECT row_number() OVER (ORDER BY file_ord, line_no) - 1 AS nth, line FROM log_lines",
    "log_latest": f"""WITH {_ENTRIES} SELECT thread, CAST(row_number() OVER (PARTITION BY thread ORDER BY file_ord DESC, line_no DESC) AS INT) AS from_end, file_ord, line_no, message FROM entries QUALIFY from_end <= 64""",
    "log_file_names": """WITH names AS (
          SELECT 'app.' || user_id || '.log' AS name, false AS packed, user_id AS n FROM events UNION SELECT 'App.' || event_id || '.log.gz', true, event_id FROM events WHERE event_id % 2 <> 0
        ) SELECT name, CAST(row_number() OVER (ORDER BY packed, n DESC) AS INT) AS natural, CAST(row_number() OVER (ORDER BY name DESC) AS INT) AS falling FROM names""",
    "log_rule_counts": f"WITH {_CATEGORISED} SELECT category, count(*) AS entries FROM categorised GROUP BY category",
    "redacted_parts": """WITH s AS (SELECT list(p_brand ORDER BY ord) AS brands FROM (SELECT p_brand, min(p_partkey) AS ord FROM part GROUP BY p_brand))
        SELECT p_partkey, list_reduce(list_prepend(p_brand || p_name || ' ' || p_type || ' ' || p_brand || '7 x' || p_brand, brands), lambda t, b: replace(t, b, '[REDACTED]')) AS text FROM part, s""",
    "log_summary": f"""WITH {_CATEGORISED}
        SELECT count(*) AS entry_count, count(*) + count(*) FILTER (has_stack) AS total_lines, arg_min(ts, CAST(file_ord AS BIGINT) * 1000000000 + line_no) AS time_start,
               arg_max(ts, CAST(file_ord AS BIGINT) * 1000000000 + line_no) AS time_end, count(*) FILTER (category = 'ConnectionLeak') AS connection_leaks, count(DISTINCT thread) AS thread_count
        FROM categorised""",
    "log_serial_errors": f"WITH {_CATEGORISED} SELECT sn, error_type, count(*) AS occurrences FROM serials GROUP BY sn, error_type",
    "log_unique_serials": f"WITH {_CATEGORISED} SELECT DISTINCT sn FROM serials",
    "log_serial_totals": f"WITH {_CATEGORISED} SELECT sn, error_type, count(*) AS occurrences, CAST(sum(count(*)) OVER (PARTITION BY sn) AS BIGINT) AS total FROM serials GROUP BY sn, error_type",
    "log_projects": f"""WITH {_ENTRIES}, found AS (
          SELECT file_ord, line_no, unnest(regexp_extract_all(message, '"name":"([^"]+)"', 1)) AS project, generate_subscripts(regexp_extract_all(message, '"name":"([^"]+)"', 1), 1) - 1 AS place FROM entries
        ), kept AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file_ord, line_no, place) AS nth FROM found WHERE NOT regexp_full_match(project, '[0-9]*'))
        SELECT project, file_ord AS first_file, line_no AS first_line, CAST(place AS INT) AS first_at FROM kept WHERE nth = 1""",
    "log_disabled_rules": f"""WITH {_CATEGORISED}, found AS (
          SELECT file_ord, line_no, regexp_extract(message, 'disabled ruleId=([0-9]+)', 1) AS rule_id FROM categorised WHERE category = 'DispatchDisabled'
        ), kept AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY file_ord, line_no) AS nth FROM found WHERE rule_id <> '')
        SELECT rule_id, file_ord AS first_file, line_no AS first_line, CAST(0 AS INT) AS first_at FROM kept WHERE nth = 1""",
    "log_threads": f"""WITH {_ENTRIES}, kept AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY file_ord, line_no) AS nth FROM entries)
        SELECT thread, file_ord AS first_file, line_no AS first_line, CAST(0 AS INT) AS first_at FROM kept WHERE nth = 1""",
    "log_heatmap": f"WITH {_ENTRIES}{_HEATMAP}",
    "log_stuck_threads": f"""WITH {_ENTRIES}, marks AS (
          SELECT *, starts_with(message, '[DISPATCH-START]') AS starts, try_cast(nullif(regexp_extract(message, 'cost=([0-9]+)ms', 1), '') AS BIGINT) AS duration_ms FROM entries
          WHERE starts_with(message, '[DISPATCH-START]') OR starts_with(message, '[DISPATCH-END]')
        ), paired AS (SELECT *, lag(starts) OVER w AS opened, lag(ts) OVER w AS start_time FROM marks WINDOW w AS (PARTITION BY thread ORDER BY file_ord, line_no))
        SELECT thread, start_time, ts AS end_time, duration_ms FROM paired WHERE NOT starts AND opened AND duration_ms > 10000""",
    "log_samples": f"""WITH {_CATEGORISED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY file_ord, line_no) AS nth FROM categorised)
        SELECT category, CAST(nth AS INT) AS nth, file_ord, line_no, ts, thread, message FROM ranked WHERE nth <= 5""",
    "log_dispatch_costs": f"WITH {_ENTRIES} SELECT file_ord, line_no, CAST(regexp_extract(message, '\\[DISPATCH-END\\].*cost=([0-9]+)ms', 1) AS BIGINT) AS cost_ms FROM entries WHERE regexp_matches(message, '\\[DISPATCH-END\\].*cost=[0-9]+ms')",
    "register_sanitized": f"""WITH {_REGISTERS}
        SELECT doc_id, batch_ord, row_ord, CASE WHEN valid THEN 'valid' ELSE 'rejected' END AS status, repaired, CAST(c_width AS BIGINT) AS width,
          CASE WHEN valid THEN new_group ELSE c_group END AS grp, CASE WHEN valid THEN new_name ELSE c_name END AS data_name,
          CAST(CASE WHEN NOT valid THEN 1 ELSE CASE WHEN repaired THEN 1 ELSE 0 END + CASE WHEN shape IN (4, 5) THEN 1 ELSE 0 END END AS BIGINT) AS n_warnings
        FROM sanitized""",
    "register_texts": f"""WITH {_REGISTERS}
        SELECT row_ord // 50 AS doc_id, row_number() OVER (PARTITION BY row_ord // 50 ORDER BY row_ord) + 1 AS row_ord, CASE WHEN valid THEN 'valid' ELSE 'rejected' END AS status, repaired,
          CASE WHEN valid THEN new_group ELSE c_group END AS grp, CASE WHEN valid THEN new_name ELSE c_name END AS data_name FROM sanitized""",
    "circuit_names": f"""WITH named AS ({derive.CIRCUIT_NAMES})
        SELECT p_partkey, CASE WHEN form IN (0, 1, 2, 3, 4, 8) THEN CASE n WHEN '十二' THEN 12 ELSE CAST(n AS BIGINT) END END AS number,
          CASE form WHEN 0 THEN 'Ua' WHEN 1 THEN 'Ia' WHEN 2 THEN 'Ua' WHEN 3 THEN '电压' WHEN 4 THEN 'Ep' WHEN 8 THEN 'Ep' END AS attribute, form IN (5, 6, 7) AS heading, form <> 9 AS ambiguous,
          CASE kind WHEN 1 THEN endian <= 15 WHEN 2 THEN endian <= 7 WHEN 3 THEN endian <= 3 WHEN 8 THEN endian <= 3 WHEN 9 THEN endian <= 3 WHEN 12 THEN endian <= 3 WHEN 0 THEN false WHEN 13 THEN false ELSE endian <= 1 END AS legal FROM named""",
    "validated_candidates": """WITH c AS (
          SELECT l_orderkey * 8 + l_linenumber AS ord, min(l_partkey) AS register_address, min(l_suppkey) % 12 AS e, min(l_quantity) % 5 = 0 AS bare FROM lineitem GROUP BY l_orderkey, l_linenumber
        ), allowed AS (SELECT DISTINCT s_suppkey % 12 AS e FROM supplier WHERE s_suppkey % 12 < 10
        ), judged AS (
          SELECT ord, register_address, CASE WHEN register_address NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) THEN 'ai_fact_conflict'
            WHEN bare OR e NOT IN (SELECT e FROM allowed) OR 1 NOT IN (SELECT e FROM allowed) THEN 'missing_evidence' END AS fault FROM c)
        SELECT ord, register_address, coalesce(fault, CASE WHEN row_number() OVER (PARTITION BY register_address, fault IS NULL ORDER BY ord) = 1 THEN 'accepted' ELSE 'duplicate' END) AS status FROM judged""",
    "register_unmatched": f"""WITH {_FRAMES}, seen AS (SELECT DISTINCT unnest(range(start, start + qty)) AS address FROM bodies WHERE kind <> 2)
        SELECT CAST(address AS BIGINT) AS address FROM seen WHERE address <= 65535 AND (address % 3 = 0 OR address NOT IN (SELECT p_partkey % 65536 FROM part))""",
    "register_diagnostics": f"""WITH {_REGISTERS}
        SELECT doc_id, count(*) FILTER (valid) AS valid_records, count(*) FILTER (repaired) AS repaired_missing_unit, count(*) FILTER (NOT valid) AS rejected_records,
          count(*) FILTER (c_width = 12) AS width_12, count(*) FILTER (c_width = 11) AS width_11, count(*) FILTER (c_width = 5) AS width_5 FROM sanitized GROUP BY doc_id""",
    "register_merged": _MERGED,
    "register_files": f"SELECT doc_id, ord, ord AS row_ord, data_name, reg_add, reg_type, grp FROM ({_MERGED}) WHERE status = 'kept'",
    "register_addresses": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_partkey END AS address FROM part",
    "naming_catalog": """WITH once AS (SELECT p_brand AS code, substr(p_type, 1, 6) AS meaning, min(p_partkey) AS ord FROM part GROUP BY ALL)
        SELECT code, string_agg(trim(meaning), ' / ' ORDER BY ord) AS meaning, min(ord) AS ord FROM (SELECT code, trim(meaning) AS meaning, min(ord) AS ord FROM once GROUP BY ALL) GROUP BY code""",
    "page_text": r"SELECT page_id, regexp_replace(replace(regexp_replace(replace(replace(html, '<br/>', ' '), '<br>', ' '), '<[^>]*(>|$)', '', 'g'), '>', ''), '^\s+|\s+$', '', 'g') AS text FROM pages",
    "frame_checksums": f"""WITH {_FRAMES}, {_CRC}
        SELECT batch_id, CAST(list_reduce(list_prepend(CAST(65535 AS BIGINT), CAST(bytes AS BIGINT[])), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])) AS BIGINT) AS crc, CAST(list_sum(bytes) % 256 AS BIGINT) AS additive
        FROM summed, crc""",
    "frame_decoded": f"""WITH {_FRAMES}
        SELECT batch_id, 'modbusRtu' AS protocol, CAST(slave AS BIGINT) AS slave, CAST(CASE kind WHEN 2 THEN 16 WHEN 4 THEN 32 ELSE 3 END AS BIGINT) AS function_code,
          CASE WHEN kind <> 1 THEN start END AS start_address, CASE WHEN kind <> 1 THEN CAST(qty AS BIGINT) END AS quantity, CASE WHEN kind IN (1, 2, 4) THEN CAST(qty * 2 AS BIGINT) END AS byte_count,
          kind <> 3 AS crc_valid, CASE WHEN kind = 1 THEN 0 WHEN kind IN (0, 3) THEN least(qty, 65536 - start) ELSE CAST(qty AS BIGINT) END AS n_registers,
          CAST(CASE kind WHEN 0 THEN 5 WHEN 3 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 7 ELSE 3 END AS BIGINT) AS n_fields,
          CASE WHEN kind IN (2, 4) THEN data_hex ELSE '' END AS register_hex,
          concat_ws(',', CASE WHEN kind = 3 THEN 'invalid_crc' END, CASE WHEN kind = 1 THEN 'response_without_request_context' END, CASE WHEN kind IN (0, 3) AND start + qty - 1 > 65535 THEN 'register_address_overflow' END) AS warnings
        FROM summed""",
    "frame_calls": f"""WITH {_CRC}, segments AS ({derive.SEGMENTS}), summed AS (
          SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY line) - 1 AS index, CASE WHEN kind IN (0, 1, 2, 5, 6) THEN list_transform(range(0, length(body) // 2), lambda i: CAST('0x' || substr(body, i * 2 + 1, 2) AS INT)) ELSE [0] END AS bytes FROM segments
        ), checked AS (
          SELECT *, printf('%02X', CAST(list_sum(bytes) % 256 AS INT)) AS additive,
            printf('%04X', CAST(list_reduce(list_prepend(CAST(65535 AS BIGINT), CAST(bytes AS BIGINT[])), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])) AS INT)) AS crc FROM summed, crc
        )
        SELECT batch_id, index, CASE kind WHEN 3 THEN 'odd_hex_length' WHEN 4 THEN 'invalid_hex' WHEN 7 THEN 'invalid_separator' WHEN 8 THEN 'empty_segment' END AS error_code,
          CASE WHEN kind = 0 THEN 'dlt645' WHEN kind = 1 THEN 'cjt188' WHEN kind IN (2, 6) THEN 'modbusRtu' ELSE 'unknown' END AS protocol, nullif(wake, '') AS "wakeupBytes",
          CASE kind WHEN 0 THEN address WHEN 1 THEN '00' || address END AS address, CASE kind WHEN 0 THEN substr(body, 17, 2) WHEN 1 THEN substr(body, 19, 2) END AS "controlCode",
          CASE kind WHEN 0 THEN substr(body, 21) WHEN 1 THEN substr(body, 25) END AS data, nullif(serial, '') AS platform_serial,
          CAST(CASE kind WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 5 THEN 1 WHEN 6 THEN 5 ELSE 0 END AS BIGINT) AS n_fields,
          CAST(CASE WHEN kind IN (2, 6) THEN least(line, 65536 - CAST('0x' || substr(body, 5, 4) AS INT)) ELSE 0 END AS BIGINT) AS n_registers,
          CASE WHEN kind IN (0, 1) THEN 'additive8' WHEN kind IN (2, 6) THEN 'modbusCrc16' END AS checksum, CASE WHEN kind IN (0, 1) THEN additive WHEN kind IN (2, 6) THEN crc END AS received,
          CASE WHEN kind IN (0, 1, 2, 6) THEN true END AS valid,
          CASE WHEN kind = 5 THEN 'protocol_evidence_conflict' WHEN kind IN (2, 6) AND CAST('0x' || substr(body, 5, 4) AS INT) + line - 1 > 65535 THEN 'register_address_overflow' ELSE '' END AS warnings FROM checked""",
    "frame_pairs": f"""WITH {_FRAMES}
        SELECT batch_id, CASE WHEN kind <> 2 THEN start END AS first_address, CASE WHEN kind = 2 THEN 0 ELSE CAST(qty AS BIGINT) END AS n_registers,
          CASE WHEN kind = 2 THEN 'response_without_request_context,request_response_quantity_mismatch' ELSE '' END AS warnings FROM summed""",
    "register_match_diagnostics": f"""WITH {_FRAMES}, seen AS (
          SELECT DISTINCT unnest(range(start, start + qty)) AS address FROM bodies WHERE kind <> 2
        ), inside AS (SELECT address FROM seen WHERE address <= 65535)
        SELECT (SELECT count(*) FROM part) AS extracted_count, count(*) FILTER (address IN (SELECT p_partkey % 65536 FROM part)) AS matched_count,
          count(*) FILTER (address NOT IN (SELECT p_partkey % 65536 FROM part)) AS n_unmatched FROM inside""",
    "register_explained": f"""WITH {_VALUES}
        SELECT batch_id, CAST(place AS BIGINT) AS position, CAST(addr AS BIGINT) AS address, p_brand AS parameter_name,
          coalesce(CASE WHEN words IS NOT NULL THEN raw END, printf('%04X', CAST((value + place + 1) % 65536 AS INT))) AS raw_hex, numeric_value,
          CASE WHEN kind IN (4, 5) THEN CASE endian WHEN 0 THEN '高字节' ELSE '低字节' END END AS meaning,
          CASE WHEN ord IS NULL THEN 'register_not_found' ELSE 'parameter_name_not_found' END AS warnings FROM numbers""",
    "register_values": f"""WITH {_VALUES}
        SELECT batch_id, CAST(place AS INT) AS position, CAST(addr AS INT) AS address,
          CASE dcm WHEN 0 THEN printf('%.0f', numeric_value) WHEN 1 THEN printf('%.1f', numeric_value) ELSE printf('%.2f', numeric_value) END AS converted_value FROM numbers""",
    "register_interpretations": f"""WITH b AS ({derive.HEX_BODIES}), x AS (SELECT batch_id, CAST(value AS BIGINT) * 65536 + start AS u32, value // 256 AS b0, value % 256 AS b1, start // 256 AS b2, start % 256 AS b3 FROM b), y AS (
          SELECT batch_id, CAST(b0 AS BIGINT) AS u8, CAST(b0 * 256 + b1 AS BIGINT) AS u16, u32, CAST(b1 * 256 + b0 AS BIGINT) AS l16, CAST(b3 * 16777216 + b2 * 65536 + b1 * 256 + b0 AS BIGINT) AS l32 FROM x)
        SELECT batch_id, CASE WHEN u8 >= 128 THEN u8 - 256 ELSE u8 END AS big_int8, CASE WHEN u16 >= 32768 THEN u16 - 65536 ELSE u16 END AS big_int16, CASE WHEN u32 >= 2147483648 THEN u32 - 4294967296 ELSE u32 END AS big_int32,
          u8 AS big_uint8, u16 AS big_uint16, u32 AS big_uint32, CASE WHEN u8 >= 128 THEN u8 - 256 ELSE u8 END AS little_int8, CASE WHEN l16 >= 32768 THEN l16 - 65536 ELSE l16 END AS little_int16,
          CASE WHEN l32 >= 2147483648 THEN l32 - 4294967296 ELSE l32 END AS little_int32, u8 AS little_uint8, l16 AS little_uint16, l32 AS little_uint32 FROM y""",
    "chunk_contexts": "SELECT conv_id AS doc_id, turn AS index, right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 40) AS prior_context FROM conversations",
    "conversation_pairs": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS position FROM conversations)
        SELECT q.conv_id, q.position, q.text AS question, a.text AS answer FROM t q LEFT JOIN t a ON a.conv_id = q.conv_id AND a.position = q.position AND a.role = 'assistant' WHERE q.role = 'user'""",
    "redacted_events": "SELECT event_id, replace(replace(props, 'click', '[REDACTED]'), 'view', '[REDACTED]') AS props FROM events",
}

#: The report is made of what other queries state.
_PLACE = "CAST(file_ord AS BIGINT) * 1000000000 + line_no"
_SECTIONS = {
    "overview": f"""SELECT unnest([1, 2, 3, 4]) AS nth, unnest(['- 时间范围: ' || time_start || ' ~ ' || time_end, '- 总行数: ' || total_lines || ', 条目: ' || entry_count || ', 线程数: ' || thread_count,
        '- 涉及设备 SN: ' || (SELECT count(*) FROM ({ORACLE_SQL["log_unique_serials"]})) || ' 个', '- 连接泄漏次数: ' || connection_leaks]) AS line FROM ({ORACLE_SQL["log_summary"]})""",
    "categories": f"SELECT row_number() OVER (ORDER BY entries DESC, category_name) AS nth, '- ' || category_name || ': ' || entries || ' 条' AS line FROM ({ORACLE_SQL['log_category_counts']}) QUALIFY nth <= 15",
    "stuck": f"SELECT row_number() OVER (ORDER BY duration_ms DESC, end_time, thread) AS nth, '- `' || thread || '`: ' || duration_ms || 'ms' AS line FROM ({ORACLE_SQL['log_stuck_threads']}) QUALIFY nth <= 10",
    "heatmap": f"SELECT run AS nth, '- ' || hour || ': ' || entries || ' 条' AS line FROM ({ORACLE_SQL['log_heatmap']}) WHERE run <= 20",
    "serials": f"SELECT row_number() OVER (ORDER BY sn) AS nth, '- `' || sn || '`' AS line FROM ({ORACLE_SQL['log_unique_serials']}) QUALIFY nth <= 20",
    "rules": f"SELECT row_number() OVER (ORDER BY first_file, first_line) AS nth, '- ' || rule_id AS line FROM ({ORACLE_SQL['log_disabled_rules']})",
}
_SAMPLES = f"""SELECT 'samples: ' || category_name AS section, nth, '- `' || ts || '` [' || thread || '] ' || message AS line
    FROM ({ORACLE_SQL["log_samples"]}) JOIN (SELECT DISTINCT category, category_name FROM ({ORACLE_SQL["log_category_counts"]})) USING (category) WHERE nth <= 3"""
ORACLE_SQL["log_report"] = " UNION ALL ".join([*(f"SELECT '{name}' AS section, CAST(nth AS INT) AS nth, line FROM ({sql})" for name, sql in _SECTIONS.items()), _SAMPLES])
