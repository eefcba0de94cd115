"""Column expressions over server log lines and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The line layout, and what messages carry. Character classes are Unicode-aware and only \n ends a line.
LINE = r"(?dU)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) \[(\w+)\]\[([^\]]+)\]\[([^:]+):(\d+)\] (.*)\z"
SERIAL = r"(?U)\b(\d{14,})\b"
COST = r"(?dU)\[DISPATCH-END\].*cost=(\d+)ms"
RULE = r"(?U)disabled ruleId=(\d+)"
LEAKED = r"(?U)Clear leak clients end: (\d+)"
PROJECT = r'"name":"([^"]+)"'

#: Category codes and their display names, in order of precedence.
CATEGORY_NAMES = {
    "HttpRequest": "HTTP API请求",
    "DeviceNotRegistered": "设备未注册",
    "DispatchLifecycle": "Dispatch调度生命周期",
    "DispatchDisabled": "Dispatch策略禁用",
    "ProtocolTransformError": "协议转换错误",
    "MqttAuthError": "MQTT认证错误",
    "DeviceRegisterError": "设备注册参数缺失",
    "TokenAuthError": "Token认证失败",
    "ModbusTcpError": "Modbus TCP错误",
    "ConnectionLeak": "连接泄漏",
    "ByteBufError": "ByteBuf越界",
    "SafeElectricError": "电气设备数据异常",
    "EnergyProcessError": "Energy处理失败",
    "AttachmentError": "附件/Token错误",
    "Other": "其他",
}


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))  # few texts have any, and the pattern tries every place of them
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")).otherwise(text)


def unsigned(digits: Column, most: int) -> Column:
    """ASCII digits as a number up to ``most``, else null."""
    number = F.when(digits.rlike(r"^\+?[0-9]+$"), digits.try_cast("decimal(38,0)"))
    return F.when(number <= F.lit(str(most)).cast("decimal(38,0)"), number)


def is_stack(line: Column) -> Column:
    """Stack trace lines are those that begin with a tab."""
    return line.startswith("\t")


def leaked(message: Column) -> Column:
    """Number of leaked clients as a 32-bit integer; 0 if it is too large."""
    return F.coalesce(unsigned(F.regexp_extract(message, LEAKED, 1), 2**31 - 1), F.lit(0))


def _any(column: Column, *needles: str) -> Column:
    found = column.contains(needles[0])
    for n in needles[1:]:
        found = found | column.contains(n)
    return found


#: Marks of categories in order of precedence, as (category, where, texts). A leak counts only if something leaked, and ends the search.
RULES = (
    ("HttpRequest", "class", ("RequestRouterAspect",)),
    ("DeviceNotRegistered", "message", ("device not register",)),
    ("DispatchLifecycle", "message", ("[DISPATCH-START]", "[DISPATCH-END]", "[DISPATCH-COST]")),
    ("DispatchDisabled", "message", ("DispatchStrategyCount fail", "disable window", "disabled ruleId=")),
    ("ProtocolTransformError", "class", ("ComposeHandler",)),
    ("ProtocolTransformError", "message", ("未包含协议网关转换规则",)),
    ("MqttAuthError", "class", ("MqttAuthService",)),
    ("MqttAuthError", "message", ("URISyntaxException",)),
    ("DeviceRegisterError", "message", ("参数缺失",)),
    ("TokenAuthError", "message", ("登录信息错误",)),
    ("ModbusTcpError", "message", ("CommonService.getData error",)),
    ("ConnectionLeak", "message", ("Clear leak clients end:",)),
    ("ByteBufError", "class", ("AlgorithmHandler",)),
    ("SafeElectricError", "class", ("SafeElectricServiceImpl",)),
    ("EnergyProcessError", "class", ("EnergyStatusCacheImpl", "FrEnergyServiceImpl")),
    ("AttachmentError", "class", ("AttachmentServiceImpl",)),
    ("AttachmentError", "message", ("TokenFilter Exception",)),
)


def category(cls: Column, message: Column) -> Column:
    """The first category whose marks the class or message has."""
    out = F.when(F.lit(False), "Other")
    for name, where, texts in RULES:
        mark = _any(cls if where == "class" else message, *texts)
        out = out.when(mark, F.when(leaked(message) > 0, name).otherwise("Other") if name == "ConnectionLeak" else F.lit(name))
    return out.otherwise("Other")


def category_name(code: Column) -> Column:
    """Display name of a category code."""
    pairs = [F.lit(x) for pair in CATEGORY_NAMES.items() for x in pair]
    return F.element_at(F.create_map(*pairs), code)


def serials(message: Column) -> Column:
    """Every run of 14 or more digits that stands alone, in order."""
    return F.regexp_extract_all(message, F.lit(SERIAL), F.lit(1))


def dispatch_cost(message: Column) -> Column:
    """Milliseconds of the last cost after the dispatch end mark, null if there is none or beyond 64 bits."""
    return unsigned(F.regexp_extract(message, COST, 1), 2**64 - 1).cast("decimal(20,0)")


def disabled_rule(message: Column) -> Column:
    """Rule id of a disabled rule, null if there is none."""
    found = F.regexp_extract(message, RULE, 1)
    return F.when(found != "", found)


def projects(message: Column) -> Column:
    """Project names in a message that are not all digits, in order."""
    return F.filter(F.regexp_extract_all(message, F.lit(PROJECT), F.lit(1)), lambda n: ~n.rlike("^[0-9]*$"))


def bucket(ts: Column, minutes: int) -> Column:
    """Start of the ``minutes`` bucket within the hour, null for a shorter timestamp."""
    minute = F.coalesce(F.substring(ts, 15, 2).try_cast("int"), F.lit(0))
    hour = F.coalesce(F.substring(ts, 12, 2).try_cast("int"), F.lit(0))
    start = (F.floor(minute / minutes) * minutes).cast("string")
    text = F.concat(F.substring(ts, 1, 10), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(start, 2, "0"))
    return F.when(F.length(ts) >= 16, text)
