"""Slots of a message (EXP-12): device, component, error code, symptom, metric, and what it asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blanks import squeeze, strip

#: What fills a slot; the first place in the text counts. Names of one's own devices come as an argument.
DEVICE = "ECR|Q30|FIT|NSB|SBC|DNQ|PLC|CNC|测序仪|清洗机|洗衣机|洗碗机|烘干机|干衣机|笔记本|电脑|电视|耳机|设备|仪器"
COMPONENT = "清洗泵|注射泵|泵|阀|管路|相机|温控|电源|电机|传感器|芯片|试剂|barcode|激光|主板|屏幕|电池|压缩机|排水泵"
SYMPTOM = "报警|报错|异常|失败|超时|堵塞|漏液|漏水|不启动|无法启动|不工作|卡顿|噪音|压力|温度|信号|断开|连接不上|脱水|不排水|不加热"
ERROR_CODE = r"[A-Z]{1,6}[-_]?\d{2,}|E\d{2,}|ERR[-_]?[A-Z0-9]+"
METRIC = "Q30|ECR|FIT|NSB|SBC|DNQ"
#: What a message asks for, by the first rule that holds.
FOCUS = [
    ("solution", "解决方案|解决办法|处理方法|怎么解决|怎么处理|怎么办|修复|恢复"),
    ("reason", "原因|为什么|根因|成因"),
    ("troubleshooting", "排查|检查步骤|操作步骤|步骤|怎么查|定位"),
    ("summary", "总结|复盘|概括|简述"),
    ("image", "图片|图|照片|示意|截图"),
    ("parameter", "参数|阈值|范围|指标|多少"),
]
_AFTER, _BEFORE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def word(pattern: str) -> str:
    """The pattern where no letter, digit or underscore of any script is next to it."""
    return f"{_AFTER}(?:{pattern}){_BEFORE}"


def _first(text: Column, pattern: str) -> Column:
    return strip(F.regexp_extract(text, "(?iu)" + pattern, 0))


def slots(column: Column | str, devices: list[str] = ()) -> dict[str, Column]:
    """Device, component, error code (capitals) and symptom; empty where there is none. ``devices`` are patterns."""
    text = strip(column)
    return {
        "device": _first(text, "|".join([*devices, DEVICE])),
        "component": _first(text, COMPONENT),
        "error_code": F.upper(_first(text, word(ERROR_CODE))),
        "symptom": _first(text, SYMPTOM),
    }


def focus(column: Column | str) -> Column:
    """What is asked for, or the empty text."""
    text = squeeze(column)
    out = F.when(text.rlike(FOCUS[0][1]), FOCUS[0][0])
    for name, pattern in FOCUS[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("")


def extract_slots(column: Column | str, *, devices: list[str] = (), metrics: list[str] = ()) -> Column:
    """EXP-12: all slots, the metric (capitals) and the focus of a message; null is an empty message."""
    found = slots(column, devices) | {"metric": F.upper(_first(strip(column), word("|".join([METRIC, *metrics])))), "focus": focus(column)}
    return F.struct(*[c.alias(name) for name, c in found.items()])
