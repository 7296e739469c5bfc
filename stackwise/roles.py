"""Column roles and category dictionaries of the wide well table (41 columns).

Everything below the FIXED VALUES marker must equal the original data definition for
encoded outputs to be right: column names in file order, the category values in code
order (slot i of a one-hot vector is the i-th value), the diagnosis phrases with the bits
they set, and the per-column fill used for a missing category.
"""

from __future__ import annotations

# ----------------------------------------------------------------------------- FIXED VALUES

# All 41 columns in file order.
COLUMNS = [
    "井号", "渗透性类型", "岩性", "井型", "造斜点深度(m)", "生产时间(h)", "日产液(t)", "日产油(t)",
    "日产水(t)", "日产气(m3)", "含水率(%)", "油压(Mpa)", "套压(Mpa)", "动液面(m)", "泵径(mm)",
    "泵深(m)", "冲程(m)", "冲次(n/min)", "泵效(%)", "抽油机机型", "额定载荷(kN)", "悬点载荷最大值(kN)",
    "悬点载荷最小值(kN)", "电机型号", "电机额定功率(kW)", "平衡度", "日耗电量(kW·h)", "输入功率(kW)",
    "地面效率(%)", "井下效率(%)", "系统效率(%)", "泵况分析结果", "沉没度(m)", "抽油机负载率(%)",
    "电机功率利用率(%)", "百米吨液耗电(kW.h)", "K1", "K2", "节能限定值", "节能评价值", "对标结果",
]

# Text columns: the id and the seven categories.
TEXT_COLUMNS = ["井号", "渗透性类型", "岩性", "井型", "抽油机机型", "电机型号", "泵况分析结果", "对标结果"]

# One-hot dictionaries, values in slot order.
ONE_HOT = {
    "渗透性类型": ["特低渗透", "中渗透", "低渗透", "高渗透"],
    "岩性": ["灰岩", "砂岩"],
    "井型": ["直井", "定向井", "水平井"],
    "抽油机机型": [
        "YCYJ12-5-48HB", "CYJS12-5-73HB", "CYJ14-4.8-73HB", "YCYJ12-5-73HB", "CYJY14-4.8-73HB",
        "CYJ8-3-48B", "CYJ10-3-48HB", "CYJW12-4.8-73HF", "CYJ12-4.8-73HB", "YCYS12-5-73HB",
        "CYJY12-4.8-73HB", "YCYJ10-5-48HB", "CYJ10-3-37HB", "YCYJ14-5-53HB", "CYJ8-3-48HB",
        "CYJ12-4.2-73HB", "CYJ10-4.2-53HB", "CYJ10-3-53HB", "CYJ10-3-37B", "YCYJ14-5-73HB",
        "CYJY12-5.5-73HB", "CYJ14-4.8-53HB", "CYJP14-4.8-53HB", "YCYJ16-6-73HB", "WCYJW14-7-3Z",
        "CYJS12-5-53HB", "CYJY14-5.5-73HB", "CYJ14-5.5-73HB", "CYJP12-4.8-53HB", "CYJW14-4.8-73HF",
        "YCYJ10-5-37HB", "YCYJ14-7-73HB", "CYJ12-5-73HB", "YCYJ14-6-73HB", "CYJD12-5-73HB",
    ],
    "电机型号": [
        "CYQT250M-8", "YCCH280-8", "YCY280M-8", "YCCH250-8", "YQK280S-8", "YCH250-8", "Y280S-8",
        "YCCH250-6", "YCY280M2-8", "YCCH280-6", "YCY250M-8", "YCY280S-6", "Y280M-8", "无电机数据",
        "YCH280-8", "YCY280S-8", "CYQT250M2-8", "YCYH250M-8", "YCY250S-8", "YCH280-12", "Y250M-8",
        "CY280M-8", "YCYJ280M-8B", "SFBJ-CXT-280M-8", "YCY280M-6", "YCCH280S-8", "BLM-0T45D60VI",
        "YCHD280-8", "YCYJ280M2-8B", "YCYT315-8", "CYQT250M2-12",
    ],
    "对标结果": ["优良", "不达标", "达标"],
}

# Diagnosis (12 bits): 0 normal, 1 low liquid supply, 2 pump leak, 3 upper pump hit,
# 4 lower pump hit, 5 tubing leak, 6 valve leak, 7 pumping while flowing, 8 heavy oil,
# 9 gas, 10 rod broken, 11 gas lock or liquid hammer. Phrase -> bits set.
DIAGNOSIS_WIDTH = 12
DIAGNOSIS_PHRASES = {
    "工作正常": [0],
    "供液不足": [1],
    "不知": [],
    "泵漏失": [2],
    "稠油影响": [8],
    "气体影响": [9],
    "油管漏失": [5],
    "抽油杆断": [10],
    "游动凡尔漏失": [6],
    "泵下碰": [4],
    "泵工作基本正常": [0],
    "游动凡尔漏失泵下碰": [4, 6],
    "固定凡尔漏失游动凡尔漏失": [6],
    "供液不足游动凡尔漏失": [1, 6],
    "连抽带喷": [7],
    "固定凡尔漏失": [6],
    "游动凡尔漏失泵上挂": [3, 6],
    "固定凡尔漏失泵下碰": [4, 6],
    "正常": [0],
    "供液不足泵下碰": [1, 4],
    "凡尔失灵或杆在泵口断脱": [10],
    "定凡尔漏失游动凡尔漏失": [6],
    "气体影响游动凡尔漏失": [6, 9],
    "功液不足游动凡尔漏失": [1, 6],
    "供液不足游动凡儿漏失": [1, 6],
    "气锁或严重液击": [11],
    "气体影响固定凡尔漏失": [6, 9],
    "供液不足固定凡尔漏失": [1, 6],
    "固定凡尔漏失泵上挂": [3, 6],
    "气体影响泵下碰": [4, 9],
    "抽油杆断脱": [10],
}
# "抽油杆断脱,位置距井口m:<depth>" (rod broken at a depth) sets bit 10 for any depth.
DIAGNOSIS_DEPTH_SUFFIX = r",位置距井口m:[0-9.]+$"

# Fill for a missing category: value per slot.
MISSING_FILL = {
    "渗透性类型": 0.5, "岩性": 0.5, "井型": 0.5, "抽油机机型": 0.0, "电机型号": 0.0,
    "泵况分析结果": 0.5, "对标结果": 0.5,
}

# The example run: target and the 14 features.
EXAMPLE_TARGET = "对标结果"
EXAMPLE_FEATURES = [
    "日产液(t)", "日产油(t)", "日产水(t)", "含水率(%)", "动液面(m)", "冲次(n/min)", "泵效(%)", "平衡度",
    "日耗电量(kW·h)", "地面效率(%)", "井下效率(%)", "系统效率(%)", "沉没度(m)", "抽油机负载率(%)",
]

# ------------------------------------------------------------------------- end FIXED VALUES

NUMERIC_COLUMNS = [c for c in COLUMNS if c not in TEXT_COLUMNS]


def role_spec() -> dict:
    """name -> role ('id', 'category', 'multi_hot', 'numeric')."""
    spec = {}
    for c in COLUMNS:
        if c == "井号":
            spec[c] = "id"
        elif c == "泵况分析结果":
            spec[c] = "multi_hot"
        elif c in TEXT_COLUMNS:
            spec[c] = "category"
        else:
            spec[c] = "numeric"
    return spec
