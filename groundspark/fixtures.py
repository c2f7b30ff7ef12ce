"""The reference plant as data: a bottling site with two lines and utilities.

Fixed values: assets, signals, flows, interlocks, recipes, events, units, quantity kinds and the unit
state machine. Line 1 is metric; rows of line 2 that differ are listed beside those of line 1.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: asset_id | name | kind | manufacturer | model | serial | class | parent | level | packml | state | services | location | commissioned | criticality
ASSETS = """
ENT|Global Beverages AG|Enterprise|-|-|-|27-01-01-01||Enterprise||||DE||medium
SITE-KA|Karlsruhe Bottling Plant|Site|-|-|-|27-01-01-02|ENT|Site||||Karlsruhe, DE||medium
AREA-FILL|Filling Hall|Area|-|-|-|27-01-01-03|SITE-KA|Area||||Building 3||medium
AREA-UTIL|Utilities|Area|-|-|-|27-01-01-04|SITE-KA|Area||||Building 1||medium
L1|Bottling Line 1|ProductionLine|-|-|-|27-02-24-01|AREA-FILL|WorkCenter||||Filling Hall / Bay A||high
L1-PAS|Line 1 Tunnel Pasteuriser|Pasteuriser|KHS GmbH|Innopas SX|PAS-2019-4471|36-05-01-01|L1|WorkUnit|1|Execute|Heat,Hold,Cool||2019-04-11|high
L1-FIL|Line 1 Rotary Filler|Filler|Krones AG|Modulfill VFS-C 72/12|FIL-2021-8823|36-05-02-01|L1|WorkUnit|1|Execute|Fill,Flush,CIP||2021-07-02|high
L1-CAP|Line 1 Capper|Capper|Krones AG|Modulcap 12|CAP-2021-8824|36-05-02-04|L1|WorkUnit|1|Execute|||2021-07-02|medium
L1-LAB|Line 1 Labeller|Labeller|Krones AG|Contiroll HS|LAB-2021-8825|36-05-02-06|L1|WorkUnit|1|Held|||2021-07-02|medium
L1-CIP|Line 1 CIP Skid|CIPSkid|GEA Group|ECOclean 3000|CIP-2020-1190|36-05-08-02|L1|WorkUnit|1|Idle|PreRinse,Caustic,Rinse,Acid||2020-02-20|medium
L2|Bottling Line 2|ProductionLine|-|-|-|27-02-24-01|AREA-FILL|WorkCenter||||Filling Hall / Bay B||medium
L2-PAS|Line 2 Tunnel Pasteuriser|Pasteuriser|Sidel|Gebo Pasteuriser|PAS-2016-2210|36-05-01-01|L2|WorkUnit|1|Idle|Heat,Hold,Cool||2016-09-30|high
L2-FIL|Line 2 Rotary Filler|Filler|Sidel|EvoFILL Glass|FIL-2016-2211|36-05-02-01|L2|WorkUnit|1|Stopped|Fill,Flush,CIP||2016-09-30|high
L2-CAP|Line 2 Crowner|Capper|Sidel|EvoCAP|CAP-2016-2212|36-05-02-04|L2|WorkUnit|1|Stopped|||2016-09-30|medium
L2-LAB|Line 2 Labeller|Labeller|Sidel|Evolabel|LAB-2016-2213|36-05-02-06|L2|WorkUnit|1|Aborted|||2016-09-30|medium
UT-CMP|Compressed Air Compressor 1|Compressor|Atlas Copco|ZR 160 VSD+|CMP-2018-0091|36-01-03-01|AREA-UTIL|WorkUnit|||||2018-05-14|high
UT-CHL|Chiller 1|Chiller|Johnson Controls|YMC2 Magnetic Bearing|CHL-2017-0442|36-01-05-02|AREA-UTIL|WorkUnit|||||2017-03-08|high
"""

#: unit | loop | suffix | description | unit of measure | quantity kind | low | high | access | role | alarm low | alarm high | safety | value
SIGNALS = """
PAS|TT0101|PV|Zone 1 temperature|DEG_C|Temperature|0|100|r|measurement|60|||72
PAS|TIC0101|SP|Zone 1 temperature setpoint|DEG_C|Temperature|20|95|rw|setpoint|||1|72
PAS|PT0102|PV|Outlet pressure|BAR|Pressure|0|10|r|measurement||8||3.1
PAS|PU0103|PV|Accumulated pasteurisation units|UNITLESS|Count|0|60|r|kpi|15|||22.4
FIL|PT0301|PV|Outlet pressure|BAR|Pressure|0|6|r|measurement||4.9799999999999995||3
FIL|PIC0301|SP|Fill pressure setpoint|BAR|Pressure|0.5|4.5|rw|setpoint||||2.52
FIL|TT0302|PV|Product temperature|DEG_C|Temperature|-5|40|r|measurement||8||4
FIL|FT0303|PV|Product flow|L-PER-MIN|VolumeFlowRate|0|400|r|measurement||||180
FIL|LIC0304|SP|Bowl level setpoint|PERCENT|DimensionlessRatio|10|90|rw|setpoint||||62
FIL|LT0304|PV|Bowl level|PERCENT|DimensionlessRatio|0|100|r|measurement|15|92||61.4
FIL|QIC0305|SP|Fill volume setpoint|MilliL|Volume|200|2000|rw|setpoint||||500
FIL|SIC0306|SP|Carousel speed setpoint|REV-PER-MIN|AngularVelocity|5|45|rw|setpoint||||32
FIL|ST0306|PV|Carousel speed|REV-PER-MIN|AngularVelocity|0|50|r|measurement||||31.8
FIL|XV0307|CMD|Product valve command|UNITLESS|Dimensionless|0|1|rw|command|||1|
FIL|KPI0308|OEE|Overall equipment effectiveness|PERCENT|DimensionlessRatio|0|100|r|kpi||||78.5
CAP|TQ0401|PV|Capping torque|N-M|Torque|0|4|r|measurement|1.4|2.8||2.05
CAP|TQC0401|SP|Capping torque setpoint|N-M|Torque|0.8|3.2|rw|setpoint||||2.1
CAP|ST0402|PV|Head speed|REV-PER-MIN|AngularVelocity|0|60|r|measurement||||32
LAB|ST0501|PV|Carousel speed|REV-PER-MIN|AngularVelocity|0|55|r|measurement||||31.5
LAB|ZT0502|PV|Label position deviation|MilliM|Length|-5|5|r|measurement|-1.5|1.5||0.4
LAB|CNT0503|PV|Reject count|NUM|Count|0|1000000|r|kpi||||142
CIP|TT0601|PV|Return temperature|DEG_C|Temperature|0|100|r|measurement|68|||79
CIP|FT0602|PV|Return flow|L-PER-MIN|VolumeFlowRate|0|600|r|measurement|250|||410
CIP|AT0603|PV|Caustic concentration|PERCENT|DimensionlessRatio|0|5|r|measurement|1.8|2.6||2.1
CIP|AT0604|PV|Return pH|PH|Acidity|0|14|r|measurement||||12.4
CMP|PT0801|PV|Outlet pressure|BAR|Pressure|0|12|r|measurement|6|10.5||7.8
CMP|PIC0801|SP|Discharge pressure setpoint|BAR|Pressure|5|10|rw|setpoint||||7.5
CMP|TT0802|PV|Discharge temperature|DEG_C|Temperature|0|140|r|measurement||105||88
CMP|JT0803|PV|Active power|KiloW|Power|0|160|r|measurement||||112
CMP|VT0804|PV|Bearing vibration|MilliM|Length|0|20|r|measurement||7.1||3.2
CHL|TT0901|PV|Chilled water supply temperature|DEG_C|Temperature|-10|30|r|measurement||8||4.2
CHL|TIC0901|SP|Chilled water supply setpoint|DEG_C|Temperature|0|12|rw|setpoint||||4
CHL|FT0902|PV|Chilled water flow|M3-PER-HR|VolumeFlowRate|0|120|r|measurement||||84
CHL|JT0903|PV|Active power|KiloW|Power|0|400|r|measurement||||241
"""
SIGNALS_LINE_2 = """
PAS|TT0101|PV|Zone 1 temperature|DEG_F|Temperature|0|212|r|measurement|140|||161.6
PAS|TIC0101|SP|Zone 1 temperature setpoint|DEG_F|Temperature|68|203|rw|setpoint|||1|161.6
PAS|PT0102|PV|Outlet pressure|PSI|Pressure|0|145|r|measurement||116||44.95
PAS|PU0103|PV|Accumulated pasteurisation units|UNITLESS|Count|0|60|r|kpi|15|||8.5
FIL|PT0301|PV|Outlet pressure|PSI|Pressure|0|87|r|measurement||72.21||43.5
FIL|PIC0301|SP|Fill pressure setpoint|PSI|Pressure|0.5|65.25|rw|setpoint||||36.54
FIL|TT0302|PV|Product temperature|DEG_F|Temperature|23|104|r|measurement||46.4||39.2
FIL|FT0303|PV|Product flow|M3-PER-HR|VolumeFlowRate|0|24|r|measurement||||10.8
CAP|TQ0401|PV|Capping torque|N-M|Torque|0|5|r|measurement|1.4|2.8||2.05
"""
#: on every unit with a state machine
SIGNALS_OF_UNITS = """
|UNIT|STATE|PackML unit current state|UNITLESS|Count|0|17|r|state||||
|UNIT|CMD|PackML unit command|UNITLESS|Count|0|9|rw|command|||1|
"""

FEEDS = """
L1-PAS|L1-FIL
L1-FIL|L1-CAP
L1-CAP|L1-LAB
L2-PAS|L2-FIL
L2-FIL|L2-CAP
L2-CAP|L2-LAB
UT-CMP|L1-FIL
UT-CMP|L2-FIL
UT-CMP|L1-CAP
UT-CHL|L1-FIL
UT-CHL|L2-FIL
UT-CHL|L1-PAS
L1-CIP|L1-FIL
L1-CIP|L1-PAS
"""

#: id | tag | guard tag | operator | numeric threshold | states | text
INTERLOCKS = """
ILK-01|L1_FIL_XV0307_CMD|L1_PAS_PU0103_PV|>=|15||Product valve may only open when accumulated pasteurisation units >= 15 PU.
ILK-02|L1_FIL_QIC0305_SP|L1_FIL_UNIT_STATE|state_in||Idle,Held,Stopped|Fill volume setpoint may only be changed while the filler is Idle, Held or Stopped.
ILK-03|L1_PAS_TIC0101_SP|L1_CIP_UNIT_STATE|state_not_in||Execute|Pasteuriser temperature setpoint is locked while a CIP cycle is executing.
ILK-04|L2_FIL_XV0307_CMD|L2_PAS_PU0103_PV|>=|15||Product valve may only open when accumulated pasteurisation units >= 15 PU.
"""

#: id | name | line | fill volume ml | fill pressure bar | product temperature degC | cap torque Nm | rate bottles/h
RECIPES = """
P-COLA-500|Cola 0.5 L PET|L1|500|2.5|4|2.1|36000
P-LEMON-1000|Lemonade 1.0 L Glass|L2|1000|2.2|6|2.4|18000
"""

EVENTS = """
EV-1001|L1-FIL|2026-07-14T02:15:00Z|Alarm|Bowl level low-low, filler held|high
EV-1002|UT-CMP|2026-07-14T02:11:30Z|Alarm|Discharge pressure below low limit|high
EV-1003|UT-CMP|2026-06-30T09:00:00Z|Maintenance|Air-end bearing replaced, vibration baseline reset|info
EV-1004|L1-CAP|2026-07-14T02:16:10Z|Alarm|Capping torque out of range on head 7|medium
EV-1005|L2-LAB|2026-07-02T18:40:00Z|Alarm|Emergency stop pressed, unit aborted|high
EV-1006|L1-PAS|2026-07-14T02:09:45Z|Alarm|Zone 1 temperature below limit|medium
"""

#: unit | symbol | quantity kind | multiplier | offset | aliases (SI value = value * multiplier + offset)
UNITS = """
PA|Pa|Pressure|1|0|pascal;pascals
KiloPA|kPa|Pressure|1e3|0|kilopascal
MegaPA|MPa|Pressure|1e6|0|megapascal
BAR|bar|Pressure|1e5|0|bars
MilliBAR|mbar|Pressure|1e2|0|millibar
PSI|psi|Pressure|6894.757293168|0|lbf/in2;pounds per square inch
K|K|Temperature|1|0|kelvin
DEG_C|degC|Temperature|1|273.15|c;celsius;°c;deg c
DEG_F|degF|Temperature|5/9|255.372222222|f;fahrenheit;°f
M3|m3|Volume|1|0|m^3;cubic metre;cubic meter
L|L|Volume|1e-3|0|l;litre;liter;litres;liters
MilliL|mL|Volume|1e-6|0|ml;millilitre;milliliter;cl?
CentiM3|cm3|Volume|1e-6|0|cc
M3-PER-HR|m3/h|VolumeFlowRate|1/3600|0|m3/hr;cubic metre per hour
L-PER-MIN|L/min|VolumeFlowRate|1e-3/60|0|lpm;l/min;litres per minute
L-PER-SEC|L/s|VolumeFlowRate|1e-3|0|lps;l/s
KiloGM-PER-HR|kg/h|MassFlowRate|1/3600|0|kg/hr
REV-PER-MIN|rpm|AngularVelocity|1/60|0|r/min;revolutions per minute
HZ|Hz|Frequency|1|0|hertz
KiloW|kW|Power|1e3|0|kilowatt
W|W|Power|1|0|watt
N-M|N.m|Torque|1|0|nm;n*m;newton metre
V|V|Voltage|1|0|volt
A|A|ElectricCurrent|1|0|amp;ampere
KiloGM|kg|Mass|1|0|kilogram
GM|g|Mass|1e-3|0|gram
MilliM|mm|Length|1e-3|0|millimetre;millimeter
M|m|Length|1|0|metre;meter
SEC|s|Time|1|0|sec;second
MIN|min|Time|60|0|minute
HR|h|Time|3600|0|hr;hour
PERCENT|%|DimensionlessRatio|0.01|0|percent;pct
UNITLESS|1|Dimensionless|1|0|none;unitless;-
PH|pH|Acidity|1|0|ph
NUM|#|Count|1|0|count;pcs;bottles
"""

#: quantity kind | exponents of L, M, T, I, Theta, N, J
KINDS = """
Pressure|-1 1 -2 0 0 0 0
Temperature|0 0 0 0 1 0 0
Volume|3 0 0 0 0 0 0
VolumeFlowRate|3 0 -1 0 0 0 0
MassFlowRate|0 1 -1 0 0 0 0
Mass|0 1 0 0 0 0 0
Length|1 0 0 0 0 0 0
Time|0 0 1 0 0 0 0
AngularVelocity|0 0 -1 0 0 0 0
Frequency|0 0 -1 0 0 0 0
Power|2 1 -3 0 0 0 0
Energy|2 1 -2 0 0 0 0
Torque|2 1 -2 0 0 0 0
Voltage|2 1 -3 -1 0 0 0
ElectricCurrent|0 0 0 1 0 0 0
Dimensionless|0 0 0 0 0 0 0
DimensionlessRatio|0 0 0 0 0 0 0
Force|1 1 -2 0 0 0 0
Density|-3 1 0 0 0 0 0
Acidity|0 0 0 0 0 0 0
Count|0 0 0 0 0 0 0
"""

#: what commands do, and what states become on their own
COMMANDS = ["Reset", "Start", "Stop", "Hold", "Unhold", "Suspend", "Unsuspend", "Abort", "Clear"]
#: state, command, next state
TRANSITIONS = [
    ("Aborted", "Clear", "Clearing"),
    ("Stopped", "Reset", "Resetting"),
    ("Complete", "Reset", "Resetting"),
    ("Idle", "Start", "Starting"),
    ("Execute", "Hold", "Holding"),
    ("Held", "Unhold", "Unholding"),
    ("Execute", "Suspend", "Suspending"),
    ("Suspended", "Unsuspend", "Unsuspending"),
]
#: state, the state it becomes on its own
SETTLES = [
    ("Clearing", "Stopped"),
    ("Resetting", "Idle"),
    ("Starting", "Execute"),
    ("Holding", "Held"),
    ("Unholding", "Execute"),
    ("Suspending", "Suspended"),
    ("Unsuspending", "Execute"),
    ("Stopping", "Stopped"),
    ("Aborting", "Aborted"),
    ("Completing", "Complete"),
]
#: command of any state -> next state, states that do not accept it
ANYWHERE = {
    "Stop": ("Stopping", ["Stopped", "Stopping", "Aborted", "Aborting", "Clearing"]),
    "Abort": ("Aborting", ["Aborted", "Aborting"]),
}


def _lines(text: str) -> list[list[str]]:
    return [line.split("|") for line in text.strip("\n").split("\n")]


def _number(text: str) -> float | None:
    top, _, bottom = text.strip().partition("/")
    return (float(top) / float(bottom) if bottom else float(top)) if top else None


def states() -> list[str]:
    named = {x for state, _, to in TRANSITIONS for x in (state, to)} | {x for pair in SETTLES for x in pair}
    return sorted(named)


def _signals() -> list[tuple]:
    rows = []
    machines = {a[0] for a in _lines(ASSETS) if a[9].strip()}
    second = {tuple(r[:3]): r for r in _lines(SIGNALS_LINE_2)}
    for asset in (a[0] for a in _lines(ASSETS)):
        line, _, unit = asset.partition("-")
        own = [second.get(tuple(r[:3]), r) if line == "L2" else r for r in _lines(SIGNALS) if r[0] == unit]
        own += _lines(SIGNALS_OF_UNITS) if asset in machines else []
        for _, loop, suffix, text, uom, kind, low, high, access, role, alarm_low, alarm_high, safety, value in own:
            tag = f"{line}_{unit}_{loop}_{suffix}"
            rows.append((tag, asset, len(rows), text, uom, kind, _number(low), _number(high), access, role, _number(alarm_low), _number(alarm_high), bool(safety.strip()), _number(value)))
    return rows


@lru_cache(maxsize=1)
def tables() -> dict[str, tuple[str, list[tuple]]]:
    """name -> (schema, rows)."""
    none = lambda x: x.strip() or None
    assets = [(r[0], i, r[1], r[2], r[3], r[4], r[5], r[6], none(r[7]), r[8], bool(r[9].strip()), none(r[10]), none(r[11]), none(r[12]), none(r[13]), r[14]) for i, r in enumerate(_lines(ASSETS))]
    units = [(r[0], i, r[1], r[2], _number(r[3]), _number(r[4]), r[5]) for i, r in enumerate(_lines(UNITS))]
    settle = dict(SETTLES)
    moves = list(TRANSITIONS) + [(s, c, to) for c, (to, never) in ANYWHERE.items() for s in states() if s not in never]
    return {
        "assets": ("asset_id string, ord int, name string, kind string, manufacturer string, model string, serial string, class string, parent string, level string, packml boolean, state string, services string, location string, commissioned string, criticality string", assets),
        "signals": ("tag string, asset_id string, ord int, description string, unit string, quantity_kind string, low double, high double, access string, role string, alarm_low double, alarm_high double, safety boolean, value double", _signals()),
        "feeds": ("src string, dst string", [tuple(r) for r in _lines(FEEDS)]),
        "interlocks": ("id string, tag string, guard_tag string, operator string, threshold double, states string, text string", [(r[0], r[1], r[2], r[3], _number(r[4]), none(r[5]), r[6]) for r in _lines(INTERLOCKS)]),
        "recipes": ("id string, name string, line string, fill_volume double, fill_pressure double, product_temperature double, cap_torque double, rate double", [(*r[:3], *map(_number, r[3:])) for r in _lines(RECIPES)]),
        "plant_events": ("id string, asset_id string, ts string, type string, text string, severity string", [tuple(r) for r in _lines(EVENTS)]),
        "units": ("unit string, ord int, symbol string, quantity_kind string, multiplier double, shift double, aliases string", units),
        "quantity_kinds": ("quantity_kind string, dim string", [tuple(r) for r in _lines(KINDS)]),
        "transitions": ("state string, command string, next_state string, settled string", [(s, c, to, settle.get(to, to)) for s, c, to in moves]),
        "states": ("state string", [(s,) for s in states()]),
        "commands": ("command string", [(c,) for c in COMMANDS]),
    }


@lru_cache(maxsize=None)
def _select(name: str) -> str:
    """The table as a SELECT of Spark SQL, whose rows the optimizer knows."""
    schema, rows = tables()[name]
    columns = [c.split(" ") for c in schema.split(", ")]

    def literal(v, kind: str) -> str:
        if v is None:
            return f"CAST(NULL AS {kind})"
        text = v if isinstance(v, str) else repr(v)
        quoted = "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return quoted if kind == "string" else f"CAST({quoted} AS {kind})"

    body = ", ".join("(" + ", ".join(literal(v, k) for v, (_, k) in zip(r, columns, strict=True)) + ")" for r in rows)
    return f"SELECT * FROM VALUES {body} AS _fixed({', '.join(f'`{c}`' for c, _ in columns)})"


def frame(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(_select(name))


class Plant:
    """The plant's tables as attributes (assets, signals, feeds, ...); any of them may be replaced to ask what if."""

    def __init__(self, spark: SparkSession, **replaced: DataFrame):
        self.spark, self._replaced = spark, replaced

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._replaced[name] if name in self._replaced else frame(self.spark, name)


def values_sql(*names: str) -> str:
    """The tables as common table expressions of DuckDB SQL, to stand after WITH."""

    def literal(v, kind: str) -> str:
        if v is None:
            return f"CAST(NULL AS {kind})"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v!r} AS {kind})"

    types = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN"}
    out = []
    for name in names:
        schema, rows = tables()[name]
        columns = [c.split(" ") for c in schema.split(", ")]
        body = ", ".join("(" + ", ".join(literal(v, types[k]) for v, (_, k) in zip(r, columns, strict=True)) + ")" for r in rows)
        out.append(f"{name}({', '.join(c for c, _ in columns)}) AS (VALUES {body})")
    return ", ".join(out)
