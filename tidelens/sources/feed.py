"""A plant's feed: one JSON message of many numbers becomes one reading a metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.sources.readings import assign_sequence

#: Fixed values. Least rated power in kW for a capacity factor; per topic the field that names the entity, and its metrics: a payload
#: field, or a difference or ratio of two. The first metric is the topic's primary one.
FLOOR_KW = 50.0
TOPICS: dict[str, tuple[str, dict[str, str | tuple[str, str, str]]]] = {
    "sites": ("Site_ID", {
        "power_shortfall_mw": ("-", "Expected_Power_MW", "AC_Power_MW"),
        "ac_power_mw": "AC_Power_MW",
        "expected_power_mw": "Expected_Power_MW",
        "performance_ratio": "Performance_Ratio",
        "poa_irradiance_wm2": "POA_Irradiance_Wm2",
        "curtailment_pct": "Curtailment_%",
        "availability_pct": "Availability_%",
        "soiling_index": "Soiling_Index",
    }),
    "inverters": ("Inverter_ID", {
        "pr_local": "PR_Local",
        "efficiency_pct": "Efficiency_%",
        "output_ac_power_kw": "Output_AC_Power_kW",
        "temperature_module_c": "Temperature_Module",
        "input_dc_voltage_v": "Input_DC_Voltage",
        "ac_voltage_v": "AC_Voltage",
        "availability_pct": "Availability_%",
        "capacity_factor": ("/", "Output_AC_Power_kW", "Rated_AC_kW"),
    }),
    "strings": ("String_ID", {
        "deviation_pct": "Deviation_%",
        "power_shortfall_w": ("-", "Expected_Power_W", "Actual_Power_W"),
        "actual_power_w": "Actual_Power_W",
        "expected_power_w": "Expected_Power_W",
        "dc_current_a": "DC_Current_A",
        "dc_voltage_v": "DC_Voltage_V",
        "temperature_cell_c": "Temperature_Cell",
        "soiling_factor": "Soiling_Factor",
    }),
    "weather": ("Station_ID", {
        "poa_irradiance_wm2": "POA_Irradiance_Wm2",
        "ghi_wm2": "GHI_Wm2",
        "dni_wm2": "DNI_Wm2",
        "ambient_temperature_c": "Ambient_Temperature_C",
        "module_temperature_c": "Module_Temperature_C",
        "wind_speed_mps": "Wind_Speed_mps",
        "humidity_pct": "Humidity_%",
    }),
    "grid": ("Meter_ID", {
        "setpoint_shortfall_mw": ("-", "Setpoint_MW", "Active_Power_MW"),
        "active_power_mw": "Active_Power_MW",
        "setpoint_mw": "Setpoint_MW",
        "voltage_kv": "Voltage_kV",
        "frequency_hz": "Frequency_Hz",
        "curtailment_mw": "Curtailment_MW",
    }),
}


def primary(topic: str) -> str:
    """The metric of a topic that a detector watches."""
    return next(iter(TOPICS[topic][1]))


def _field(name: str) -> str:
    return f"try_variant_get(__v, '$[\\'{name}\\']', 'variant')"


def number(name: str) -> str:
    """SQL of a payload field as a number; text and truth values are none."""
    return f"__n.`{name}`"


def _numbers() -> str:
    """The schema of all numeric fields: what is no number there reads as null."""
    fields = {f for _, specs in TOPICS.values() for spec in specs.values() for f in ([spec] if isinstance(spec, str) else spec[1:])}
    return ", ".join(f"`{f}` DOUBLE" for f in sorted(fields))


def text(name: str) -> str:
    """SQL of a payload field that is text."""
    return f"CASE WHEN schema_of_variant({_field(name)}) = 'STRING' THEN cast({_field(name)} AS STRING) END"


def iso_ms(column: str) -> Column:
    """Milliseconds of an ISO 8601 time with its offset; null for any other text."""
    stamp = F.expr(f"CASE WHEN {column} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}' THEN try_cast({column} AS TIMESTAMP) END")
    return F.unix_millis(stamp)


def _metric(spec: str | tuple[str, str, str]) -> str:
    if isinstance(spec, str):
        return number(spec)
    how, a, b = spec
    if how == "-":
        return f"({number(a)}) - ({number(b)})"
    return f"CASE WHEN ({number(b)}) >= {FLOOR_KW} THEN ({number(a)}) / ({number(b)}) END"


def map_payloads(messages: DataFrame) -> DataFrame:
    """``channel, seq, arrival, event_ts_ms, value`` of messages (``topic``, ``payload`` as JSON, ``arrival``).

    A message of an unknown topic, that is no JSON, or without an entity or a time gives nothing; a metric without its
    numbers gives no reading. Numbering is dense from 1 a channel in order of arrival.
    """
    m = messages.select("topic", "arrival", F.expr("try_parse_json(payload)").alias("__v"), F.from_json("payload", _numbers(), {"allowNonNumericNumbers": "false"}).alias("__n"))
    entity = F.expr("CASE topic " + " ".join(f"WHEN '{t}' THEN {text(f)}" for t, (f, _) in TOPICS.items()) + " END")
    metrics = F.expr("CASE topic " + " ".join(
        f"WHEN '{t}' THEN array({', '.join(f"named_struct('metric', '{n}', 'value', {_metric(s)})" for n, s in specs.items())})" for t, (_, specs) in TOPICS.items()
    ) + " END")
    m = m.withColumn("entity", entity).withColumn("stamp", F.expr(text("ts"))).withColumn("event_ts_ms", iso_ms("stamp"))
    m = m.where("entity IS NOT NULL AND event_ts_ms IS NOT NULL").select("arrival", "entity", "event_ts_ms", F.explode(metrics).alias("m")).where("m.value IS NOT NULL")
    m = m.select(F.concat("entity", F.lit("."), "m.metric").alias("channel"), "arrival", "event_ts_ms", F.col("m.value").alias("value"))
    return assign_sequence(m).select("channel", "seq", "arrival", "event_ts_ms", "value")
