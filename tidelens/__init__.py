"""Tidelens: sensor and event time-series analytics expressed as Spark DataFrame operators."""
