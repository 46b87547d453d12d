"""Level names and syslog severities."""

from pyspark.sql import functions as F

from logweave.functions.masking import strip
from logweave.model import LEVELS

# Level synonyms, and the level of each syslog severity.
LEVEL_SYNONYMS = {
    "trace": "TRACE", "debug": "DEBUG", "info": "INFO", "informational": "INFO", "notice": "INFO",
    "warn": "WARN", "warning": "WARN", "error": "ERROR", "err": "ERROR", "fatal": "FATAL",
    "critical": "FATAL", "crit": "FATAL", "alert": "FATAL", "emergency": "FATAL", "emerg": "FATAL",
    "panic": "FATAL", "severe": "ERROR",
    "0": "FATAL", "1": "FATAL", "2": "FATAL", "3": "ERROR", "4": "WARN", "5": "INFO", "6": "INFO", "7": "DEBUG",
}
SYSLOG_LEVELS = {0: "FATAL", 1: "FATAL", 2: "FATAL", 3: "ERROR", 4: "WARN", 5: "INFO", 6: "INFO", 7: "DEBUG"}


def _column(c):
    return F.col(c) if isinstance(c, str) else c


def normalize_level(level):
    """One of the six levels; anything unknown is ``INFO``."""
    name = F.lower(strip(level))
    result = F
    for target in LEVELS:
        synonyms = [k for k, v in LEVEL_SYNONYMS.items() if v == target]
        result = result.when(name.isin(synonyms), target)
    return result.otherwise("INFO")


def syslog_severity(priority):
    """Level of a syslog priority number."""
    severity = _column(priority).bitwiseAND(7)
    result = F
    for code, level in SYSLOG_LEVELS.items():
        result = result.when(severity == code, level)
    return result.otherwise("INFO")
