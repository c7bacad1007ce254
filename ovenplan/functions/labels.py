"""One-letter codes and their labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PHONE_TYPES = {
    "w": "work",
    "h": "home",
    "f": "fax",
    "b": "business",
    "m": "mobile",
    "e": "emergency",
}
EMAIL_TYPES = {"w": "work", "b": "business", "p": "personal"}
WEEKDAYS = {0: "Sun", 1: "Mon", 2: "Tue", 3: "Wed", 4: "Thu", 5: "Fri", 6: "Sat"}


def decode(code: Column, labels: Mapping[str, str]) -> Column:
    """The label of a code; NULL for a code without one."""
    result = F
    for value, label in labels.items():
        result = result.when(code == value, F.lit(label))
    return result
