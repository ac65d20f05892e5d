"""Values as text, for exports and the prompt: shortest digits, no exponents, whole floats without a point."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np


def shown(value: object, single: bool = False) -> str:
    if value is None:
        return ""
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        if math.isinf(value):
            return "inf" if value > 0 else "-inf"
        text = format(Decimal(str(np.float32(value)) if single else repr(value)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    return str(value)


def csv_cell(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text
