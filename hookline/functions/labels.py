"""Label mappings M1 (custom CSV) and M2 (UCI-style targets)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from hookline.fixed import CUSTOM_POSITIVE_LABELS, UCI_POSITIVE_NUMBERS, UCI_POSITIVE_TEXT


def custom_label(label: Column) -> Column:
    """M1: lower(text) in the positive list -> 1, else 0 (no trimming).

    A null label reads as the text ``nan`` (-> 0), as a CSV reader would.
    """
    txt = F.lower(F.coalesce(label.cast("string"), F.lit("nan")))
    return F.when(txt.isin(CUSTOM_POSITIVE_LABELS), 1).otherwise(0)


def uci_label(target: Column, dtype: DataType, positive=None) -> Column:
    """M2: target -> 0/1, by the target column's type.

    ``positive=None`` is the reference mapping: numbers equal to 1 or -1 and
    the texts '1', '-1', 'phishing' become 1 (so a +-1 column collapses to a
    single class). ``positive=v`` maps exactly the value ``v`` to 1.
    """
    if isinstance(dtype, NumericType):
        hit = (target.isin([float(v) for v in UCI_POSITIVE_NUMBERS]) if positive is None
               else target == F.lit(float(positive)))
    else:
        txt = target.cast("string")
        hit = txt.isin(UCI_POSITIVE_TEXT) if positive is None else txt == F.lit(str(positive))
    return F.when(hit, 1).otherwise(0)
