"""ASCII spelling of names, for small rule tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def ascii_labels(name: str) -> str | None:
    """Null where the name is ASCII already."""
    if name.isascii():
        return None
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split("."))


@F.pandas_udf(StringType())
def ascii_form(names: pd.Series) -> pd.Series:
    return names.map(lambda x: ascii_labels(x) if isinstance(x, str) else None)
