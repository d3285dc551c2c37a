"""Unicode normal forms, for which Spark has no function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _normal(form: str):
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return F.pandas_udf(run, T.StringType())


def normal_form(text: Column, form: str = "NFKC") -> Column:
    """The text in a normal form; texts of ASCII alone, which is normal in any form, are not sent to Python."""
    beyond = F.when(text.rlike(r"[^\x00-\x7F]"), F.make_valid_utf8(text))
    return F.coalesce(_normal(form)(beyond), text)
