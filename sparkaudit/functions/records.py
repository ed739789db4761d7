"""Checks on bibliographic records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
DOI = r"^10\.\d{4,9}/\S+$"
CORRECTION = r"(?i)\b(?:correction|erratum|corrigendum)\b"
MARKUP = r"</?[a-z]+>"


def entry_problems(refs: DataFrame) -> Column:
    """Names of the problems of a record.

    Authors: all when there are at most six, else six and "et al.".
    """
    tests = {
        "empty_author": F.coalesce(F.trim(refs["first_author"]), F.lit("")) == "",
        "unknown_author": refs["entry"].rlike(r"(?i)unknown author"),
        "correction": refs["entry"].rlike(CORRECTION),
        "markup": refs["entry"].rlike(MARKUP),
        "doi_format": ~refs["doi"].rlike(DOI),
        "author_rule": F.when(refs["n_authors"] <= 6, (refs["n_shown"] != refs["n_authors"]) | refs["et_al"]).otherwise(
            (refs["n_shown"] != 6) | ~refs["et_al"]
        ),
    }
    return F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in tests.items()]), lambda x: x.isNotNull())
