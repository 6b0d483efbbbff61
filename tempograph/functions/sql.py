"""The library's functions by name in SQL: scalar ones, and the scan of a text as a table function for LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import text

#: Scalar functions: normalize_title(title), html_text(page), unescape(text), indel_ratio(a, b), gram_jaccard(a, b).
FUNCTIONS = {"normalize_title": text.normalize_title, "html_text": text.html_text, "unescape": text.unescape, "indel_ratio": text.indel_ratio, "gram_jaccard": text.gram_jaccard}


def scanner(vocabulary: dict[str, str]):
    """A table function scan(text) -> start_at, end_at, skill_id, surface: the mentions of a dictionary's surfaces in a text.

    Whole words only, leftmost, then longest, none of which overlap; a null text has none.
    """
    text.bounded(vocabulary)

    class Scan:
        def __init__(self) -> None:
            self.surfaces = text.Surfaces(vocabulary)  # made once a task

        def eval(self, page: str) -> Iterator[tuple]:
            for start, end, surface in self.surfaces.mentions(page or ""):
                yield start, end, self.surfaces.skill_of[surface], surface

    return udtf(Scan, returnType="start_at int, end_at int, skill_id string, surface string")


def register(spark: SparkSession, vocabulary: dict[str, str] | None = None, scan: str = "scan_skills") -> list[str]:
    """Make the functions known to a session's SQL, with a vocabulary also its scan; their names.

        SELECT doc_id, s.* FROM documents, LATERAL scan_skills(text) s WHERE s.skill_id = 'x'
    """
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    if vocabulary is None:
        return list(FUNCTIONS)
    spark.udtf.register(scan, scanner(vocabulary))
    return [*FUNCTIONS, scan]
