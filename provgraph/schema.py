"""Vocabularies and record types of the graph."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The certainty order.
CERTAINTY = {"inferred": 0, "asserted": 1, "verified": 2}
#: Which records each kind of producer call may send.
VERBS = {
    "symbols": ["symbol", "data_entity"],
    "contracts": ["contract", "edge"],
    "calls": ["edge"],
    "data_access": ["edge", "data_entity"],
    "live_schema": ["data_entity"],
}
#: Default certainty by record type.
DEFAULT_CERTAINTY = {"symbol": "asserted", "contract": "inferred", "data_entity": "verified", "edge": "asserted"}

RECORD = T.StructType(
    [
        T.StructField("record_type", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("source_version", T.StringType()),
        T.StructField("analyzed_at", T.StringType()),
        T.StructField("data", T.StringType()),
    ]
)


def certainty_rank(c: Column) -> Column:
    """The place in the certainty order; -1 for anything else."""
    out = F.lit(-1)
    for name, rank in CERTAINTY.items():
        out = F.when(c == name, rank).otherwise(out)
    return out
