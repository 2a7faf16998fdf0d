"""Ledger event tables with fixed schemas, as a batch or as a stream.

Amounts arrive as decimal digits of up to 128 bits. They become decimal(38,0);
the few values above that range go to the error side with their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Event fields; hashes and addresses are hex text, amounts digits
EVENTS = {
    "anchored": "index bigint, root string, prev_root string, revocation_root string, size bigint, at bigint",
    "terms_published": "terms string, uri string, at bigint",
    "terms_retired": "terms string, at bigint",
    "corpus_sealed": "corpus bigint, manifest_hash string, corpus_root string, supplier string, price string, token string",
    "corpus_closed": "corpus bigint",
    "licensed": "receipt bigint, corpus bigint, buyer string, amount string, to_supplier string, to_protocol string",
    "credited": "who string, token string, amount string",
    "withdrawn": "who string, token string, amount string",
}
AMOUNTS = ("price", "amount", "to_supplier", "to_protocol")
HASHES = ("root", "prev_root", "revocation_root", "terms", "manifest_hash", "corpus_root")


def read_events(spark: SparkSession, path: str, event: str, format: str = "json", stream: bool = False) -> DataFrame:
    """Raw rows of one event kind with its fixed schema."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENTS[event]).format(format).load(path)


def typed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed rows, errors): hashes to binary, amounts to decimal(38,0).

    A hash that is not 32 bytes of hex or an amount that is not a number in
    range makes the row an error; the error row keeps its text.
    """
    bad = F.lit(False)
    converted = []
    for name in rows.columns:
        column = F.col(f"`{name}`")
        if name in AMOUNTS:
            bad = bad | ~F.coalesce(column.rlike("^[0-9]+$") & column.try_cast("decimal(38,0)").isNotNull(), F.lit(False))
            converted.append(column.try_cast("decimal(38,0)").alias(name))
        elif name in HASHES:
            bad = bad | ~F.coalesce(column.rlike("^0x[0-9a-fA-F]{64}$"), F.lit(False))
            converted.append(F.unhex(F.substring(column, 3, 64)).alias(name))
        else:
            converted.append(column.alias(name))
    return rows.filter(~bad).select(*converted), rows.filter(bad)
