"""Search in kept texts that opens only the files that can hold a match.

Beside each folder of texts lies a folder of signatures: for every file a bitmap of the trigrams of its texts, hashed to
``BITS`` places (32,768 bits a row, rows without a bit are not stored). A pattern's literal parts give trigrams that a
match must hold; a file that lacks one of them is not opened. What is left is searched by the exact comparison, so the rows
are those of a full scan. Folders without signatures are always searched.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.plans.audit import Audit, filter_interactions
from hushframe.plans.store import SIGNATURES, TABLES, evolve
from hushframe.plans.versions import Version, read_rows, read_version

GRAM = 3
#: Places of a file's bitmap; about five times the trigrams a file of texts in many languages holds.
BITS = 1 << 20
_ROW_BITS = 1 << 15
SIGNATURE = "file STRING, part BIGINT, bits BINARY"
TEXTS = "interaction_text"


def _file():
    """A file's folder and name."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


def sign_texts(spark: SparkSession, path: str, folder: str) -> None:
    """Write the signatures of one folder of texts, under the same name.

    Trigrams are made distinct in each text, then in each task, before anything is shuffled; a file gives at most
    ``BITS`` of them, and its bitmap has at most ``BITS / 32768`` rows of 4 KB.
    """
    rows = read_rows(spark, path, TEXTS, TABLES[TEXTS], [folder]).select(_file().alias("file"), F.explode(F.array("original", "anonymized")).alias("t"))
    lower = F.translate("t", ascii_uppercase, ascii_lowercase)
    long = rows.select("file", lower.alias("t")).filter(F.length("t") >= GRAM)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - GRAM + 1), lambda i: _place(F.substring("t", i, F.lit(GRAM)))))
    places = long.select("file", F.explode(grams).alias("place")).distinct()
    bitmaps = places.groupBy("file", F.floor(F.col("place") / _ROW_BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("place") % _ROW_BITS).alias("bits"))
    bitmaps.write.mode("overwrite").parquet(f"{path}/{SIGNATURES}/{folder}")


def _place(gram):
    return F.pmod(F.xxhash64(gram), F.lit(BITS))


def required(q: str) -> list[str]:
    """The distinct trigrams that every match of a search holds; ``%`` and ``_`` are wildcards."""
    lower = q.translate(str.maketrans(ascii_uppercase, ascii_lowercase))
    return sorted({part[i : i + GRAM] for part in re.split("[%_]", lower) for i in range(len(part) - GRAM + 1)})


def candidate_files(spark: SparkSession, path: str, q: str, now: Version) -> list[str]:
    """Folders and files of texts (as names below their table) that may hold a match."""
    folders = now.folders(TEXTS)
    signed = set(now.folders(SIGNATURES))
    grams = required(q)
    if not grams:
        return folders
    known = [f for f in folders if f in signed]
    rest = [f for f in folders if f not in signed]
    if not known:
        return rest
    asked = spark.createDataFrame([(g,) for g in grams], "gram string").select(_place(F.col("gram")).alias("place")).distinct()
    asked = asked.select(F.floor(F.col("place") / _ROW_BITS).alias("part"), (F.col("place") % _ROW_BITS).alias("at"))
    n = asked.count()  # as many as the pattern has trigrams
    byte = F.conv(F.hex(F.substring("bits", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("getbit(byte, cast(at % 8 as int))") == 1
    found = read_rows(spark, path, SIGNATURES, SIGNATURE, known).join(F.broadcast(asked), "part").withColumn("byte", byte).filter(hit)
    files = found.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n).select("file")
    return rest + sorted(r.file for r in files.collect())  # names of files, as a scan of them needs them


def audit_for(spark: SparkSession, path: str, q: str, version: int | None = None) -> Audit:
    """The audit tables with only those texts that a search for ``q`` has to look at."""
    now = read_version(spark, path, version)
    frames = {name: evolve(read_rows(spark, path, name, ddl, now.folders(name)), ddl) for name, ddl in TABLES.items() if name != TEXTS}
    texts = evolve(read_rows(spark, path, TEXTS, TABLES[TEXTS], candidate_files(spark, path, q, now)), TABLES[TEXTS])
    return Audit(frames["interaction"], frames["detection"], texts)


def search_audit(spark: SparkSession, path: str, q: str, version: int | None = None, **filters) -> DataFrame:
    """Interactions with a text that matches ``q``, as ``filter_interactions(q=...)`` over all texts gives them."""
    return filter_interactions(audit_for(spark, path, q, version), q=q, **filters)
