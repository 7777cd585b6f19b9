"""Which rows a model may learn from."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def labelled_sample(rows: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """About `per_label` rows of each label, all where there are fewer, chosen by a hash of the key.

    The share to keep follows from one count per label, so nothing is sorted and
    the choice is the same in every run.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    keep = F.lit(False)
    spot = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 32))
    for value, n in sorted(counts.items()):
        keep = keep | ((F.col(label) == F.lit(value)) & (spot < F.lit(int(min(1.0, per_label / n) * (1 << 32)))))
    return rows.where(keep)
