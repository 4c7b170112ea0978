"""Cleaning of flat order lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from starlane.functions.dates import parse_day_first
from starlane.session import read_table_of, remove_path, write_table


def mode_value(df: DataFrame, col: str) -> DataFrame:
    """One-row frame holding the most frequent non-null value of ``col``.

    Ties go to the smallest value, and the column keeps its type.  Counting is
    a distributed group-by with map-side partial counts; the pick is a
    per-partition top-1.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.desc("_n"), F.asc(col)).limit(1).select(col)


def impute_mode(df: DataFrame, col: str = "postal_code") -> DataFrame:
    """Fill nulls in ``col`` with its mode, only when the column exists.

    The mode is a scalar subquery, evaluated once before the scan and
    inlined: no join, no driver round-trip of data.  If the column is all
    null the mode is null and nulls stay.
    """
    if col not in df.columns:
        return df
    fill = mode_value(df, col).scalar()
    return df.withColumn(col, F.coalesce(F.col(col), fill))


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows; nulls compare equal."""
    return df.dropDuplicates()


#: Repeated fingerprints (8 bytes each) up to which rows are told apart by them.
REPEATED_ROWS = 4_000_000


def fingerprint(columns: list[str], bits: int = 64) -> Column:
    """A hash of ``columns``, shortened to ``bits``; equal values have equal ones."""
    mask = F.lit(-1 if bits >= 64 else (1 << bits) - 1).cast("bigint")
    return F.xxhash64(*columns).bitwiseAND(mask)


def dedupe_stored(df: DataFrame, bits: int = 64, mark: str | None = None) -> DataFrame:
    """T2 for a stored table: exact, but only rows that may be duplicates are shuffled.

    Equal rows have equal fingerprints (a 64-bit hash of all columns), so a
    row whose fingerprint occurs once is unique and stays where it is.  The
    first pass shuffles fingerprints alone; rows with a repeated one, by
    duplication or collision, are compared in full.  If
    more than ``REPEATED_ROWS`` fingerprints repeat, all rows are.  ``bits``
    shortens the hash.  ``mark`` names a stored column of fingerprints (of
    all or some of the other columns); it saves hashing the rows in each
    pass, and is not in the result.
    """
    if mark is None:
        marked = df.select("*", fingerprint(df.columns, bits).alias("_mark"))
    else:
        marked = df.withColumnRenamed(mark, "_mark")
        df = df.drop(mark)
    counts = marked.select("_mark").groupBy("_mark").agg(F.count(F.lit(1)).alias("_n"))
    repeated = counts.filter("_n > 1").select("_mark")
    path = write_table(repeated, "repeated-marks")
    repeated = read_table_of(df.sparkSession, path, repeated.schema)
    if repeated.count() > REPEATED_ROWS:
        return dedupe_rows(df)
    repeated = F.broadcast(repeated)
    unique = marked.join(repeated, "_mark", "left_anti").drop("_mark")
    again = marked.join(repeated, "_mark", "left_semi").drop("_mark")
    return unique.unionByName(again.dropDuplicates())


def dedupe_report(df: DataFrame) -> DataFrame:
    """Rows before / after exact-duplicate removal, in one pass."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.sum("_n").cast("bigint").alias("rows_in"),
        F.count(F.lit(1)).cast("bigint").alias("rows_out"),
    ).select(
        "rows_in",
        "rows_out",
        (F.col("rows_in") - F.col("rows_out")).alias("rows_removed"),
    )


def parse_dates(df: DataFrame, strict: bool = True) -> DataFrame:
    """T3+T4: day-first text dates -> date columns ``order_date``/``ship_date``.

    strict (default) fails the job on any unparseable value, like the
    original load.  Lenient turns it into null; use ``quarantine_dates`` to
    split those rows out.
    """
    out = df
    for src, dst in (("order_date_s", "order_date"), ("ship_date_s", "ship_date")):
        if src in out.columns:
            out = out.withColumn(dst, parse_day_first(src, strict=strict))
    keep = [c for c in out.columns if c not in ("order_date_s", "ship_date_s")]
    if strict:
        return out.select(keep)
    return out


DATE_TEXTS = ("order_date_s", "ship_date_s")


def _unparsed(parsed: DataFrame) -> Column:
    """Whether a date text of a leniently parsed row did not parse."""
    bad = F.lit(False)
    for text in DATE_TEXTS:
        if text in parsed.columns:
            bad = bad | (F.col(text).isNotNull() & F.col(text.removesuffix("_s")).isNull())
    return bad


def quarantine_dates(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split leniently parsed rows into (good, quarantined).

    A row is quarantined when a non-null date text did not parse.
    """
    bad = _unparsed(parsed)
    keep = [c for c in parsed.columns if c not in DATE_TEXTS]
    good = parsed.where(~bad).select(keep)
    return good, parsed.where(bad)


def invalid_date_rows(df: DataFrame) -> DataFrame:
    """T5: rows shipped before they were ordered (they are kept downstream)."""
    return df.where(F.col("ship_date") < F.col("order_date"))


def invalid_date_count(df: DataFrame) -> DataFrame:
    """T5: number of rows shipped before they were ordered, one pass."""
    return df.agg(
        F.count_if(F.col("ship_date") < F.col("order_date")).cast("bigint").alias("invalid_rows")
    )


def drop_if_present(df: DataFrame, col: str) -> DataFrame:
    """Drop a column if it is there (no-op otherwise)."""
    return df.drop(col)


@dataclass(frozen=True)
class Cleaned:
    """What cleaning makes of the flat rows, stored: the ``lines``, the
    ``quarantined`` rows, and the counts observed while they were written."""

    lines: DataFrame
    quarantined: DataFrame
    counts: dict[str, int]
    paths: tuple[str, ...]  # of what is stored

    def release(self) -> None:
        """Delete what is stored, once everything made from it is written."""
        for path in self.paths:
            remove_path(self.lines.sparkSession, path)

    def report(self) -> dict[str, int]:
        """Row counts that add up, and the lines shipped before their order date."""
        return dict(self.counts)


def _staged(df: DataFrame, name: str, *metrics: Column) -> tuple[str, DataFrame, dict[str, object]]:
    """Write ``df``; its path, the table read back, and the aggregates of its rows
    that were taken while they were written."""
    seen = Observation(name)
    path = write_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics), name)
    return path, read_table_of(df.sparkSession, path, df.schema), seen.get


def clean_parts(flat: DataFrame, strict: bool = True) -> Cleaned:
    """T8 with everything it sets aside.  The source is read once and no job
    only counts: the mode and all counts are observed by the writes (the mode as
    a mergeable table of value counts, with as many entries as the column has values).

    Fingerprints of the rows are written with them.  They leave the postal code
    out, which is not imputed yet: rows that are equal afterwards have equal ones."""
    fills = [F.mode("postal_code", deterministic=True).alias("mode")] if "postal_code" in flat.columns else []
    mark = fingerprint([c for c in flat.columns if c != "postal_code"])
    flat_path, rows, of_flat = _staged(flat.withColumn("_mark", mark), "flat", *fills)
    if fills:
        mode = F.lit(of_flat["mode"]).cast(flat.schema["postal_code"].dataType)
        rows = rows.withColumn("postal_code", F.coalesce("postal_code", mode))
    parsed = parse_dates(dedupe_stored(rows, mark="_mark"), strict=strict)
    aside = F.lit(False) if strict else _unparsed(parsed)
    # One table holds both parts; texts of dates that did parse are not kept in it.
    texts = [F.when(F.col("_aside"), F.col(c)).alias(c) if c in DATE_TEXTS else F.col(c) for c in parsed.columns]
    staged = parsed.withColumn("_aside", aside).select("_aside", *texts)
    wrong = F.count_if(~F.col("_aside") & (F.col("ship_date") < F.col("order_date"))).alias("invalid_dates")
    path, deduped, of_deduped = _staged(staged, "deduped", F.count_if("_aside").alias("aside"), wrong)
    remove_path(flat.sparkSession, flat_path)
    lines = deduped.where(~F.col("_aside")).drop("_aside", "row_id", *DATE_TEXTS)
    bad = flat.limit(0) if strict else deduped.where("_aside").drop("_aside")
    counts = {
        "rows_in": of_flat["rows"],
        "duplicates_removed": of_flat["rows"] - of_deduped["rows"],
        "quarantined": of_deduped["aside"],
        "lines": of_deduped["rows"] - of_deduped["aside"],
        "invalid_dates": of_deduped["invalid_dates"],
    }
    return Cleaned(lines, bad, counts, (path,))


def clean_flat(flat: DataFrame, strict: bool = True) -> DataFrame:
    """Impute postal code -> drop duplicates -> parse dates -> drop row id.

    Duplicates are removed while ``row_id`` is still present, so two lines
    count as duplicates only when their row ids agree too.  Rows shipped
    before their order date are counted by ``invalid_date_count`` but kept.
    Lenient reading leaves out rows whose dates do not parse; ``clean_parts``
    hands them over and counts them.
    """
    imputed = impute_mode(flat, "postal_code")
    deduped = dedupe_rows(imputed)
    parsed = parse_dates(deduped, strict=strict)
    if not strict:
        parsed, _ = quarantine_dates(parsed)
    return drop_if_present(parsed, "row_id")
