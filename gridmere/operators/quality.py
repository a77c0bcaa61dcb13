"""Coverage audits: did a source join, is a column empty, how complete is a series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridmere import fixed
from gridmere.operators.tables import matched_keys, not_null


def match_gate(
    base: DataFrame, other: DataFrame, key: str, source: str, gate: float = fixed.MATCH_RATE_GATE
) -> DataFrame:
    """A coverage row: joined when at least this share of base keys has a partner."""
    m = matched_keys(base, other, key)
    ok = F.col("matched") >= gate * F.col("total")
    rate = F.round(100 * F.col("matched") / F.col("total"), 1)
    return m.select(
        F.lit(source).alias("source"),
        F.col("matched").alias("area_matches"),
        F.col("total").alias("area_total"),
        F.when(ok, "joined").otherwise("failed").alias("status"),
        F.concat_ws(
            "", F.col("matched"), F.lit("/"), F.col("total"), F.lit(" areas matched ("),
            rate.cast("string"), F.lit("%)"),
        ).alias("detail"),
    )


def coverage_row(
    counts: DataFrame, source: str, status: Column | str, detail: Column | str,
    matches: Column | None = None, total: Column | None = None,
) -> DataFrame:
    """A coverage row from a one-row table of counts."""

    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    none = F.lit(None).cast("long")
    return counts.select(
        F.lit(source).alias("source"),
        (none if matches is None else matches.cast("long")).alias("area_matches"),
        (none if total is None else total.cast("long")).alias("area_total"),
        col(status).alias("status"), col(detail).alias("detail"),
    )


def non_null_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, rows, filled, rate: one pass over the data."""
    cols = list(columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(cols)])
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(cols)]
    )
    return wide.select("__n", F.explode(entries).alias("e")).select(
        "e.column", F.col("__n").alias("rows"), "e.filled",
        F.try_divide(F.col("e.filled"), F.col("__n")).alias("rate"),
    )


def empty_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns without a single value."""
    return non_null_rates(df, columns).where(F.col("filled") == 0).select("column")


def series_coverage(series: DataFrame, wanted: DataFrame, key: str, date: str) -> DataFrame:
    """Per wanted key: number of rows, first and last date, and whether there are any."""
    have = series.where(not_null(key)).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_weeks"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )
    keys = wanted.select(key).where(not_null(key)).distinct()
    return keys.join(have, key, "left").select(
        key, F.coalesce("n_weeks", F.lit(0)).alias("n_weeks"), "first_date", "last_date",
        F.when(F.col("n_weeks").isNotNull(), "ok").otherwise("no series on page").alias("status"),
    )


class Audit:
    """
    Coverage of sources, gathered while their tables are written: `watch` adds counters to a table
    that some later write computes on its way, so nothing is read a second time. `table`
    may be asked for once everything watched has been written.
    """

    _SCHEMA = "source string, area_matches long, area_total long, status string, detail string"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.entries: list[tuple | tuple[str, str, str | None, Observation]] = []

    def note(self, source: str, status: str, detail: str) -> None:
        self.entries.append((source, None, None, status, detail))

    def watch(self, df: DataFrame, source: str, what: str, answer: str | None = None) -> DataFrame:
        """
        Counts the rows, and those with an `answer`: 'missing' without rows, 'failed' if
        none has an answer, 'partial' if some have none, else 'joined'.
        """
        seen = Observation()
        self.entries.append((source, what, answer, seen))
        filled = F.count(answer) if answer else F.count(F.lit(1))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), filled.alias("filled"))

    def watch_columns(self, df: DataFrame, source: str) -> DataFrame:
        """Counts the values of every column: 'failed' if some have none, naming them, else 'joined' with the least share."""
        seen = Observation()
        self.entries.append((source, None, None, seen))
        values = [F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]
        return df.observe(seen, F.count(F.lit(1)).alias("__rows"), *values)

    def attempt(self, source: str, make: Callable[[], DataFrame]) -> DataFrame | None:
        """What `make` gives, or None and a 'failed' entry in place of its own ones."""
        before = len(self.entries)
        try:
            return make()
        except Exception as e:  # a source that fails must not stop the others
            del self.entries[before:]
            self.note(source, "failed", (str(e).strip() or type(e).__name__).splitlines()[0][:300])
            return None

    def _row(self, entry: tuple) -> tuple:
        if len(entry) == 5:
            return entry
        source, what, answer, seen = entry
        got = dict(seen.get)
        if what is None:
            rows = got.pop("__rows")
            empty = [c for c, n in got.items() if not n] if rows else []
            if empty:
                return source, None, None, "failed", f"all-empty columns: {', '.join(empty)}"
            least = min(got, key=got.get) if rows and got else None
            share = f", {least} filled in {100 * got[least] / rows:.1f}%" if least else ""
            return source, None, None, "joined" if rows else "missing", f"{rows} rows{share}"
        n, filled = got["rows"], got["filled"]
        status = "missing" if not n else "joined" if filled == n else "partial" if filled else "failed"
        return source, None, None, status, f"{filled}/{n} {what}" if answer else f"{n} {what}"

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([self._row(e) for e in self.entries], self._SCHEMA)
