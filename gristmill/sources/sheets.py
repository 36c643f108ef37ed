"""Sheets: CSV with a sniffed dialect, sheets as text, grids, rosters by year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.operators import people as P
from gristmill.operators.rules import NOT_A_NAME

DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def sniff(spark: SparkSession, path: str) -> str:
    """The separator that the first line has most of."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0]["value"] if first else ""
    return max(",;\t|", key=line.count) if any(c in line for c in ",;\t|") else ","


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep=sniff(spark, path), multiLine=True, escape='"', encoding="utf-8")


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, cell): every cell of small sheets, quotes respected; one file is one row until it is cut."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    lines = raw.select("file", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("row", "line")).filter("line <> ''")
    field = r',(?:"(?:[^"]|"")*"|[^,"]*)'
    n = F.regexp_extract_all(F.concat(F.lit(","), F.col("line")), F.lit(field), F.lit(0))
    parts = F.transform(n, lambda f: F.replace(F.regexp_replace(F.regexp_replace(f, "^,", ""), '^"|"$', ""), F.lit('""'), F.lit('"')))
    return lines.select("file", "row", F.posexplode(parts).alias("col", "cell")).select("file", "row", "col", F.trim("cell").alias("cell"))


def as_text(sheet: DataFrame, limit: int = 12_000) -> DataFrame:
    """(file, text) from cells: the cells of a row joined by bars; after the row that goes beyond ``limit`` characters a mark ends it."""
    rows = sheet.filter("cell <> ''").groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("col", "cell"))).alias("c")).select("file", "row", F.array_join(F.col("c.cell"), " | ").alias("line"))
    w = Window.partitionBy("file").orderBy("row")
    spent = F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = rows.withColumn("spent", spent).withColumn("before", F.col("spent") - F.length("line") - 1).filter(F.col("before") <= limit)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n")
    return kept.groupBy("file").agg(text.alias("text"), F.max("spent").alias("spent")).select("file", F.when(F.col("spent") > limit, F.concat("text", F.lit("\n[...]"))).otherwise(F.col("text")).alias("text"))


def sample_json(rows: DataFrame, key: str, order: str, n: int = 20) -> DataFrame:
    """(key, sample): the first n rows of each key as JSON."""
    others = [c for c in rows.columns if c not in (key, order)]
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= n)
    return first.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*others).alias("r")))), lambda x: x["r"])).alias("sample"))


def grid(sheet: DataFrame, least_days: int = 3, within: int = 25) -> DataFrame:
    """(file, category, shift, day, person) from cells of sign-up grids.

    The header is the first row, of ``within``, with ``least_days`` day names; a day owns the columns up to the next. A row with
    text in its first column alone sets the category for those below; other rows are shifts, whose cells under a day name people.
    """
    day = F.when(F.col("row") < within, F.regexp_extract(F.lower("cell"), "^(" + "|".join(DAYS) + r")\b", 1))
    n = int(sheet.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many, so that none are merged into tasks that spill
    cells = sheet.filter("file is not null and row is not null and cell <> ''").repartition(n, "file")  # dealt once: all windows are of files
    cells = cells.select("file", "row", "col", "cell", F.when(day != "", day).alias("day"))
    so_far = Window.partitionBy("file", "row").orderBy("col", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    label = F.first(F.when(F.col("col").isNotNull(), F.col("cell")), ignorenulls=True).over(so_far)
    seen = F.bit_or(F.expr(f"shiftleft(1L, instr('{' '.join(DAYS)}', day))")).over(so_far)  # a bit for each day
    rows = cells.withColumns({"label": label, "at": F.first("col", ignorenulls=True).over(so_far), "seen": seen})
    w = Window.partitionBy("file").orderBy("row")
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.first(F.when(F.bit_count("seen") >= least_days, F.col("row")), ignorenulls=True).over(upto)
    rows = rows.withColumns({"head": head, "before": F.lag("row").over(w), "after": F.lead("row").over(w)})
    below = F.col("row") > F.col("head")
    alone = below & (F.col("col") == 0) & ~F.col("before").eqNullSafe(F.col("row")) & ~F.col("after").eqNullSafe(F.col("row"))
    rows = rows.withColumn("category", F.last(F.when(alone, F.col("cell")), ignorenulls=True).over(upto))
    heads = (F.col("row") == F.col("head")) & F.col("day").isNotNull() & F.col("col").isNotNull()
    named = below & (F.col("at") == 0) & (F.col("col") > 0) & ~F.col("cell").rlike(NOT_A_NAME)  # beside its row's label
    across = Window.partitionBy("file").orderBy("col", "row", "day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(heads, F.col("day")), ignorenulls=True).over(across)
    owned = rows.filter(heads | named).withColumn("owner", owner).filter(below & F.col("owner").isNotNull())
    return owned.select("file", "category", F.col("label").alias("shift"), F.initcap("owner").alias("day"), F.col("cell").alias("person"))


def read_roster(rows: DataFrame, columns: dict[str, str | None], year: int, default: str = "listed", commitments: tuple[str, ...] = ()) -> DataFrame:
    """(year, first, last, nickname, email, city, status) from one year's sheet under that year's column names.

    A confirmed commitment column makes an unclear answer an attendance; a "no" stays.
    """
    col = lambda k: F.coalesce(F.col(f"`{columns[k]}`"), F.lit("")) if columns.get(k) else F.lit("")
    name = P.split_name(col("name"))
    status = P.status_of(col("status"), default)
    paid = F.lit(False)
    for c in commitments:
        paid = paid | P.confirms(F.col(f"`{c}`"))
    return rows.select(
        F.lit(year).alias("year"),
        name["first"].alias("first"),
        name["last"].alias("last"),
        name["nickname"].alias("nickname"),
        P.email_or_empty(col("email")).alias("email"),
        P.city_key(col("city")).alias("city"),
        F.when(paid & (status != "not"), F.lit("attending")).otherwise(status).alias("status"),
    ).filter("first <> ''")


def best_status(status: Column) -> Column:
    """As an aggregate: attending, then maybe, listed, not."""
    return F.max_by(status, F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("attending", 3, "maybe", 2, "listed", 1, "not", 0)]), status), F.lit(-1)))


def roster(appearances: DataFrame) -> DataFrame:
    """(key, years, statuses, attended): appearances under one email, or else one full name, are one person."""
    key = F.when(F.col("email") != "", F.col("email")).otherwise(F.lower(F.concat_ws(" ", "first", "last")))
    per_year = appearances.groupBy(key.alias("key"), "year").agg(best_status(F.col("status")).alias("status"))
    return per_year.groupBy("key").agg(F.array_sort(F.collect_set("year")).alias("years"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "status")))).alias("statuses"), F.count_if(F.col("status") == "attending").alias("attended"))


def head_counts(appearances: DataFrame) -> DataFrame:
    return appearances.filter("status = 'attending'").groupBy("year").agg(F.countDistinct(F.lower(F.concat_ws(" ", "first", "last"))).alias("people"))


def replace_file(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Writes rows partitioned by file; a file's partition is replaced, the others stay."""
    rows.write.partitionBy("file").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def shift_rows(rows: DataFrame) -> DataFrame:
    """(day, role, person) of an older sheet's rows: names in one cell part at commas; rows with neither day nor role go."""
    kept = rows.filter((F.trim(F.coalesce("day", F.lit(""))) != "") | (F.trim(F.coalesce("role", F.lit(""))) != ""))
    each = kept.select(F.trim("day").alias("day"), F.trim("role").alias("role"), F.explode(F.split("people", ",")).alias("person")).withColumn("person", F.trim("person"))
    return each.filter((F.col("person") != "") & ~F.col("person").rlike(NOT_A_NAME))


def write_summary(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Small results as JSON lines or CSV with a header."""
    w = rows.coalesce(1).write.mode("overwrite")
    w.json(path) if kind == "json" else w.option("header", True).csv(path)
