"""Readers, guards and sinks around sites, series and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrasift.functions.periods import lenient_date, ordinal_of_date, ordinal_of_name, period_name
from terrasift.operators.rules import fixed

SERIES_SCHEMA = (
    "site struct<uid:string,name:string>, tau double, series array<struct<period:string,n_valid:int,valid_frac:double,clear_frac:double,rmse:double,"
    "vegetation:double,soil:double,high_albedo:double,low_albedo:double,ndvi:double,ndbi:double,swir:double>>"
)


def clean_cell(c: Column) -> Column:
    """Trimmed; none, nan and null spellings are empty."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t).isin("nan", "none"), "").otherwise(t)


def slug(name: Column, uid: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat_ws("-", F.left(s, F.lit(48)), F.left(uid, F.lit(8)))


def collisions(named: DataFrame) -> DataFrame:
    """Slugs that several uids share."""
    return named.groupBy("slug").agg(F.count_distinct("uid").alias("n")).where("n > 1")


def read_series(spark: SparkSession, path: str, min_valid: int = 20, min_clear: float = 0.6) -> DataFrame:
    """Long series of a folder of JSON documents, without ``_`` files, usable rows only."""
    docs = spark.read.schema(SERIES_SCHEMA).option("multiLine", True).json(path).withColumn("_file", F.input_file_name())
    uid = F.coalesce("site.uid", F.regexp_extract("_file", r"([^/]+)\.json$", 1))
    rows = docs.select(uid.alias("uid"), F.explode("series").alias("r")).select("uid", "r.*")
    return quality_filter(rows, min_valid, min_clear).withColumn("ord", ordinal_of_name(F.col("period")))


def read_series_with_index(spark: SparkSession, path: str, min_valid: int = 20, min_clear: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Usable rows that have an NDVI, and all periods (uid, ord) of each document, usable or not."""
    docs = spark.read.schema(SERIES_SCHEMA).option("multiLine", True).json(path).withColumn("_file", F.input_file_name())
    uid = F.coalesce("site.uid", F.regexp_extract("_file", r"([^/]+)\.json$", 1))
    rows = docs.select(uid.alias("uid"), F.explode("series").alias("r")).select("uid", "r.*").withColumn("ord", ordinal_of_name(F.col("period")))
    return quality_filter(rows, min_valid, min_clear).where("ndvi is not null"), rows.select("uid", "ord").distinct()


def quality_filter(rows: DataFrame, min_valid: int = 20, min_clear: float = 0.6) -> DataFrame:
    return rows.where((F.col("n_valid") >= min_valid) & (F.coalesce("clear_frac", "valid_frac", F.lit(0.0)) >= min_clear))


def parse_stats_key(key: Column) -> list[Column]:
    """source, uid, start, end of ``src:uid|start|end``."""
    return [F.regexp_extract(key, r"^([^:]*):([^|]*)\|([^|]*)\|(.*)$", i).alias(n) for i, n in enumerate(("source", "uid", "start", "end"), 1)]


def cache_rows(cache: DataFrame, source: str = "parcel") -> DataFrame:
    """uid, ord, value of the cache's entries (key, value as JSON text) from one source; empty values hold nothing."""
    empty = F.trim("value").isin("", "null", "{}", "[]", "0", "0.0", "false", '""')
    d = cache.where(F.col("value").isNotNull() & ~empty).select(*parse_stats_key(F.col("key")), "value").where(F.col("source") == source)
    return d.select("uid", ordinal_of_date(lenient_date(F.col("start"))).alias("ord"), "value")


def whole_date(text: Column) -> Column:
    """A text that is an ISO date and nothing else (``2024-02-29`` or ``20240229``, spaces around it), else null."""
    t = F.trim(text)
    plain = F.when(t.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    return F.when(F.substring(plain, 1, 4) != "0000", plain.try_cast("date"))


def quarantine(truth: DataFrame, today: str = "2026-09-03", years=(2015, 2027), strict: bool = True, margin: int = 2) -> DataFrame:
    """Adds day, ord and the reason a date is not used (null: used). Years are inclusive.

    ``strict`` also drops starts after ``today`` and those so late that ``margin`` periods after them are not seen yet.
    """
    d = truth.withColumn("day", whole_date(F.col("date"))).withColumn("ord", ordinal_of_date(F.col("day")))
    reason = F.when(F.col("day").isNull(), "unparseable").when(~F.year("day").between(years[0], years[1]), "impossible_year")
    if strict:
        last = F.lit(today).cast("date")
        reason = reason.when(F.col("day") > last, "future").when(F.col("ord") + margin > ordinal_of_date(last), "unobservable")
    return d.withColumn("reason", reason)


def quarantine_counts(quarantined: DataFrame) -> DataFrame:
    """reason, n; kept dates have the reason ``kept``."""
    return quarantined.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def merge_starts(truth: DataFrame, pseudo: DataFrame) -> DataFrame:
    """uid, start, is_pseudo: a verified start wins over a pseudo-start."""
    p = pseudo.select("uid", F.col("start").alias("_p"))
    return truth.join(p, "uid", "full").select("uid", F.coalesce("start", "_p").alias("start"), F.col("start").isNull().alias("is_pseudo"))


def link_union(*links: DataFrame) -> DataFrame:
    """Distinct (unit, parcel) pairs of link tables whose columns come in any order; incomplete rows go."""
    out = links[0].select("unit", "parcel")
    for x in links[1:]:
        out = out.unionByName(x.select("unit", "parcel"))
    return out.na.drop().distinct()


def class_guard(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Problems as rows (problem, uid): pseudo-starts among positives, unflagged negatives, uids in both."""
    row = lambda d, text: d.select(F.lit(text).alias("problem"), "uid")
    both = positives.select("uid").intersect(negatives.select("uid"))
    return row(positives.where("is_pseudo"), "pseudo-start among positives").union(row(negatives.where("not is_pseudo"), "negative without a pseudo-start")).union(row(both, "in both classes"))


#: Plausible sizes of a parcel, and the side of the box that stands in for one.
LEAST_M2, MOST_M2, BOX_M = 5000.0, 25e6, 750.0


def build_sites(
    buildings: DataFrame, stages: list[str], parcels: DataFrame | None = None, every: bool = False, confirmed_only: bool = False, least: float = LEAST_M2, most: float = MOST_M2, box: float = BOX_M
) -> DataFrame:
    """One row a campus that is in scope: its mean coordinates, its representative building, and the area that stands for it.

    ``buildings``: campus_uid, building_uid, stage, lat, lon, exact, campus_name, building_name, provider, state (all text) and ``row``, their order.
    ``parcels(uid, n_parcels, parcel_m2)`` as from ``unit_parcels``; a site without a plausible one has a box.
    A campus is in scope if any of its buildings is at one of the stages (``every``: all of them) and any has coordinates. Its
    representative is the first building in scope with an exact location, else the first in scope.
    ``confirmed_only`` leaves out boxes around coordinates that are not confirmed.
    """
    named = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    b = buildings.withColumn("uid", F.coalesce(named("campus_uid"), named("building_uid"))).where("uid is not null")
    number = lambda c: F.col(c).cast("string").try_cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    b = b.withColumns({"_lat": number("lat"), "_lon": number("lon"), "_fits": F.lower(clean_cell(F.col("stage"))).isin(*stages), "_exact": F.upper(F.trim(F.coalesce("exact", F.lit("")))) == "Y"})
    placed = finite(F.col("_lat")) & finite(F.col("_lon"))
    facts = F.struct(*[clean_cell(F.col(c)).alias(c) for c in ("campus_uid", "campus_name", "building_name", "provider", "state", "stage")])
    first = F.when(F.col("_fits"), F.struct((~F.col("_exact")).alias("k"), F.col("row")))
    s = b.groupBy("uid").agg(
        F.count("*").alias("n_buildings"), F.count_if("_fits").alias("n_eligible"), F.avg(F.when(placed, F.col("_lat"))).alias("lat"), F.avg(F.when(placed, F.col("_lon"))).alias("lon"),
        F.min_by(facts, first).alias("rep"), F.bool_or(F.col("_fits") & F.col("_exact")).alias("coord_confirmed"),
    )
    s = s.where((F.col("n_eligible") == F.col("n_buildings") if every else F.col("n_eligible") > 0) & F.col("lat").isNotNull())
    title = F.coalesce(F.nullif("rep.campus_name", F.lit("")), F.nullif("rep.building_name", F.lit("")), F.concat(F.lit("Site "), F.left("uid", F.lit(8))))
    s = s.withColumns(
        {"unit_type": F.when(F.col("rep.campus_uid") != "", "campus").otherwise("building"), "name": title, "provider": F.col("rep.provider"), "state": F.col("rep.state"), "stage": F.col("rep.stage"),
         "mixed_stage": F.col("n_eligible") < F.col("n_buildings")}
    ).drop("rep")
    if parcels is None:
        s = s.withColumns({"n_parcels": F.lit(0).cast("long"), "parcel_m2": F.lit(None).cast("double")})
    else:
        s = s.join(parcels.select("uid", "n_parcels", "parcel_m2"), "uid", "left").withColumn("n_parcels", F.coalesce("n_parcels", F.lit(0).cast("long")))
    m2 = F.col("parcel_m2")
    why = (
        F.when(m2 > most, F.concat(F.lit("parcel "), fixed(m2 / 1e6, 1), F.lit(f" km2 > {most / 1e6} km2")))
        .when(m2 < least, F.concat(F.lit("parcel "), fixed(m2, 0), F.lit(f" m2 < {least:.0f} m2")))
    )
    s = s.withColumn("reject_reason", F.when(F.col("n_parcels") > 0, why))
    source = F.when(F.col("reject_reason").isNotNull(), "box_parcel_rejected").when(F.col("n_parcels") > 1, "parcel_union").when(F.col("n_parcels") == 1, "parcel").otherwise("box_no_parcel")
    s = s.withColumn("aoi_source", source).withColumn("area_m2", F.when(source.startswith("parcel"), m2).otherwise(box * box))
    return s.where(F.col("coord_confirmed") | F.col("aoi_source").startswith("parcel")) if confirmed_only else s


def unit_parcels(links: DataFrame, parcels: DataFrame) -> DataFrame:
    """uid, n_parcels, parcel_m2, parts: the parcels that each unit's links name, together. ``parcels(parcel, m2, parts)``.

    The area is the sum of the parcels': ground that two of them share counts twice.
    """
    d = links.select(F.col("unit").alias("uid"), "parcel").distinct().join(parcels, "parcel")
    return d.groupBy("uid").agg(F.count("*").alias("n_parcels"), F.sum("m2").alias("parcel_m2"), F.flatten(F.collect_list(F.coalesce("parts", F.array().cast("array<array<array<array<double>>>>")))).alias("parts"))


def _upper_median(sites: DataFrame, which: Column, name: str) -> DataFrame:
    """One row: the value at place n // 2 of the sorted areas, without gathering them."""
    d = sites.where(which).select("area_m2")
    n = d.count()
    at = d.orderBy("area_m2").offset(n // 2).limit(1)
    return d.sparkSession.range(1).join(at.select(F.lit(0).alias("id"), F.col("area_m2").alias(name)), "id", "left").drop("id")


def portfolio(sites: DataFrame) -> DataFrame:
    """One row about all sites: how many have a parcel or a box, shares in percent, the upper median of their areas, and how many are doubtful."""
    parcel = F.col("aoi_source").startswith("parcel")
    s = sites.agg(
        F.count("*").alias("n"), F.count_if(parcel).alias("with_parcel"), F.count_if(~parcel).alias("with_box"), F.count_if(F.col("aoi_source") == "box_no_parcel").alias("no_parcel"),
        F.count_if(F.col("aoi_source") == "box_parcel_rejected").alias("parcel_rejected"), F.count_if(F.col("aoi_source") == "parcel_union").alias("unions"),
        F.count_if(~F.col("coord_confirmed")).alias("unconfirmed"), F.count_if(~F.col("coord_confirmed") & ~parcel).alias("unconfirmed_box"), F.count_if("mixed_stage").alias("mixed"),
        (F.coalesce(F.sum("area_m2"), F.lit(0.0)) / 1e6).alias("total_km2"),
    )
    most = F.greatest(F.lit(1), F.col("n"))
    s = s.withColumns({"parcel_pct": 100 * F.col("with_parcel") / most, "box_pct": 100 * F.col("with_box") / most})
    return s.join(_upper_median(sites, parcel, "median_parcel_m2")).join(_upper_median(sites, ~parcel, "median_box_m2"))


def largest_sites(sites: DataFrame, k: int, only: str | None = None) -> DataFrame:
    """The k sites of largest area, of one kind of area (``parcel`` or ``box``) or of both."""
    d = sites if only is None else sites.where(F.col("aoi_source").startswith("parcel") == F.lit(only == "parcel"))
    return d.orderBy(F.col("area_m2").desc(), "uid").limit(k)


LABEL_COLUMNS = (
    "uid slug name state area_ha n_buildings cls start_period start_is_pseudo review_type period offset n_valid clear_frac rmse "
    "vegetation soil high_albedo low_albedo ndvi ndbi swir soil_area_m2 high_albedo_area_m2 chip"
).split()


def labeling_rows(series: DataFrame, sites: DataFrame, types: DataFrame, chips: DataFrame, min_valid: int = 20) -> DataFrame:
    """One row for each usable period of a site, in the 25 columns of the labeling set.

    ``series(uid, ord, n_valid, clear_frac, valid_frac, rmse, ...)``; ``sites(uid, slug, name, state, area_ha, n_buildings, cls, start, start_is_pseudo)``;
    ``types(uid, review_type)`` and ``chips(uid, ord, chip)`` where there are any.
    """
    d = series.where(F.coalesce("n_valid", F.lit(0)) >= min_valid).join(sites, "uid").join(types, "uid", "left").join(chips, ["uid", "ord"], "left")
    five = [F.bround(c, 5).alias(c) for c in ("vegetation", "soil", "high_albedo", "low_albedo", "ndvi", "ndbi", "swir", "soil_area_m2", "high_albedo_area_m2")]
    return d.select(
        "uid", "slug", "name", F.coalesce("state", F.lit("")).alias("state"), F.bround(F.coalesce("area_ha", F.lit(0.0)), 2).alias("area_ha"), "n_buildings", "cls",
        period_name(F.col("start")).alias("start_period"), F.coalesce("start_is_pseudo", F.lit(False)).alias("start_is_pseudo"), F.coalesce("review_type", F.lit("")).alias("review_type"),
        period_name(F.col("ord")).alias("period"), (F.col("ord") - F.col("start")).alias("offset"), "n_valid", F.bround(F.coalesce("clear_frac", "valid_frac", F.lit(0.0)), 4).alias("clear_frac"),
        F.bround(F.coalesce("rmse", F.lit(0.0)), 5).alias("rmse"), *five, F.coalesce("chip", F.lit("")).alias("chip"),
    )


def labeling_counts(rows: DataFrame) -> DataFrame:
    """cls, campuses, rows, with_chip, reviewed of a labeling set."""
    has = lambda c: F.count_if(F.col(c) != "")
    return rows.groupBy("cls").agg(F.count_distinct("uid").alias("campuses"), F.count("*").alias("rows"), has("chip").alias("with_chip"), has("review_type").alias("reviewed"))


def viewer_rows(series: DataFrame, min_valid: int = 20) -> DataFrame:
    """uid, x, period and the rounded values of each row, x from the site's first period; rows with too few pixels only have their place."""
    first = Window.partitionBy("uid")
    enough = F.coalesce("n_valid", F.lit(0)) >= min_valid
    r = lambda c, n, k=1.0: F.when(enough, F.bround(F.col(c) / k, n))
    return series.select(
        "uid", (F.col("ord") - F.min("ord").over(first)).alias("x"), period_name(F.col("ord")).alias("p"), r("valid_frac", 3).alias("v"), r("vegetation", 4).alias("veg"), r("soil", 4).alias("soil"),
        r("high_albedo", 4).alias("high"), r("low_albedo", 4).alias("low"), r("soil_area_m2", 2, 1e4).alias("sha"), r("high_albedo_area_m2", 2, 1e4).alias("hha"), r("ndvi", 4).alias("ndvi"),
        r("ndbi", 4).alias("ndbi"), r("swir", 4).alias("swir"), r("rmse", 4).alias("rmse"),
    )


def viewer_payload(rows: DataFrame) -> DataFrame:
    """uid and its rows in order, as one array."""
    return rows.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("x", *[c for c in rows.columns if c not in ("uid", "x")]))).alias("rows"))


def viewer_segments(rows: DataFrame, value: str, least: float = 0.45) -> DataFrame:
    """uid, segment, from_x, to_x, points: the pieces of a site's line, which breaks at periods without the value, missing, or with too few valid pixels."""
    own = Window.partitionBy("uid").orderBy("x")
    d = rows.where(F.col(value).isNotNull() & (F.coalesce("v", F.lit(0.0)) >= least))
    d = d.withColumn("_new", F.coalesce(F.col("x") - F.lag("x").over(own) > 1, F.lit(True)).cast("int")).withColumn("segment", F.sum("_new").over(own))
    return d.groupBy("uid", "segment").agg(F.min("x").alias("from_x"), F.max("x").alias("to_x"), F.count("*").alias("points"))


def stretch(values: DataFrame, column: str, lo: float = 0.02, hi: float = 0.98, gamma: float = 1.25) -> DataFrame:
    """Adds ``level`` 0-255: a percentile stretch fixed per site."""
    limits = values.groupBy("uid").agg(F.percentile(column, F.array(F.lit(lo), F.lit(hi))).alias("_q"))
    d = values.join(limits, "uid")
    unit = (F.col(column) - F.col("_q")[0]) / F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(1e-6))
    return d.withColumn("level", F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit)), F.lit(1 / gamma)) * 255).drop("_q")


#: Fixed value: the grey of a masked pixel in a chip.
MASKED = 26


def chip(levels: DataFrame, grid: DataFrame, height: int = 108) -> DataFrame:
    """uid, i, j, level (0-255): the picture of a site at a fixed height, each cell from the nearest pixel; pixels without a level are grey.

    ``levels(uid, y, x, level)``; ``grid(uid, width, height)``.
    """
    size = grid.select("uid", F.col("width").alias("_w"), F.col("height").alias("_h"), F.greatest(F.lit(1), F.bround(F.col("width") * height / F.col("height"))).cast("int").alias("_to"))
    cell = size.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_to") - 1)))
    cell = cell.select("uid", "i", "j", F.floor((F.col("i") + 0.5) * F.col("_h") / height).cast("int").alias("y"), F.floor((F.col("j") + 0.5) * F.col("_w") / F.col("_to")).cast("int").alias("x"))
    return cell.join(levels, ["uid", "y", "x"], "left").select("uid", "i", "j", F.coalesce(F.floor("level"), F.lit(MASKED)).cast("int").alias("level"))


def missing_jobs(jobs: DataFrame, done: DataFrame) -> DataFrame:
    return jobs.join(done, ["uid", "ord"], "left_anti")


def write_documents(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """One folder per site; CSV has a header."""
    writer = rows.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.partitionBy("uid").format(kind).save(path)


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
