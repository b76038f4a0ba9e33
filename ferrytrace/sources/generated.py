"""Deterministic test data made by Spark tasks from row ids.

Each value is integer arithmetic on the row's id, so any task can make any row and the result
does not depend on the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrytrace.functions.messages import make_header

# The countries with their weights (10 of 90 pass the default filter), centre
# coordinates and cities.
COUNTRIES = {
    "LU": (2, 49.6, 6.1, ["Luxembourg", "Esch-sur-Alzette", "Differdange"]),
    "DE": (5, 51.2, 10.4, ["Berlin", "Munich", "Hamburg", "Frankfurt", "Stuttgart", "Cologne",
                           "Dortmund", "Essen", "Leipzig", "Dresden"]),
    "BE": (3, 50.8, 4.4, ["Brussels", "Antwerp", "Ghent", "Liege"]),
    "FR": (15, 46.6, 2.2, ["Paris", "Lyon", "Marseille", "Toulouse", "Nice", "Bordeaux",
                           "Strasbourg", "Lille", "Nantes", "Montpellier"]),
    "NL": (10, 52.1, 5.3, ["Amsterdam", "Rotterdam", "The Hague", "Utrecht", "Eindhoven"]),
    "IT": (15, 42.5, 12.5, ["Rome", "Milan", "Naples", "Turin", "Florence", "Bologna"]),
    "ES": (15, 40.4, -3.7, ["Madrid", "Barcelona", "Valencia", "Seville", "Bilbao"]),
    "PL": (13, 52.0, 19.0, ["Warsaw", "Krakow", "Gdansk", "Wroclaw", "Poznan"]),
    "CZ": (7, 49.8, 15.5, ["Prague", "Brno", "Ostrava"]),
    "AT": (5, 47.5, 13.6, ["Vienna", "Graz", "Linz", "Salzburg"]),
}
DEFAULT_COUNTRIES = ["LU", "DE", "BE"]

# Pollutant, unit, smallest and largest value.
POLLUTANTS = [
    ("PM10", "µg/m³", 5, 120),
    ("PM2.5", "µg/m³", 2, 80),
    ("NO2", "µg/m³", 5, 200),
    ("O3", "µg/m³", 10, 250),
    ("SO2", "µg/m³", 1, 100),
    ("CO", "mg/m³", 0.1, 10.0),
]

# First hour (2024-01-01 UTC), hours before it wraps, bytes per CSV row, stations.
FIRST_HOUR = 1704067200
HOURS = 8760
ROW_BYTES = 64
STATIONS = 500

# Station number ranges of the compact line format, and its header values.
COMPACT_STATIONS = {"LU": 5, "DE": 50, "BE": 20}
COMPACT_SOURCE = "eea_filtered"

# Our own arithmetic: two rounds of multiply (mod 2^31) and fold the upper bits onto the lower.
MODULUS = 2147483648
FIRST_MULTIPLIER = 1103515245
SECOND_MULTIPLIER = 1597334677
STREAM_STEP = 362437


def rows_for_size(gigabytes: float) -> int:
    return int(gigabytes * 1024**3 / ROW_BYTES)


def _fold(number: Column, bits: int) -> Column:
    return number.bitwiseXOR(F.shiftright(number, bits))


def draw(row_id: Column, stream: int, size: int | Column) -> Column:
    """A number in ``[0, size)`` from the id; each ``stream`` gives another sequence."""
    start = F.pmod(row_id, F.lit(MODULUS)) * F.lit(FIRST_MULTIPLIER)
    once = _fold(F.pmod(start + F.lit(STREAM_STEP * stream), F.lit(MODULUS)), 15)
    twice = _fold(F.pmod(once * F.lit(SECOND_MULTIPLIER), F.lit(MODULUS)), 13)
    return F.pmod(twice, size if isinstance(size, Column) else F.lit(size))


def _lookup(key: Column, table: dict) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), key)


def _country(row_id: Column) -> Column:
    number = draw(row_id, 1, sum(weight for weight, *_ in COUNTRIES.values()))
    upto = 0
    chosen = None
    for code, (weight, *_) in COUNTRIES.items():
        upto += weight
        chosen = (F.when if chosen is None else chosen.when)(number < upto, F.lit(code))
    return chosen


def _city(row_id: Column, country: Column) -> Column:
    cities = F.create_map(
        *[
            part
            for code, (_, _, _, names) in COUNTRIES.items()
            for part in (F.lit(code), F.array(*[F.lit(n) for n in names]))
        ]
    )
    of_country = F.element_at(cities, country)
    return F.get(of_country, draw(row_id, 2, F.size(of_country)).cast("int"))


def _near(row_id: Column, stream: int, centre: Column) -> Column:
    """Up to two degrees around the centre, to a thousandth."""
    thousandths = F.round(centre * 1000).cast("long") + draw(row_id, stream, 4001) - 2000
    return thousandths / F.lit(1000.0)


def readings(ids: DataFrame, row_id: str = "id") -> DataFrame:
    """One reading per id."""
    i = F.col(row_id)
    kinds = F.array(
        *[
            F.struct(
                F.lit(name).alias("pollutant"),
                F.lit(unit).alias("unit"),
                F.lit(round(low * 100)).alias("low"),
                F.lit(round(high * 100)).alias("high"),
            )
            for name, unit, low, high in POLLUTANTS
        ]
    )
    picked = ids.select(
        i.alias("_id"),
        _country(i).alias("country"),
        F.get(kinds, draw(i, 5, len(POLLUTANTS)).cast("int")).alias("_kind"),
    )
    i = F.col("_id")
    low, high = F.col("_kind.low"), F.col("_kind.high")
    latitude = _lookup(F.col("country"), {c: lat for c, (_, lat, _, _) in COUNTRIES.items()})
    longitude = _lookup(F.col("country"), {c: lon for c, (_, _, lon, _) in COUNTRIES.items()})
    station = F.lpad((draw(i, 7, STATIONS) + 1).cast("string"), 4, "0")
    return picked.select(
        F.concat_ws("-", F.lit("STA"), "country", station).alias("station_id"),
        (F.lit(FIRST_HOUR) + F.pmod(i, F.lit(HOURS)) * 3600).alias("timestamp"),
        "country",
        _city(i, F.col("country")).alias("city"),
        _near(i, 3, latitude).alias("latitude"),
        _near(i, 4, longitude).alias("longitude"),
        F.col("_kind.pollutant").alias("pollutant"),
        ((low + draw(i, 6, high - low + 1)) / F.lit(100.0)).alias("value"),
        F.col("_kind.unit").alias("unit"),
    )


def readings_of_size(spark: SparkSession, gigabytes: float) -> DataFrame:
    return readings(spark.range(rows_for_size(gigabytes)))


def selectivity_report(generated: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """Rows, rows passing the filter, their share in percent and estimated MiB."""
    kept = F.count_if(F.col("country").isin(countries or DEFAULT_COUNTRIES))
    counted = generated.agg(F.count(F.lit(1)).alias("records"), kept.alias("passing"))
    share = F.coalesce(F.try_divide(F.col("passing") * 100.0, F.col("records")), F.lit(0.0))
    size = F.col("passing") * F.lit(float(ROW_BYTES)) / F.lit(1048576.0)
    return counted.withColumn("passing_pct", F.round(share, 4)).withColumn(
        "estimated_mb", F.round(size, 4)
    )


def json_payload(ids: DataFrame, record_bytes: int, made_at: int, row_id: str = "id") -> DataFrame:
    """JSON records of about ``record_bytes`` bytes: id, time and a filler of letters and digits."""
    i = F.col(row_id)
    length = max(0, record_bytes - 60)
    blocks = F.sequence(F.lit(0), F.lit(max(0, -(-length // 64) - 1)))
    filler = F.array_join(F.transform(blocks, lambda n: F.sha2(F.concat_ws("-", i, n), 256)), "")
    record = F.struct(
        (draw(i, 1, 1_000_000) + 1).alias("id"),
        F.lit(made_at).cast("long").alias("timestamp"),
        F.substring(filler, 1, length).alias("data"),
    )
    return ids.select(i.alias("row_id"), F.to_json(record).alias("value"))


def fixed_bytes(ids: DataFrame, record_bytes: int, row_id: str = "id") -> DataFrame:
    """Records of exactly ``record_bytes`` bytes."""
    i = F.col(row_id)
    return ids.select(i.alias("row_id"), F.rpad(i.cast("string"), record_bytes, "x").alias("value"))


def compact_lines(ids: DataFrame, produced_ms: Column, row_id: str = "id") -> DataFrame:
    """Eight-field lines of the filtered countries, with produce time and source as headers."""
    i = F.col(row_id)
    country = F.get(
        F.array(*[F.lit(c) for c in COMPACT_STATIONS]), draw(i, 1, len(COMPACT_STATIONS)).cast("int")
    )
    names = F.array(*[F.lit(name) for name, *_ in POLLUTANTS])
    stations = _lookup(F.col("country"), COMPACT_STATIONS)
    number = F.lpad((draw(i, 2, stations) + 1).cast("string"), 4, "0")
    luxembourg = F.concat(F.lit("LU010"), (draw(i, 2, stations) + 1).cast("string"), F.lit("A"))
    station = F.when(F.col("country") == "LU", luxembourg).otherwise(
        F.concat("country", number, F.lit("A"))
    )

    def two(number: Column) -> Column:
        return F.lpad(number.cast("string"), 2, "0")

    date = F.concat_ws("-", F.lit("2024"), two(draw(i, 4, 12) + 1), two(draw(i, 5, 28) + 1))
    clock = F.concat_ws(":", two(draw(i, 6, 24)), two(draw(i, 7, 60)), F.lit("00"))
    line = F.concat_ws(
        ",",
        "country",
        station,
        F.get(names, draw(i, 3, len(POLLUTANTS)).cast("int")),
        F.concat_ws("T", date, clock),
        ((draw(i, 8, 19901) + 100) / F.lit(100.0)).cast("string"),
        F.lit("µg/m³"),
        draw(i, 9, 3) + 1,
        draw(i, 10, 3) + 1,
    )
    headers = F.array(
        make_header("ts_produce", produced_ms.cast("string")),
        make_header("ds", F.lit(COMPACT_SOURCE)),
    )
    return ids.withColumn("country", country).select(
        i.alias("row_id"), line.alias("value"), headers.alias("headers")
    )
