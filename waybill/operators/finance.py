"""Profit, fuel and mileage: daily summaries, period totals, trends, fleet efficiency, log validation and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.semantics import ISO_DATE, blank_to_null, csv_cell, round_half_up
from waybill.operators.joins import first_contained

DEFAULT_FEE_CENTS = 1_500_000
DEFAULT_VEHICLE = "unassigned"


def order_fees(orders: DataFrame, fees: DataFrame, default_cents: int = DEFAULT_FEE_CENTS) -> DataFrame:
    """Adds district, configured_cents and revenue_cents: a saved positive fee, else that of the first district found in
    the address, else the default. A configured fee of zero counts."""
    found = first_contained(orders, F.col("address"), fees.withColumnRenamed("fee_cents", "configured_cents"), "district", "configured_cents", "ord")
    fee = F.when(F.col("fee_cents") > 0, F.col("fee_cents")).otherwise(F.coalesce("configured_cents", F.lit(default_cents)))
    return found.withColumn("revenue_cents", fee.cast("long"))


def daily_profit(orders: DataFrame, fuel: DataFrame, fees: DataFrame, default_cents: int = DEFAULT_FEE_CENTS) -> DataFrame:
    """Revenue, fuel, net and number of deliveries by date, whatever the status; dates of either side.

    Both sides are reduced before they meet: one union and one aggregation instead of a full outer join.
    """
    income = order_fees(orders.where("service_date is not null and service_date <> ''"), fees, default_cents).select(F.col("service_date").alias("date"), "revenue_cents", F.lit(0).cast("long").alias("fuel_cents"), F.lit(1).cast("long").alias("deliveries"))
    cost = fuel.select("date", F.lit(0).cast("long").alias("revenue_cents"), F.col("amount_cents").alias("fuel_cents"), F.lit(0).cast("long").alias("deliveries"))
    return (
        income.unionByName(cost)
        .groupBy("date")
        .agg(F.sum("revenue_cents").alias("revenue_cents"), F.sum("fuel_cents").alias("fuel_cents"), F.sum("deliveries").alias("deliveries"))
        .withColumn("net_cents", F.col("revenue_cents") - F.col("fuel_cents"))
    )


def calendar_days(daily: DataFrame) -> DataFrame:
    return daily.withColumn("has_revenue", F.col("revenue_cents") > 0).withColumn("has_fuel", F.col("fuel_cents") > 0)


def period_total(daily: DataFrame) -> DataFrame:
    """One row, zero for an empty period."""
    return daily.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("revenue_cents", "fuel_cents", "net_cents", "deliveries")])


def trend(daily: DataFrame, today: str, n: int = 8) -> DataFrame:
    """The last n dates up to today on which anything happened, with a MM/DD label."""
    active = daily.where((F.col("date") <= today) & ((F.col("deliveries") > 0) | (F.col("fuel_cents") > 0)))
    return active.orderBy(F.desc("date")).limit(n).select("date", F.replace(F.substring("date", 6, 5), F.lit("-"), F.lit("/")).alias("label"), "net_cents").orderBy("date")


def csv_rows(daily: DataFrame) -> DataFrame:
    """Rows of the export: all, ord, line, to be written by (all, ord). The total comes from a rollup over the dates."""
    total = daily.rollup("date").agg(*[F.sum(c).alias(c) for c in ("revenue_cents", "fuel_cents", "net_cents", "deliveries")], F.grouping("date").alias("all"))
    cells = [F.when(F.col("all") == 1, F.lit("total")).otherwise(F.col("date")), *[F.col(c) for c in ("revenue_cents", "fuel_cents", "net_cents", "deliveries")]]
    lines = total.select("all", F.col("date").alias("ord"), F.concat_ws(",", *[csv_cell(c) for c in cells]).alias("line"))
    # an empty table still has a total
    return lines.where("all = 0 or line is not null")


def _efficiency(df: DataFrame) -> DataFrame:
    km = F.col("distance_cm") / 100.0
    return df.withColumn("km_per_liter", F.when(F.col("liters") > 0, round_half_up(km / F.col("liters"), 1))).withColumn("cents_per_km", F.when(F.col("distance_cm") > 0, round_half_up(F.col("fuel_cents") / km)))


def _both_logs(fuel: DataFrame, mileage: DataFrame, default_label: str) -> DataFrame:
    name = F.coalesce(blank_to_null(F.col("vehicle")), F.lit(default_label)).alias("vehicle")
    left = fuel.select(name, F.lit(0).cast("long").alias("distance_cm"), F.coalesce("liters", F.lit(0.0)).alias("liters"), F.coalesce("amount_cents", F.lit(0)).cast("long").alias("fuel_cents"))
    right = mileage.select(name, F.coalesce("distance_cm", F.lit(0)).cast("long").alias("distance_cm"), F.lit(0.0).alias("liters"), F.lit(0).cast("long").alias("fuel_cents"))
    return left.unionByName(right)


def efficiency(fuel: DataFrame, mileage: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distance_cm", "liters", "fuel_cents")]
    return _efficiency(_both_logs(fuel, mileage, DEFAULT_VEHICLE).agg(*sums))


def efficiency_by_vehicle(fuel: DataFrame, mileage: DataFrame, default_label: str = DEFAULT_VEHICLE) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("distance_cm", "liters", "fuel_cents")]
    return _efficiency(_both_logs(fuel, mileage, default_label).groupBy("vehicle").agg(*sums))


def _errors(*checks: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]), lambda x: x.isNotNull())


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))


def validate_fuel(logs: DataFrame) -> DataFrame:
    """Adds errors: texts of the rules that a fuel log (date, liters, price_per_liter, amount, odometer_km) breaks."""
    priced = (_finite(F.col("price_per_liter")) & (F.col("price_per_liter") > 0)) | (_finite(F.col("amount")) & (F.col("amount") > 0))
    return logs.withColumn(
        "errors",
        _errors(
            (~F.coalesce(F.col("date").rlike(ISO_DATE), F.lit(False)), "Fuel date must be YYYY-MM-DD."),
            (~F.coalesce(_finite(F.col("liters")) & (F.col("liters") > 0), F.lit(False)), "Fuel liters must be greater than 0."),
            (~F.coalesce(priced, F.lit(False)), "Either price per liter or total amount is required."),
            (F.coalesce(F.col("odometer_km") < 0, F.lit(False)), "Odometer must be 0 or greater."),
        ),
    )


def build_fuel(logs: DataFrame) -> DataFrame:
    """Valid fuel logs with their money resolved: the amount wins; without a price it is derived to one place."""
    has_amount = F.coalesce(F.col("amount") > 0, F.lit(False))
    amount = F.when(has_amount, round_half_up(F.col("amount"))).otherwise(round_half_up(F.coalesce("price_per_liter", F.lit(0.0)) * F.col("liters")))
    price = (
        F.when(has_amount & (F.col("price_per_liter") > 0), round_half_up(F.col("price_per_liter")))
        .when(has_amount, round_half_up(round_half_up(F.col("amount")) / F.col("liters"), 1))
        .otherwise(F.coalesce("price_per_liter", F.lit(0.0)))
    )
    return validate_fuel(logs).where(F.size("errors") == 0).select(
        "id", "date", "liters", price.alias("price_per_liter"), amount.alias("amount"), F.coalesce("odometer_km", F.lit(0.0)).alias("odometer_km"), blank_to_null(F.col("vehicle")).alias("vehicle")
    )


def validate_mileage(logs: DataFrame) -> DataFrame:
    return logs.withColumn(
        "errors",
        _errors(
            (~F.coalesce(F.col("date").rlike(ISO_DATE), F.lit(False)), "Mileage date must be YYYY-MM-DD."),
            (~F.coalesce(_finite(F.col("odometer_km")) & (F.col("odometer_km") >= 0), F.lit(False)), "Odometer must be 0 or greater."),
            (F.col("daily_distance_km").isNotNull() & ~(_finite(F.col("daily_distance_km")) & (F.col("daily_distance_km") >= 0)), "Daily distance must be 0 or greater."),
        ),
    )


def build_mileage(logs: DataFrame) -> DataFrame:
    return validate_mileage(logs).where(F.size("errors") == 0).select("id", "date", "odometer_km", F.coalesce("daily_distance_km", F.lit(0.0)).alias("daily_distance_km"), blank_to_null(F.col("vehicle")).alias("vehicle"))


def day_totals(fuel: DataFrame, mileage: DataFrame) -> DataFrame:
    """Fuel and mileage of each day with numbers of logs."""
    both = fuel.select("date", F.col("amount_cents").alias("f"), F.lit(1).alias("nf"), F.lit(0).alias("m"), F.lit(0).alias("nm")).unionByName(mileage.select("date", F.lit(0).alias("f"), F.lit(0).alias("nf"), F.col("distance_cm").alias("m"), F.lit(1).alias("nm")))
    return both.groupBy("date").agg(F.sum("f").cast("long").alias("fuel_cents"), F.sum("nf").cast("long").alias("fuel_logs"), F.sum("m").cast("long").alias("distance_cm"), F.sum("nm").cast("long").alias("mileage_logs"))
