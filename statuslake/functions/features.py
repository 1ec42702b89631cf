"""Feature operators: nested records to flat columns, without user code."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalar as S


def microsoft_age(sources: Column, reference: Column) -> Column:
    """Whole days since the newest Microsoft update; -1 if there is none."""
    times = F.transform(F.filter(sources, lambda s: F.lower(s["dataset"]) == "microsoft"), lambda s: S.iso_timestamp(s["update_time"]))
    return F.coalesce(S.whole_days(F.array_max(times), reference), F.lit(-1)).cast("double")


def source_ages(sources: Column, reference: Column) -> Column:
    """Whole days since the update of every source but meta that has a readable time."""
    other = F.filter(sources, lambda s: F.lower(F.coalesce(s["dataset"], F.lit(""))) != "meta")
    return F.filter(F.transform(other, lambda s: S.whole_days(S.iso_timestamp(s["update_time"]), reference)), lambda d: d.isNotNull())


def address_completeness(addresses: str) -> Column:
    """Share of street, locality, postcode and region filled in the first address."""
    total = F.lit(0)
    for part in ("freeform", "locality", "postcode", "region"):
        total = total + F.when(F.coalesce(S.first_of(addresses, part), F.lit("")) != "", 1).otherwise(0)
    return total / F.lit(4.0)


def place_features(places: DataFrame, reference: str) -> DataFrame:
    """id, operating_status and the 27 features of a place."""
    at = F.lit(reference).cast("timestamp")
    src = F.coalesce("sources", F.array().cast(dict(places.dtypes)["sources"]))
    names = F.transform(src, lambda s: F.lower(F.coalesce(s["dataset"], F.lit(""))))
    conf = F.filter(F.transform(src, lambda s: s["confidence"]), lambda x: x.isNotNull())
    total = F.aggregate(conf, F.lit(0.0), lambda a, x: a + x)
    base = places.withColumns({"_n": F.size(src), "_names": names, "_conf": conf, "_mean": F.coalesce(F.try_divide(total, F.size(conf)), F.lit(0.0)), "_age": microsoft_age(src, at), "_ages": source_ages(src, at)})
    meta, micro = (F.array_contains("_names", x).cast("int") for x in ("meta", "microsoft"))
    web, phone, social, brand = S.filled("websites"), S.filled("phones"), S.filled("socials"), F.col("brand").isNotNull().cast("int")
    low, high = F.coalesce(F.array_min("_conf"), F.lit(0.0)), F.coalesce(F.array_max("_conf"), F.lit(0.0))
    alternates = F.coalesce(F.size("categories.alternate"), F.lit(0))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    return base.select(
        "id", "operating_status", F.col("_n").alias("source_count"), meta.alias("has_meta"), micro.alias("has_microsoft"),
        ((F.col("_n") > 0) & F.forall("_names", lambda x: x == "meta")).cast("int").alias("has_only_meta"), high.alias("max_source_confidence"), low.alias("min_source_confidence"),
        F.col("_mean").alias("mean_source_confidence"), (high - low).alias("confidence_spread"), F.col("_age").alias("msft_update_age_days"), F.col("_age").between(0, 365).cast("int").alias("msft_fresh"),
        F.size("_ages").alias("n_sources_with_update_time"), F.coalesce(F.array_min("_ages"), F.lit(-1)).cast("double").alias("min_update_age_days"), F.coalesce(F.array_max("_ages"), F.lit(-1)).cast("double").alias("max_update_age_days"),
        (F.col("_mean") * F.col("_n")).alias("conf_x_source"), (F.col("_n") == 1).cast("int").alias("has_single_source"), web.alias("has_website"), phone.alias("has_phone"), social.alias("has_socials"), brand.alias("has_brand"),
        count("websites").alias("website_count"), count("phones").alias("phone_count"), ((web + phone + social + brand) / F.lit(4.0)).alias("completeness_score"),
        S.or_default(F.col("categories.primary"), F.lit("unknown"), F.lit("")).alias("primary_category"), (alternates > 0).cast("int").alias("has_alternate_categories"), alternates.alias("alternate_category_count"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), address_completeness("addresses").alias("address_completeness"))


def registry_labels(registry: DataFrame, reference: str) -> DataFrame:
    """Adds closed_a (business end reached), closed_b (or closed by the office), closed_c (location end), closed_d (any)."""
    day = F.lit(reference).cast("timestamp").cast("date")
    reached = lambda c: F.coalesce(F.col(c) <= day, F.lit(False))
    admin = ~S.is_blank(F.col("admin_closed"))
    return registry.withColumns({"closed_a": reached("end_day"), "closed_b": reached("end_day") | admin, "closed_c": reached("location_end_day"), "closed_d": reached("end_day") | admin | reached("location_end_day")})


def registry_features(registry: DataFrame, reference: str) -> DataFrame:
    """Ten numeric features and one categorical feature of a registry record; none is drawn from end dates."""
    at = F.lit(reference).cast("timestamp")
    city = S.clean_text(F.col("city"))
    present = lambda c: (~S.is_blank(F.col(c))).cast("int")
    return registry_labels(registry, reference).select(
        "certificate", S.age_days(F.col("start_day").cast("timestamp"), at, 0.0).alias("age_days"), F.length("dba_name").alias("name_length"), F.size(F.split("dba_name", " ")).alias("name_words"),
        present("naics").alias("has_naics"), present("city").alias("has_city"), F.coalesce(city == "san francisco", F.lit(False)).cast("int").alias("in_city"),
        (F.lower("parking_tax") == "true").cast("int").alias("parking_tax"), F.coalesce(F.year("start_day"), F.lit(0)).alias("start_year"), F.coalesce(F.month("start_day"), F.lit(0)).alias("start_month"), F.coalesce(F.dayofmonth("start_day"), F.lit(0)).alias("start_dom"),
        S.or_default(F.col("naics"), F.lit("unknown"), F.lit("")).alias("category"), (~F.col("closed_a")).cast("int").alias("open"))


def yelp_places(business: DataFrame) -> DataFrame:
    """Businesses in the shape of places: id, names, categories, confidence, addresses, operating_status, open."""
    parts = S.comma_list(F.col("categories"))
    return business.select(
        F.concat(F.lit("yelp:"), "business_id").alias("id"), F.struct(F.col("name").alias("primary")).alias("names"), F.struct(S.head(parts).alias("primary"), S.tail(parts).alias("alternate")).alias("categories"),
        S.review_confidence(F.col("review_count")).alias("confidence"), F.array(F.struct(F.col("state").alias("region"))).alias("addresses"), F.when(F.col("is_open") == 1, "open").otherwise("permanently_closed").alias("operating_status"), F.col("is_open").alias("open"))


@dataclass(frozen=True)
class FeatureSpec:
    """A source's features: names in canonical order and how to build them."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    confidence: tuple[str, ...]
    build: Callable[[DataFrame], DataFrame]

    def names(self, with_confidence: bool = False, exclude: tuple[str, ...] = ()) -> list[str]:
        chosen = [*self.numeric, *(self.confidence if with_confidence else ())]
        return [c for c in chosen if c not in exclude] + list(self.categorical)

    def select(self, rows: DataFrame, *keep: str, with_confidence: bool = False, exclude: tuple[str, ...] = ()) -> DataFrame:
        return self.build(rows).select(*keep, *self.names(with_confidence, exclude))


PLACE_SPEC = FeatureSpec(
    numeric=("source_count", "has_meta", "has_microsoft", "has_only_meta", "msft_update_age_days", "msft_fresh", "n_sources_with_update_time", "min_update_age_days", "max_update_age_days", "conf_x_source", "has_single_source", "has_website", "has_phone", "has_socials", "has_brand", "website_count", "phone_count", "completeness_score", "has_alternate_categories", "alternate_category_count", "address_completeness"),
    categorical=("primary_category",),
    confidence=("max_source_confidence", "min_source_confidence", "mean_source_confidence", "confidence_spread", "confidence"),
    build=lambda df: place_features(df, "2001-08-02 00:00:00"),
)
REGISTRY_SPEC = FeatureSpec(
    numeric=("age_days", "name_length", "name_words", "has_naics", "has_city", "in_city", "parking_tax", "start_year", "start_month", "start_dom"),
    categorical=("category",),
    confidence=(),
    build=lambda df: registry_features(df, "2001-08-02 00:00:00"),
)
