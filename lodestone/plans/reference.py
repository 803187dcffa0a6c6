"""Reference datasets: raw records to typed ones, their checks, and the suites that a raw batch must pass.

A dataset is declared: its columns over a raw record, hard checks by name, optional fields and its key.
conform() gives accepted rows and rejections, every raw record in one of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import checks, dedupe

C = F.col
ADDRESS = "struct<country:string,city:string,region:string,postalCode:string,addressLines:array<string>>"
LEI_RECORD = f"""struct<attributes:struct<lei:string,bic:string,entity:struct<legalName:struct<name:string>,legalAddress:{ADDRESS},headquartersAddress:{ADDRESS},legalForm:struct<id:string>,category:string,status:string,
 jurisdiction:string,creationDate:string>,registration:struct<initialRegistrationDate:string,lastUpdateDate:string,status:string,nextRenewalDate:string>>>"""
PLACE = "struct<type:string,id:string,lat:string,lon:string,timestamp:string,tags:map<string,string>>"
COUNTRY = "struct<cca2:string,cca3:string,ccn3:string,name:struct<common:string,official:string>,region:string,subregion:string,capital:array<string>,currencies:map<string,string>,independent:string,unMember:string>"
RATES = "struct<base:string,date:string,start_date:string,end_date:string,rates:map<string,string>>"


@dataclass(frozen=True)
class Dataset:
    name: str
    key: str
    columns: Mapping[str, Column]
    hard: Mapping[str, Column]
    optional: Sequence[str] = ()


def _needed(*names: str) -> dict[str, Column]:
    return {f"required_{n}": checks.required(C(n)) for n in names}


def _shape(name: str, pattern: str) -> dict[str, Column]:
    return {f"pattern_{name}": checks.matches(C(name), pattern)}


def strict_bool(c: Column) -> Column:
    """true and false as JSON has them; null for anything else."""
    return F.when(c == "true", True).when(c == "false", False)


def mcc() -> Dataset:
    text = {n: X.trim_or_null(C(r)) for n, r in {"mcc_code": "mcc", "description": "edited_description", "description_combined": "combined_description", "description_usda": "usda_description", "description_irs": "irs_description"}.items()}
    return Dataset("mcc", "mcc_code", text | {"irs_reportable": X.yes_no(C("irs_reportable"))}, _needed("mcc_code") | _shape("mcc_code", r"\d{4}$") | _needed("description"))


def card_issuer() -> Dataset:
    issuer = X.trim_or_null(C("Issuer"))
    columns = {"bin_range": X.trim_or_null(C("BIN")), "card_brand": X.trim_or_null(C("Brand")), "card_type": X.trim_or_null(C("Type")), "card_category": X.trim_or_null(C("Category")), "issuer_name": issuer, "has_known_issuer": issuer.isNotNull(),
               "issuer_phone": X.trim_or_null(C("IssuerPhone")), "issuer_website": X.trim_or_null(C("IssuerUrl")), "issuer_country_alpha2": X.upper_or_null(C("isoCode2")), "issuer_country_alpha3": X.upper_or_null(C("isoCode3")), "issuer_country_name": X.trim_or_null(C("CountryName"))}
    return Dataset("card_issuer", "bin_range", columns, _needed("bin_range") | _shape("bin_range", r"\d{6}$") | _needed("card_brand"))


def country() -> Dataset:
    """Over a column raw of JSON text."""
    r = F.from_json("raw", COUNTRY)
    columns = {"country_code_alpha3": X.upper_or_null(r["cca3"]), "country_code_alpha2": X.upper_or_null(r["cca2"]), "country_code_numeric": X.trim_or_null(r["ccn3"]), "country_name": X.trim_or_null(r["name"]["common"]),
               "country_official_name": X.trim_or_null(r["name"]["official"]), "region": X.trim_or_null(r["region"]), "subregion": X.trim_or_null(r["subregion"]), "capital": X.trim_or_null(F.get(r["capital"], F.lit(0))),
               "default_currency_code": X.upper_or_null(F.get(F.map_keys(r["currencies"]), F.lit(0))), "is_independent": strict_bool(r["independent"]), "is_un_member": strict_bool(r["unMember"])}
    hard = _needed("country_code_alpha3") | _shape("country_code_alpha3", "[A-Z]{3}$") | _needed("country_code_alpha2") | _shape("country_code_alpha2", "[A-Z]{2}$") | _needed("country_name")
    return Dataset("country", "country_code_alpha3", columns, hard)


def iso_currency() -> Dataset:
    columns = {"currency_code": X.upper_or_null(C("AlphabeticCode")), "currency_name": X.trim_or_null(C("Currency")), "currency_numeric_code": X.trim_or_null(C("NumericCode")), "minor_unit": X.int_or_null(C("MinorUnit")), "withdrawal_date": X.trim_or_null(C("WithdrawalDate"))}
    return Dataset("iso_currency", "currency_code", columns, _needed("currency_code") | _shape("currency_code", "[A-Z]{3}$"))


def place() -> Dataset:
    """Over a column raw of JSON text: one element with its tags."""
    r = F.from_json("raw", PLACE)
    number, kind = F.when(r["id"].rlike(r"^-?\d+$"), r["id"].try_cast("long")), X.trim_or_null(r["type"])
    tag = {"merchant_name": "name", "raw_shop_tag": "shop", "raw_amenity_tag": "amenity", "address_city": "addr:city", "address_postcode": "addr:postcode", "address_street": "addr:street", "phone": "phone", "website": "website", "opening_hours": "opening_hours"}
    columns = {"merchant_id": F.when(kind.isNotNull() & number.isNotNull(), F.concat_ws(":", kind, number.cast("string"))), "osm_id": number, "osm_type": kind, "latitude": X.double_or_null(r["lat"]), "longitude": X.double_or_null(r["lon"])}
    columns |= {n: X.trim_or_null(r["tags"][t]) for n, t in tag.items()} | {"source_updated_timestamp": X.trim_or_null(r["timestamp"])}
    hard = _needed("merchant_id", "osm_id", "osm_type") | _shape("osm_type", "(node|way|relation)$") | _needed("merchant_name", "latitude") | {"range_latitude": checks.in_range(C("latitude"), -90, 90)}
    hard |= _needed("longitude") | {"range_longitude": checks.in_range(C("longitude"), -180, 180)}
    return Dataset("merchant", "merchant_id", columns, hard, ("raw_shop_tag", "raw_amenity_tag", "address_city", "address_postcode", "address_street", "phone", "website", "opening_hours", "source_updated_timestamp"))


def excluded_places(raw: DataFrame) -> DataFrame:
    """raw with excluded: vacant_shop, else unnamed, else null; such places are counted, and not checked or quarantined."""
    tags = F.from_json("raw", PLACE)["tags"]
    vacant, unnamed = X.trim_or_null(tags["shop"]) == "vacant", X.trim_or_null(tags["name"]).isNull()
    return raw.withColumn("excluded", F.when(F.coalesce(vacant, F.lit(False)), "vacant_shop").when(unnamed, "unnamed"))


def lei_profile(raw: DataFrame) -> DataFrame:
    """The approved fields of LEI records as they are, for the checks of a raw batch."""
    a = F.from_json("raw", LEI_RECORD)["attributes"]
    e, r = a["entity"], a["registration"]
    out = {"lei": a["lei"], "entity_legal_name": e["legalName"]["name"]}
    for short, path in (("legal", "legalAddress"), ("hq", "headquartersAddress")):
        out |= {f"entity_{short}_address_{n}": e[path][f] for n, f in (("country", "country"), ("city", "city"), ("region", "region"), ("postal_code", "postalCode"), ("lines", "addressLines"))}
    out |= {"entity_legal_form_id": e["legalForm"]["id"], "entity_category": e["category"], "entity_status": e["status"], "entity_jurisdiction": e["jurisdiction"], "entity_creation_date": e["creationDate"]}
    out |= {"registration_initial_registration_date": r["initialRegistrationDate"], "registration_last_update_date": r["lastUpdateDate"], "registration_status": r["status"], "registration_next_renewal_date": r["nextRenewalDate"], "bic": a["bic"]}
    return raw.select(*[c.alias(n) for n, c in out.items()])


def legal_entity() -> Dataset:
    """Over a column raw of JSON text: one element of a page's data. The jurisdiction is trimmed, never folded."""
    a = F.from_json("raw", LEI_RECORD)["attributes"]
    e, r = a["entity"], a["registration"]
    columns = {"lei": X.trim_or_null(a["lei"]), "legal_name": X.trim_or_null(e["legalName"]["name"])}
    for short, path in (("legal", "legalAddress"), ("hq", "headquartersAddress")):
        d = e[path]
        columns |= {f"{short}_address_country": X.upper_or_null(d["country"]), f"{short}_address_city": X.trim_or_null(d["city"]), f"{short}_address_region": X.trim_or_null(d["region"]), f"{short}_address_postal_code": X.trim_or_null(d["postalCode"]), f"{short}_address_lines": X.clean_array(d["addressLines"])}
    stamps = {"entity_creation_date": e["creationDate"], "registration_initial_registration_date": r["initialRegistrationDate"], "registration_last_update_date": r["lastUpdateDate"], "registration_next_renewal_date": r["nextRenewalDate"]}
    columns |= {"legal_form_id": X.trim_or_null(e["legalForm"]["id"]), "entity_category": X.trim_or_null(e["category"]), "entity_status": X.trim_or_null(e["status"]), "entity_jurisdiction": X.trim_or_null(e["jurisdiction"]), "registration_status": X.trim_or_null(r["status"]), "bic": X.trim_or_null(a["bic"])}
    columns |= {n: X.timestamp_or_null(c) for n, c in stamps.items()} | {"source_updated_timestamp": X.timestamp_or_null(r["lastUpdateDate"])}
    hard = _needed("lei") | _shape("lei", "[A-Z0-9]{18}[0-9]{2}$") | _needed("legal_name", "entity_status", "registration_status", "entity_jurisdiction", "registration_last_update_date")
    return Dataset("legal_entity", "lei", columns, hard, tuple(c for c in columns if f"required_{c}" not in hard and c != "source_updated_timestamp"))


def fx_rate() -> Dataset:
    """Over flatten_rates()' rows."""
    columns = {"rate_date": X.date_or_null(X.trim_or_null(C("date"))), "base_currency": X.upper_or_null(C("base")), "quote_currency": X.upper_or_null(C("currency")), "exchange_rate": X.decimal_or_null(C("rate"), 18, 6)}
    hard = _needed("rate_date", "base_currency") | _shape("base_currency", "[A-Z]{3}$") | _needed("quote_currency") | _shape("quote_currency", "[A-Z]{3}$") | _needed("exchange_rate") | {"positive_exchange_rate": checks.positive(C("exchange_rate"))}
    return Dataset("fx_rate", "rate_date", columns, hard)


def flatten_rates(raw: DataFrame, body: str = "raw") -> DataFrame:
    """(date, base, currency, rate) of responses that hold one date's rates, or a range's by date."""
    r = F.from_json(body, RATES)
    x = raw.select(r.alias("r"), (r["start_date"].isNotNull() & r["end_date"].isNotNull()).alias("is_range"))
    # a flat response is a range of one date
    by_date = F.when(C("is_range"), F.transform_values("r.rates", lambda _, v: F.from_json(v, "map<string,string>"))).otherwise(F.create_map(F.coalesce("r.date", F.lit("")), "r.rates"))
    days = x.select(C("r.base").alias("base"), F.explode(by_date).alias("date", "rates"))
    return days.select(F.nullif("date", F.lit("")).alias("date"), "base", F.explode("rates").alias("currency", "rate"))


def pages(raw: DataFrame, body: str = "raw") -> DataFrame:
    """raw: the elements of each page's data, as JSON text."""
    return raw.select(F.explode(F.from_json(F.get_json_object(body, "$.data"), "array<string>")).alias("raw"))


def conform(raw: DataFrame, dataset: Dataset, order: Sequence[str], unique: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): accepted rows have the dataset's columns, order and warnings; rejected ones failing_check_name and error_reason besides.

    With unique, the first row of a key by order is kept, and the others are rejected.
    """
    typed = raw.select(*order, *[c.alias(n) for n, c in dataset.columns.items()])
    soft = {n: F.size(C(n)) > 0 if n.endswith("_lines") else checks.required(C(n)) for n in dataset.optional}
    good, bad = checks.split_valid(checks.with_verdict(typed, dataset.hard, {n: F.coalesce(c, F.lit(False)) for n, c in soft.items()}))
    if unique:
        good, again = dedupe.keep_first(good, [dataset.key], order)
        name = f"uniqueness_{dataset.key}"
        bad = bad.unionByName(again.withColumns({"failing_check_name": F.lit(name), "error_reason": F.lit(name)}))
    return good.drop("failing_check_name", "error_reason", "is_valid"), bad.drop("is_valid")


def merge_currencies(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(currencies, rejected): rows of a code become one with the first known value of each field; those left without a name are rejected whole."""
    fields = ["currency_name", "currency_numeric_code", "minor_unit", "withdrawal_date"]
    merged = dedupe.merge_first_known(rows, "currency_code", order, fields).withColumn("is_active", C("withdrawal_date").isNull())
    checked = checks.with_verdict(merged, _needed("currency_name"))
    good, bad = checks.split_valid(checked)
    return good.select(*merged.columns), bad.select(*merged.columns, "failing_check_name")


@dataclass(frozen=True)
class Suite:
    """What a raw batch must satisfy: fields that must be there, a key without repeats, patterns, JSON members that must be lists or objects. An incremental batch may be empty; informational checks never fail."""

    needed: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    patterns: tuple[tuple[str, str], ...] = ()
    nulls: tuple[str, ...] = ()
    lists: tuple[tuple[str, str], ...] = ()
    objects: tuple[tuple[str, str], ...] = ()
    informational: tuple[str, ...] = ()


SUITES = {
    "mcc": Suite(("mcc",), ("mcc",)),
    "country": Suite(("cca2", "cca3", "name"), ("cca3",)),
    "iso_currency": Suite(("AlphabeticCode", "Currency", "MinorUnit"), ("AlphabeticCode",), (("AlphabeticCode", "[A-Z]{3}$"),), informational=("duplicates_AlphabeticCode",)),
    "card_issuer": Suite(("BIN", "Brand"), ("BIN",), (("BIN", r"\d{6}$"), ("isoCode2", "[A-Za-z]{2}$"))),
    "fx_rate": Suite(("date", "currency", "rate")),
    "merchant": Suite(("id", "type"), ("id",)),
    "legal_entity": Suite(("lei", "entity_status", "entity_jurisdiction", "registration_status"), ("lei",), nulls=("lei", "entity_status", "entity_jurisdiction", "registration_status")),
    "rates_response": Suite(objects=(("raw", "$.rates"),)),
    "lei_page": Suite(lists=(("raw", "$.data"),)),
}


def run_suite(raw: DataFrame, source: str, suite: Suite, incremental: bool = False) -> DataFrame:
    """(source, check_name, n_failures, passed): one pass over the batch; an empty incremental batch passes."""
    n = F.count("*")
    made = {"non_empty": F.when(n > 0, 0).otherwise(1)}
    made |= {f"required_{c}": F.count_if(C(c).isNull()) for c in suite.needed}
    made |= {f"duplicates_{c}": n - F.count_distinct(C(c)) - F.count_if(C(c).isNull()) for c in suite.unique}
    made |= {f"pattern_{c}": F.count_if(checks.required(C(c)) & ~checks.matches(C(c), p)) for c, p in suite.patterns}
    made |= {f"nulls_{c}": F.count_if(~checks.required(C(c))) for c in suite.nulls}
    made |= {f"list_{p[2:]}": F.count_if(F.json_array_length(F.get_json_object(c, p)).isNull()) for c, p in suite.lists}
    made |= {f"object_{p[2:]}": F.count_if(F.json_object_keys(F.get_json_object(c, p)).isNull()) for c, p in suite.objects}
    free = {*suite.informational, *(f"nulls_{c}" for c in suite.nulls), *(("non_empty",) if incremental else ())}
    one = raw.agg(*[c.cast("long").alias(k) for k, c in made.items()]).unpivot([], list(made), "check_name", "n_failures")
    return one.select(F.lit(source).alias("source"), "check_name", "n_failures", ((C("n_failures") == 0) | C("check_name").isin(*free)).alias("passed"))


def suite_passed(results: DataFrame) -> DataFrame:
    """(source, passed): all of a source's checks."""
    return results.groupBy("source").agg(F.bool_and("passed").alias("passed"))


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
