"""Business rules: offers, rewards, code lookups and event sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import reward


def qualify_offers(txns: DataFrame, offers: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each approved transaction with the first offer (by offer_id) of its program that is valid on its date and fits its code; keep: more columns of txns.

    Which offer that is hangs on program, date and code alone, so no transaction meets all offers that fit it. An offer's days are
    the fewest blocks of 2^n days that start at a multiple of 2^n, at most two of each n; of each block, program and code only the
    first offer stays. Each program, date and code that transactions have looks into the one block of each n that its date is in.
    """
    o = offers.filter("valid_from <= valid_to").withColumns({"_from": F.unix_date("valid_from"), "_to": F.unix_date("valid_to") + 1})
    blocks = F.expr("""flatten(transform(sequence(0, CAST(floor(log2(_to - _from)) AS INT)), n -> transform(
        filter(array(struct(-shiftright(-_from, n) AS at, -shiftright(-_from, n) AS odd), struct(shiftright(_to, n) - 1 AS at, shiftright(_to, n) AS odd)),
               b -> -shiftright(-_from, n) < shiftright(_to, n) AND b.odd & 1 = 1), b -> struct(n, b.at))))""")
    o = o.select("program_id", "eligible_mcc", F.struct("offer_id", "offer_type", "offer_value", "min_amount").alias("_offer"), F.explode(blocks).alias("_block"))
    o = o.groupBy("program_id", "eligible_mcc", F.col("_block.n").alias("_n"), F.col("_block.at").alias("_at")).agg(F.min_by("_offer", F.col("_offer.offer_id")).alias("_offer"))
    a = txns.filter("status = 'APPROVED'").select("transaction_id", "amount", "txn_date", "program_id", "mcc", *keep)
    sizes = o.agg(F.array_sort(F.collect_set("_n")).alias("_sizes"))  # one row, of at most 22 sizes
    tried = a.select("program_id", "mcc", "txn_date").filter("program_id IS NOT NULL AND txn_date IS NOT NULL").distinct().crossJoin(F.broadcast(sizes)).withColumn("_n", F.explode("_sizes")).drop("_sizes")
    tried = tried.withColumns({"_at": F.expr("shiftright(unix_date(txn_date), _n)"), "_code": F.explode(F.array("mcc", F.lit(None)))}).alias("t")
    fits = F.expr("t.program_id = o.program_id AND t._code <=> o.eligible_mcc AND t._n = o._n AND t._at = o._at")
    first = tried.join(o.alias("o"), fits).groupBy("t.program_id", "t.mcc", "t.txn_date").agg(F.min_by("o._offer", F.col("o._offer.offer_id")).alias("_offer")).alias("f")
    a = a.alias("a").join(first, F.expr("a.program_id = f.program_id AND a.mcc <=> f.mcc AND a.txn_date = f.txn_date"))
    # rows that share an id count as one transaction
    best = a.groupBy("a.transaction_id").agg(F.min_by(F.struct("a.amount", "a.txn_date", *[f"a.{c}" for c in keep], "f._offer.*"), F.col("f._offer.offer_id")).alias("x"))
    out = best.select("transaction_id", "x.amount", "x.txn_date", *[f"x.{c}" for c in keep], "x.offer_id", "x.offer_type", "x.offer_value", "x.min_amount")
    paid = reward(F.col("amount"), F.col("offer_type"), F.col("offer_value"), F.col("min_amount"))
    return out.withColumn("reward_amount", paid).withColumn("qualification_status", F.when(F.col("reward_amount") > 0, "QUALIFIED").otherwise("NOT_QUALIFIED"))


def first_code(df: DataFrame, key: str, tags: str, crosswalk: DataFrame, default: str) -> DataFrame:
    """key, code: the code of the first `;`-separated tag that the crosswalk (tag, code) has, else the default."""
    words = df.select(key, F.posexplode(F.split(tags, ";")).alias("pos", "tag")).withColumn("tag", F.trim("tag"))
    hit = words.join(crosswalk, "tag").groupBy(key).agg(F.min_by("code", "pos").alias("code"))
    return df.select(key).join(hit, key, "left").withColumn("code", F.coalesce("code", F.lit(default)))


#: Tag, value, merchant category, confidence.
CATEGORIES = """
amenity restaurant 5812 0.9
amenity fast_food 5814 0.9
amenity cafe 5812 0.6
amenity bank 6011 0.7
shop clothes 5651 0.8
shop jewelry 5944 0.9
shop hairdresser 7230 0.9
shop beauty 7230 0.7
shop shoes 5661 0.9
shop mobile_phone 5732 0.6
shop cosmetics 5977 0.9
shop gift 5947 0.8
shop confectionery 5441 0.9
shop convenience 5499 0.8
shop optician 8043 0.9
shop supermarket 5411 0.9
shop tea 5499 0.4
shop e-cigarette 5993 0.4
shop seafood 5422 0.5
shop greengrocer 5499 0.5
shop electronics 5732 0.8
shop chemist 5912 0.8
shop tailor 5949 0.6
shop deli 5499 0.5
shop butcher 5422 0.7
shop sports 5941 0.8
shop florist 5992 0.9
shop books 5942 0.9
"""
OTHER_CODE, OTHER_CONFIDENCE = "5999", 0.3


def categories() -> list[tuple[str, str, str, float]]:
    return [(tag, value, code, float(sure)) for tag, value, code, sure in map(str.split, CATEGORIES.strip().splitlines())]


def merchant_category(df: DataFrame, key: str, shop: str, amenity: str) -> DataFrame:
    """key, mcc_code, mcc_confidence: of the first `;`-separated shop that has a category, else of the amenity, else the rest's."""
    known = F.broadcast(df.sparkSession.createDataFrame(categories(), "tag string, value string, code string, confidence double"))  # a fixed list
    shops = df.select(key, F.lit("shop").alias("tag"), F.posexplode(F.split(shop, ";")).alias("pos", "value"))
    tried = shops.unionByName(df.select(key, F.lit("amenity").alias("tag"), F.lit(1 << 30).alias("pos"), F.col(amenity).alias("value")))
    hit = tried.withColumn("value", F.trim("value")).join(known, ["tag", "value"]).groupBy(key).agg(F.min_by(F.struct("code", "confidence"), "pos").alias("_hit"))
    x = df.select(key).join(hit, key, "left")
    return x.select(key, F.coalesce("_hit.code", F.lit(OTHER_CODE)).alias("mcc_code"), F.coalesce("_hit.confidence", F.lit(OTHER_CONFIDENCE)).alias("mcc_confidence"))


def sequence_faults(events: DataFrame) -> DataFrame:
    """Transactions whose events break the order: one AUTHORIZATION, first; a CAPTURE iff approved; REVERSAL only after a CAPTURE."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("event_ts", "event_type"))), lambda e: e["event_type"])
    n = {t: F.count_if(F.col("event_type") == t).alias(t.lower()) for t in ("AUTHORIZATION", "CAPTURE", "REVERSAL")}
    x = events.groupBy("transaction_id", "status").agg(ordered.alias("seq"), *n.values())
    fault = (
        F.when(F.col("authorization") != 1, "authorization_count")
        .when(F.get("seq", F.lit(0)) != "AUTHORIZATION", "authorization_not_first")
        .when((F.col("status") == "APPROVED") & (F.col("capture") != 1), "approved_without_capture")
        .when((F.col("status") == "DECLINED") & (F.col("capture") + F.col("reversal") > 0), "declined_with_capture")
        .when((F.col("reversal") > 0) & (F.col("capture") == 0), "reversal_without_capture")
    )
    return x.withColumn("fault", fault).filter("fault IS NOT NULL").select("transaction_id", "fault")
