"""Registered protection and screening queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywarden.functions.text import CARD, EMAIL, PHONE
from tallywarden.operators import protection as ops
from tallywarden.session import shared_folder
from tallywarden.sources.tables import load

SALT = "example-salt"


def pseudonymise(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return ops.pseudonymise(customers, ["c_name"], SALT)


def mask(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return ops.mask(customers, {"c_name": 4})


def k_anonymity(spark, sf_dir):
    return ops.k_anonymity(load(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], 10)


def screen_exact(spark, sf_dir):
    customers, events = load(spark, sf_dir, "customer"), load(spark, sf_dir, "events")
    failing = events.where("event_type = 'error' AND value > 120").select(F.col("user_id").alias("c_custkey"))
    # The list spells the names differently, as lists from elsewhere do.
    listed = customers.join(failing, "c_custkey", "left_semi").select(
        F.upper(F.translate(F.replace("c_name", F.lit("#"), F.lit(" - ")), "ueo", "üéô")).alias("entry")
    )
    return ops.screen_exact(customers, "c_name", listed, "entry").select("c_custkey", "c_name")


def screen_fuzzy(spark, sf_dir):
    suppliers = load(spark, sf_dir, "supplier")
    listed = suppliers.where("s_acctbal < 500").select(F.translate("s_name", "ui", "úï").alias("entry"))
    hits = ops.screen_fuzzy(suppliers.select("s_suppkey", "s_name"), "s_name", listed, "entry", 1)
    return hits.select("s_suppkey", "s_name", "entry", "distance")


def screen_recall(spark, sf_dir):
    # The list is indexed and stored once.
    suppliers = load(spark, sf_dir, "supplier")
    listed = suppliers.where("s_acctbal < 500").select(F.translate("s_name", "ui", "úï").alias("entry"))
    path = shared_folder(spark, "names")
    ops.index_names(listed, "entry", 2).write.parquet(path)
    found = ops.screening_recall(suppliers, "s_name", listed, "entry", 2, spark.read.parquet(path))
    return found.select("n_exact", (F.col("recall") >= 0.9).alias("recall_reached"))


def scan_sensitive(spark, sf_dir):
    return ops.scan_sensitive(load(spark, sf_dir, "documents"), "text", "source")


QUERIES = {
    "pseudonymise": pseudonymise,
    "mask": mask,
    "k_anonymity": k_anonymity,
    "screen_exact": screen_exact,
    "screen_fuzzy": screen_fuzzy,
    "screen_recall": screen_recall,
    "scan_sensitive": scan_sensitive,
}

_NORMAL = "trim(regexp_replace(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_WEIGHED = "CASE WHEN (i % 2 = 0) THEN (d::int * 2) - (CASE WHEN d::int > 4 THEN 9 ELSE 0 END) ELSE d::int END"

ORACLE = {
    "pseudonymise": f"SELECT c_custkey, sha256('{SALT}|' || c_name) AS c_name FROM customer",
    "mask": "SELECT c_custkey, repeat('X', greatest(length(c_name) - 4, 0)) || right(c_name, 4) AS c_name FROM customer",
    "k_anonymity": """
        SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL HAVING n < 10
    """,
    "screen_exact": f"""
        WITH l AS (SELECT upper(translate(replace(c_name, '#', ' - '), 'ueo', 'üéô')) AS entry FROM customer WHERE c_custkey IN
                   (SELECT user_id FROM events WHERE event_type = 'error' AND value > 120))
        SELECT c_custkey, c_name FROM customer
        WHERE {_NORMAL.format("c_name")} IN (SELECT {_NORMAL.format("entry")} FROM l)
    """,
    "screen_fuzzy": f"""
        WITH l AS (SELECT translate(s_name, 'ui', 'úï') AS entry FROM supplier WHERE s_acctbal < 500)
        SELECT a.s_suppkey, a.s_name, entry,
               levenshtein({_NORMAL.format("a.s_name")}, {_NORMAL.format("entry")})::int AS distance
        FROM supplier a, l WHERE levenshtein({_NORMAL.format("a.s_name")}, {_NORMAL.format("entry")}) <= 1
    """,
    "screen_recall": f"""
        WITH l AS (SELECT DISTINCT {_NORMAL.format("translate(s_name, 'ui', 'úï')")} AS entry
                   FROM supplier WHERE s_acctbal < 500),
        s AS (SELECT DISTINCT {_NORMAL.format("s_name")} AS name FROM supplier)
        SELECT count(*) AS n_exact, true AS recall_reached FROM s, l WHERE levenshtein(name, entry) <= 2
    """,
    "scan_sensitive": f"""
        WITH m AS (SELECT source, len(regexp_extract_all(text, '{EMAIL}')) AS e,
                          len(regexp_extract_all(text, '{PHONE}')) AS p,
                          regexp_extract_all(text, '{CARD}') AS cards FROM documents),
        c AS (SELECT source, e, p, len(list_filter(cards, lambda x: list_sum(list_transform(
                     string_split(reverse(regexp_replace(x, '[^0-9]', '', 'g')), ''),
                     lambda d, i: {_WEIGHED})) % 10 = 0)) AS c FROM m)
        SELECT source, count(*) AS n_records, count(*) FILTER (e > 0) AS with_email,
               count(*) FILTER (p > 0) AS with_phone, count(*) FILTER (c > 0) AS with_card,
               sum(e)::bigint AS n_email, sum(p)::bigint AS n_phone, sum(c)::bigint AS n_card
        FROM c GROUP BY ALL
    """,
}
