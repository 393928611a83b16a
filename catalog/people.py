"""The derived people table: fifteen census columns and four more for the audit checks, computed from ``orders``.

Integer arithmetic only, so both engines compute the same rows. Two rows in a hundred repeat their neighbour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey - 1 ELSE o_orderkey END"

COLUMNS = {
    "age": (
        'CASE WHEN k % 20 = 3 THEN NULL WHEN k % 997 = 5 THEN 95 ELSE 17 + CAST(floor(((k*7919) % 74) * '
        '((k*7717) % 74) / 74.0) AS BIGINT) END'
    ),
    "workclass": (
        "CASE WHEN k % 211 = 0 THEN 'private' WHEN k % 223 = 0 THEN ' Private ' WHEN (k*17) % 101 < 66 THEN "
        "'Private' WHEN (k*17) % 101 < 73 THEN 'Self-emp-not-inc' WHEN (k*17) % 101 < 79 THEN 'Local-gov' "
        "WHEN (k*17) % 101 < 84 THEN '?' WHEN (k*17) % 101 < 88 THEN 'State-gov' WHEN (k*17) % 101 < 92 THEN "
        "'Self-emp-inc' WHEN (k*17) % 101 < 95 THEN 'Federal-gov' ELSE NULL END"
    ),
    "fnlwgt": (
        '12285 + ((k*7919) % 1213) * ((k*104729) % 1213)'
    ),
    "education_num": (
        '1 + (k*7) % 16'
    ),
    "education": (
        "CASE (k*7) % 16 WHEN 0 THEN 'Preschool' WHEN 1 THEN '1st-4th' WHEN 2 THEN '5th-6th' WHEN 3 THEN "
        "'7th-8th' WHEN 4 THEN '9th' WHEN 5 THEN '10th' WHEN 6 THEN '11th' WHEN 7 THEN '12th' WHEN 8 THEN "
        "'HS-grad' WHEN 9 THEN 'Some-college' WHEN 10 THEN 'Assoc-voc' WHEN 11 THEN 'Assoc-acdm' WHEN 12 THEN"
        " 'Bachelors' WHEN 13 THEN 'Masters' WHEN 14 THEN 'Prof-school' ELSE 'Doctorate' END"
    ),
    "marital_status": (
        "CASE WHEN (k*29) % 103 < 47 THEN 'Married-civ-spouse' WHEN (k*29) % 103 < 80 THEN 'Never-married' "
        "WHEN (k*29) % 103 < 94 THEN 'Divorced' WHEN (k*29) % 103 < 97 THEN 'Separated' WHEN (k*29) % 103 < "
        "100 THEN 'Widowed' WHEN (k*29) % 103 < 102 THEN 'Married-spouse-absent' ELSE 'Married-AF-spouse' END"
    ),
    "occupation": (
        "CASE WHEN (k*31) % 107 < 13 THEN 'Prof-specialty' WHEN (k*31) % 107 < 26 THEN 'Craft-repair' WHEN "
        "(k*31) % 107 < 39 THEN 'Exec-managerial' WHEN (k*31) % 107 < 51 THEN 'Adm-clerical' WHEN (k*31) % "
        "107 < 63 THEN 'Sales' WHEN (k*31) % 107 < 74 THEN 'Other-service' WHEN (k*31) % 107 < 81 THEN "
        "'Machine-op-inspct' WHEN (k*31) % 107 < 87 THEN '?' WHEN (k*31) % 107 < 92 THEN 'Transport-moving' "
        "WHEN (k*31) % 107 < 96 THEN 'Farming-fishing' WHEN (k*31) % 107 < 99 THEN 'Tech-support' ELSE NULL "
        'END'
    ),
    "relationship": (
        "CASE WHEN (k*29) % 103 < 47 THEN (CASE WHEN (k*11) % 3 < 2 THEN 'Husband' ELSE 'Wife' END) WHEN "
        "(k*29) % 103 < 70 THEN 'Not-in-family' WHEN (k*29) % 103 < 88 THEN 'Own-child' ELSE 'Unmarried' END"
    ),
    "race": (
        "CASE WHEN (k*37) % 109 < 93 THEN 'White' WHEN (k*37) % 109 < 103 THEN 'Black' WHEN (k*37) % 109 < "
        "106 THEN 'Asian-Pac-Islander' ELSE 'Other' END"
    ),
    "sex": (
        "CASE WHEN k % 401 = 7 THEN 'MALE' WHEN (k*11) % 3 < 2 THEN 'Male' ELSE 'Female' END"
    ),
    "capital_gain": (
        'CASE WHEN (k*41) % 113 = 0 THEN 99999 WHEN (k*41) % 113 < 9 THEN 114 + (k*7919) % 15000 ELSE 0 END'
    ),
    "capital_loss": (
        'CASE WHEN (k*43) % 127 < 6 THEN 155 + (k*7717) % 4200 ELSE 0 END'
    ),
    "hours_per_week": (
        'CASE WHEN k % 20 = 7 THEN NULL WHEN (k*53) % 131 < 62 THEN 40 ELSE CAST(floor(((k*7919) % 50 + '
        '(k*104729) % 50) / 1.0) AS BIGINT) + 1 END'
    ),
    "native_country": (
        "CASE WHEN (k*59) % 137 < 115 THEN 'United-States' WHEN (k*59) % 137 < 120 THEN 'Mexico' WHEN (k*59) "
        "% 137 < 123 THEN '?' WHEN (k*59) % 137 < 126 THEN 'Philippines' WHEN (k*59) % 137 < 129 THEN "
        "'Germany' ELSE NULL END"
    ),
    "income": (
        'CASE WHEN ((k*7) % 16) * 4 + ((k*7919) % 74) * ((k*7717) % 74) / 74.0 + (CASE WHEN (k*11) % 3 < 2 '
        "THEN 8 ELSE 0 END) + (CASE WHEN (k*41) % 113 < 9 THEN 25 ELSE 0 END) > 65 THEN '>50K' ELSE '<=50K' "
        'END'
    ),
    "joined_date": (
        "CASE WHEN k % 307 = 11 THEN 'not a date' WHEN k % 13 = 0 THEN '05/03/2021' ELSE '2021-03-05' END"
    ),
    "body_weight": (
        "CASE WHEN k % 9 = 0 THEN concat(CAST(120 + k % 60 AS VARCHAR(8)), ' lbs') ELSE concat(CAST(50 + k % "
        "40 AS VARCHAR(8)), ' kg') END"
    ),
    "team": (
        "CASE WHEN k = 123 THEN 'Saels' WHEN k = 234 THEN 'Finanse' ELSE concat('Team ', CAST(k % 8 AS "
        'VARCHAR(8))) END'
    ),
    "badge_no": (
        "CASE WHEN k % 29 = 0 THEN 'n.v.' ELSE CAST(1000 + k % 700 AS VARCHAR(8)) END"
    ),
}

TEXT = ["workclass", "education", "marital_status", "occupation", "relationship", "race", "sex", "native_country",
        "income", "joined_date", "body_weight", "team", "badge_no"]
NUMERIC = ["age", "fnlwgt", "education_num", "capital_gain", "capital_loss", "hours_per_week"]


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(f"{KEY} AS k")
    return keyed.selectExpr(*[f"{e.replace('VARCHAR(8)', 'STRING')} AS {n}" for n, e in COLUMNS.items()])


def people_sql(name: str = "people") -> str:
    """The same table as common table expressions."""
    picks = ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items())
    return f"keyed AS (SELECT {KEY} AS k FROM orders), {name} AS (SELECT {picks} FROM keyed)"
