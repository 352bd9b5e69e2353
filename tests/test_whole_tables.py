"""Queries that take every page, and every kind of secret, of their tables."""

from __future__ import annotations

import hashlib

from veilspark.plans.derived import form_elements
from veilspark.plans.registry import queries

FOLDER = "/root/testdata/sf0.01"


def test_lookup_meets_every_page(spark):
    pages = {r["page_id"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id").collect()}
    found = queries()["element_lookup_all"](spark, FOLDER).select("page_id").distinct().collect()
    assert {r["page_id"] for r in found} == pages


def test_planted_secrets_of_every_kind_are_found(spark):
    small = "/root/testdata/sf0.001"
    found = {r["secret_hash"] for r in queries()["secret_audit_planted"](spark, small).collect()}
    planted = form_elements(spark, small).where("scan_id % 7 = 3 AND value IS NOT NULL").select("ord", "value").collect()
    assert {r["ord"] for r in planted} == {1, 2, 3, 4, 5, 6, 7, 8, 13}
    assert {hashlib.sha256(r["value"].encode()).hexdigest() for r in planted} <= found
