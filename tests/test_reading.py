"""Recon values and listings on small cases."""

from pyspark.sql import functions as F

from outfall.operators import recon as R
from outfall.operators import runs

STRINGS = "run_id string, path_in_tree string, value string, byte_offset bigint, encoding string"


def strings(spark, values):
    return spark.createDataFrame([("r", f"p{i}", v, i, "ascii") for i, v in enumerate(values)], STRINGS)


def test_values_equal_in_two_hundred_characters_stay_two(spark):
    long = ";".join(f"Key{i:02}=value-number-{i:02}-of-the-same-length" for i in range(12))
    assert len(long) > 250
    claimed = R.claims(strings(spark, [long + ";End=aaa", long + ";End=bbb", long + ";End=aaa"]), ["run_id"])
    assert {r["category"] for r in claimed.collect()} == {"connection_string"}
    counts = R.value_counts(claimed, ["run_id"])
    assert sorted(r["occurrences"] for r in counts.collect()) == [1, 2]
    assert [len(r["found"]) for r in R.recon_samples(counts, ["run_id"]).collect()] == [200, 200]


def test_the_first_probe_that_matches_claims_a_string(spark):
    values = ["see https://a.example.org/x for 10.1.2.3", r"\\server01\share\x", r"C:\src\main.c 10.1.2.3", "/home/dev/x 10.1.2.3", "mail a.b@example.org now", "at 10.20.30.40:80", "host build01.de.example.net", "plain words only"]
    got = {r["byte_offset"]: r["category"] for r in R.claims(strings(spark, values), ["run_id"]).collect()}
    assert got == dict(enumerate(["uri_scheme", "unc_path", "windows_path", "posix_path", "email_or_upn", "ip_address", "hostname"]))


def test_residue_of_each_run(spark):
    rows = strings(spark, ["password = hunter22-long", "password = hunter22-long", "licence key = ABC-123-XYZ", "shrt"])
    hits = spark.createDataFrame([("r", "p2", 2)], "run_id string, path_in_tree string, byte_offset bigint")
    assert [(r["path_in_tree"], r["value"]) for r in R.residue_by(rows, hits, ["run_id"]).collect()] == [("p0", "password = hunter22-long")]
    assert R.residue_by(rows, hits.where("false"), ["run_id"], 1).count() == 1


def test_counts_of_all_and_new_findings_in_one_pass(spark):
    rows = spark.createDataFrame([("r", "high", True), ("r", "high", False), ("r", "low", True), ("s", "info", False)], "run_id string, severity string, is_new boolean")
    got = {r["run_id"]: r for r in runs.severity_counts(rows, new=F.col("is_new")).collect()}
    assert (got["r"]["high"], got["r"]["new_high"], got["r"]["new_low"], got["s"]["info"], got["s"]["new_info"]) == (2, 1, 1, 1, 0)
