"""Inventory of small files."""

import hashlib

from frameops.sources import scans


def test_inventory_takes_many_small_files_in_a_task(spark, tmp_path):
    limit = scans.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    for i in range(limit + 10):
        (tmp_path / f"f{i}.txt").write_text(str(i))
    # a partition per file
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")
    try:
        out = scans.inventory_files(spark, str(tmp_path))
        assert out.rdd.getNumPartitions() <= limit and out.select("checksum_sha256").distinct().count() == limit + 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_inventory_holds_empty_documents_and_copies_of_an_id(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, "ab", "en"), (2, "", "en"), (3, None, "fr"), (4, "x", "en"), (4, "yy", "en"), (4, "yy", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = entry.queries()["s03_inventory_files"](spark, str(tmp_path)).collect()
    assert sorted((r["relative_path"], r["file_size_bytes"], r["view_type"], r["day_id"]) for r in found) == [
        ("day1/fixed/en/1.TXT", 2, "exocentric", "day1"), ("day2/fixed/en/2.TXT", 0, "exocentric", "day2"), ("day3/members/fr/3.TXT", 0, "egocentric", "day3"),
        ("day4/fixed/en/4.TXT", 1, "exocentric", "day4"), ("day4/fixed/en/4.TXT", 2, "exocentric", "day4"), ("day4/fixed/en/4.TXT", 2, "exocentric", "day4")]
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["checksum_sha256"] == empty for r in found if not r["file_size_bytes"])
