"""Files read by many tasks, manifests by path, positions and pairing."""
import random

import pytest
from pyspark.sql import functions as F

from feedlake.operators.positions import pair_summaries, with_position
from feedlake.sources import read_file_inventory, read_payloads, read_report_lines


def _reports(folder, seed, breaks, n=4000):
    """Files with every kind of line end; returns path -> lines as str.splitlines gives them."""
    pick, want = random.Random(seed), {}
    for name in ("cycle_report_1.txt", "cycle_report_2.txt", "cycle_report_é +%41.txt"):
        text = "".join("".join(pick.choice("ab é") for _ in range(pick.randint(0, 40))) + pick.choice(breaks) for _ in range(n)) + "end"
        (folder / name).write_bytes(text.encode())
        want[name] = text.splitlines()
    for name, text in (("cycle_report_empty.txt", ""), ("cycle_report_one.txt", "\n"), ("cycle_report_blank.txt", "\n\nx\n\n")):
        (folder / name).write_text(text)
        want[name] = text.splitlines()
    return want


@pytest.mark.parametrize("breaks", [["\n"], ["\n", "\r\n", "\r"], ["\n"] * 20 + ["\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", "\x0b\n"]])
def test_lines_of_split_files(spark, tmp_path, breaks):
    want = _reports(tmp_path, len(breaks), breaks)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = read_report_lines(spark, str(tmp_path))
        got = {}
        for r in lines.orderBy("path", "line_no").collect():
            got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.line_no, r.line))
        tasks = lines.where(F.col("path").endswith("cycle_report_1.txt")).select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {k: list(enumerate(v)) for k, v in want.items() if v}
    assert tasks > 5
    paths = {r.path for r in read_file_inventory(spark, str(tmp_path)).collect()}
    assert {r.path for r in lines.select("path").distinct().collect()} <= paths


def test_plain_lines_cross_no_exchange(spark, tmp_path):
    (tmp_path / "cycle_report_1.txt").write_text("a\nb\n")
    plan = read_report_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    plain = plan.split("Union")[1].split("\n")
    assert "BroadcastHashJoin" in plan and not any("Exchange hashpartitioning" in x and "line#" in x for x in plain[:6]), plan


def test_inventory_reads_no_contents(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    plan = read_file_inventory(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_manifest_by_path_tells_equal_names_apart(spark, tmp_path):
    for k in "ab":
        (tmp_path / f"x={k} +%41").mkdir()
        (tmp_path / f"x={k} +%41" / "part-0.txt").write_text(f"<feed>{k}</feed>")
    listed = read_file_inventory(spark, str(tmp_path), recursive=True).select(
        "path", F.concat(F.lit("http://"), F.regexp_extract("path", "x=(.)", 1)).alias("url"))
    got = {(r.url, r.body) for r in read_payloads(spark, str(tmp_path), "feed", manifest=listed).collect()}
    assert got == {("http://a", "<feed>a</feed>"), ("http://b", "<feed>b</feed>")}


def test_positions_and_pairs(spark):
    items = spark.range(1000).withColumn("k", F.xxhash64("id"))
    placed = {r.id: r.position for r in with_position(items, ["k"], 7).collect()}
    rows = {r.id: r for r in items.collect()}
    assert [placed[i] for i in sorted(rows, key=lambda i: rows[i].k)] == list(range(1000))
    for n in (0, 1, 400, 3000):
        told = spark.range(n).select(F.concat(F.lit("s"), F.col("id")).alias("headline"), (-F.col("id")).alias("place"))
        got = sorted((r.position, r.id, r.summary_s.headline) for r in pair_summaries(items, told, ["k"], ["place"], 5).collect())
        by_k = sorted(rows, key=lambda i: rows[i].k)
        assert got == [(i, by_k[i], f"s{n - 1 - i}") for i in range(min(n, 1000))]
    assert pair_summaries(items.limit(0), told, ["k"], ["place"], 5).count() == 0


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    from feedlake.session import LISTING_TASKS, task_slots
    for i in range(60):
        (tmp_path / f"x={i}").mkdir()
        (tmp_path / f"x={i}" / "part-0.txt").write_text("a")
    sc, before = spark.sparkContext, spark.conf.get(LISTING_TASKS)
    sc.setJobGroup("few-listing-tasks", "")
    try:
        listed = read_file_inventory(spark, str(tmp_path), recursive=True)
    finally:
        sc.setJobGroup("", "")
    track = sc.statusTracker()
    tasks = [track.getStageInfo(s).numTasks for j in track.getJobIdsForGroup("few-listing-tasks") for s in track.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * task_slots(spark) < 60
    assert listed.count() == 60 and spark.conf.get(LISTING_TASKS) == before


def test_manifest_by_folder_over_nested_folders(spark, tmp_path):
    for at in ("payload_id=a +%41", "day/payload_id=b"):
        (tmp_path / at).mkdir(parents=True)
        (tmp_path / at / "part-0.txt").write_text(at)
    told = spark.createDataFrame([("payload_id=a +%41", "http://a"), ("payload_id=c", "http://c")], "folder string, url string")
    got = {r.body: r.url for r in read_payloads(spark, str(tmp_path), "feed", manifest=told, recursive=True).collect()}
    assert got["payload_id=a +%41"] == "http://a" and got["day/payload_id=b"].endswith("payload_id=b/part-0.txt") and len(got) == 2


def test_landed_files_are_plain(spark, tmp_path):
    from feedlake.plans.fixtures import land_files
    land_files(spark.createDataFrame([("a", "x"), ("b", "y")], "payload_id string, body string"), str(tmp_path / "in"))
    names = [p.name for k in "ab" for p in (tmp_path / "in" / f"payload_id={k}").iterdir()]
    assert len(names) == 2 and not any(n.endswith(".crc") for n in names)


def test_bodies_of_landed_files_cross_no_exchange(spark, sf_small):
    from feedlake.plans import catalog
    plan = catalog.q_landed_files(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    scan = plan[:plan.index("FileScan text")].split("Exchange")[-1]
    assert "HashAggregate" in scan and "partial_count" in scan, scan


def test_landed_files_are_listed_in_turns(spark, sf_small, monkeypatch):
    """However many files land, the driver holds the names of a turn, not of all."""
    from feedlake.plans import catalog
    whole = sorted(map(tuple, catalog.q_landed_files(spark, sf_small).collect()))
    read, listed = catalog.read_payloads, []

    def seen(spark, path, *a, **k):
        df = read(spark, path, *a, **k)
        listed.append(set(df.inputFiles()))
        return df

    monkeypatch.setattr(catalog, "read_payloads", seen)
    monkeypatch.setattr(catalog, "LANDED_A_TURN", 20)
    assert sorted(map(tuple, catalog.q_landed_files(spark, sf_small).collect())) == whole and whole
    files = set().union(*listed)
    assert len(files) > 40 and sum(map(len, listed)) == len(files) and max(map(len, listed)) <= 40
