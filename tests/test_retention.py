"""Retention: expiry by name date and by mtime, plans, applying to a partitioned dataset."""
import datetime as dt
import os

import pytest

from feedlake.operators import retention as rt
from feedlake.sources import read_file_inventory

AS_OF = "2026-04-22 12:00:00"


def _inv(spark, rows):
    return spark.createDataFrame(rows, "path string, modificationTime timestamp, length long")


def test_known_cases_by_name(spark):
    t = dt.datetime(2026, 4, 22)
    inv = _inv(spark, [("/d/digest_2026-04-22.md", t, 100), ("/d/digest_2026-04-12.md", t, 200),
                       ("/d/digest_2026-04-01_x.md", t, 1), ("/d/digest_.md", t, 1), ("/d/other.md", t, 1),
                       ("/d/digest_2026-04-15.md", t, 7)])
    m = {r.path.split("/")[-1]: r.status for r in rt.mark_expired(inv, AS_OF, 7).collect()}
    # cutoff = 2026-04-15 12:00; the file date is midnight, so 04-15 is already before it
    assert m == {"digest_2026-04-22.md": "kept", "digest_2026-04-12.md": "expired",
                 "digest_2026-04-01_x.md": "skipped", "digest_.md": "skipped", "other.md": "skipped",
                 "digest_2026-04-15.md": "expired"}
    exact = rt.mark_expired(inv, "2026-04-22 00:00:00", 7).where("path like '%04-15%'").first()
    assert exact.status == "kept"  # exactly at the cutoff is kept
    arch = rt.retention_plan(rt.mark_expired(inv, AS_OF, 7), "archive").first()
    assert (arch.archived, arch.deleted, arch.bytes_freed) == (2, 0, 207)
    dele = rt.retention_plan(rt.mark_expired(inv, AS_OF, 7), "delete").first()
    assert (dele.archived, dele.deleted, dele.bytes_freed) == (0, 2, 207)
    assert {r.path for r in rt.kept(rt.mark_expired(inv, AS_OF, 7)).collect()} == {
        "/d/digest_2026-04-22.md", "/d/digest_2026-04-01_x.md", "/d/digest_.md", "/d/other.md"}


def test_no_files(spark):
    r = rt.retention_plan(rt.mark_expired(_inv(spark, []), AS_OF, 7), "delete").first()
    assert (r.archived, r.deleted, r.bytes_freed) == (0, 0, 0)


def test_reports_by_mtime_from_real_files(spark, tmp_path):
    out = tmp_path / "output"
    out.mkdir()
    now = dt.datetime(2026, 4, 22, 12, 0, 0)
    for i, days in enumerate([0, 1, 5]):
        f = out / f"cycle_report_test_{i}.txt"
        f.write_text(f"report {i}")
        ts = (now - dt.timedelta(days=days)).timestamp()
        os.utime(f, (ts, ts))
    (out / "unrelated.txt").write_text("x")
    inv = read_file_inventory(spark, str(out), glob="cycle_report_*")
    m = rt.mark_expired(inv, now.strftime("%Y-%m-%d %H:%M:%S"), 2, by="mtime")
    plan = rt.retention_plan(m, "delete").first()
    assert (plan.deleted, plan.bytes_freed) == (1, len("report 2"))
    keep7 = rt.retention_plan(rt.mark_expired(inv, now.strftime("%Y-%m-%d %H:%M:%S"), 7, by="mtime"),
                              "archive").first()
    assert (keep7.archived, keep7.bytes_freed) == (0, 0)


def _digests(spark, live, days, fmt="text"):
    rows = [(d, f"# {d} é") for d in days]
    df = spark.createDataFrame(rows, "digest_date string, md string").repartition(2)
    getattr(df.write.mode("append").partitionBy("digest_date"), fmt)(live)


DAYS = ("2026-04-01", "2026-04-10", "2026-04-20", "2026-04-21")


@pytest.mark.parametrize("fmt", ["text", "parquet"])
@pytest.mark.parametrize("mode", ["archive", "delete"])
def test_apply_equals_the_plan_in_any_format(spark, tmp_path, fmt, mode):
    live, archive = str(tmp_path / "live"), str(tmp_path / "archive")
    _digests(spark, live, DAYS, fmt)
    inv = read_file_inventory(spark, live, recursive=True)
    before = {r.path: r.length for r in inv.collect()}
    plan = rt.retention_plan(rt.mark_expired(inv, AS_OF, 7, by="partition"), mode).first()
    done = rt.apply_retention(spark, live, AS_OF, 7, mode=mode, archive_path=archive).first()
    assert tuple(done)[:3] == tuple(plan) and done.partitions_removed == 2 and done.archived + done.deleted == 2
    left = {r.path for r in read_file_inventory(spark, live, recursive=True).collect()}
    assert left == {p for p in before if "04-2" in p}
    assert sorted(str(r.digest_date) for r in getattr(spark.read.format(fmt), "load")(live).collect()) == list(DAYS[2:])
    if mode == "archive":
        held = {r.path: bytes(r.content) for r in rt.read_archive(spark, archive).collect()}
        assert {p: len(c) for p, c in held.items()} == {p: n for p, n in before.items() if p not in left}
        if fmt == "text":
            assert sorted(c.decode() for c in held.values()) == ["# 2026-04-01 é\n", "# 2026-04-10 é\n"]


@pytest.mark.parametrize("crash", ["manifest", "archive", "delete"])
def test_apply_goes_on_after_a_crash(spark, tmp_path, monkeypatch, crash):
    """Cut off after any step, with a late file landing meanwhile: the same totals, nothing lost."""
    live, archive, manifest = (str(tmp_path / x) for x in ("live", "archive", "manifest"))
    _digests(spark, live, [f"2026-04-{d:02d}" for d in range(1, 22)])
    inv = read_file_inventory(spark, live, recursive=True)
    plan = tuple(rt.retention_plan(rt.mark_expired(inv, AS_OF, 7, by="partition")).first())
    run = lambda: rt.apply_retention(spark, live, AS_OF, 7, archive_path=archive, manifest=manifest).first()
    monkeypatch.setattr(rt, "BATCH_FILES", 4)
    if crash == "manifest":
        rt.write_manifest(rt.mark_expired(inv, AS_OF, 7, by="partition"), manifest, 4)
    else:
        real, calls = getattr(rt, "archive_batch" if crash == "archive" else "_delete"), []

        def fails(spark, files, *more):
            calls.append(1)
            out = real(spark, files.limit(1) if crash == "delete" and len(calls) == 2 else files, *more)
            if len(calls) == 2:
                raise RuntimeError("executor lost")
            return out
        monkeypatch.setattr(rt, "archive_batch" if crash == "archive" else "_delete", fails)
        rt.write_manifest(rt.mark_expired(inv, AS_OF, 7, by="partition"), manifest, 4)
        with pytest.raises(RuntimeError):
            run()
        monkeypatch.setattr(rt, "archive_batch" if crash == "archive" else "_delete", real)
    _digests(spark, live, ["2026-04-02"])  # lands late, in a folder that goes
    assert tuple(run())[:3] == plan and tuple(run())[:3] == plan
    days = sorted(str(r.digest_date) for r in spark.read.text(live).collect())
    assert days == ["2026-04-02", *[f"2026-04-{d}" for d in range(16, 22)]]
    assert sorted(bytes(r.content).decode() for r in rt.read_archive(spark, archive).collect()) == [f"# 2026-04-{d:02d} é\n" for d in range(1, 16)]


def test_a_file_changed_since_the_manifest_stays(spark, tmp_path):
    live, manifest = str(tmp_path / "live"), str(tmp_path / "m")
    _digests(spark, live, DAYS)
    inv = read_file_inventory(spark, live, recursive=True)
    rt.write_manifest(rt.mark_expired(inv, AS_OF, 7, by="partition"), manifest)
    changed = next((tmp_path / "live" / "digest_date=2026-04-01").glob("part*"))
    (changed.parent / f".{changed.name}.crc").unlink()
    changed.write_text("longer than it was before")
    rt.apply_manifest(spark, manifest, "archive", str(tmp_path / "archive")).collect()
    assert changed.exists() and not (tmp_path / "live" / "digest_date=2026-04-10").exists()


def test_reports_by_mtime_and_odd_names(spark, tmp_path):
    out = tmp_path / "output"
    out.mkdir()
    for name, days in (("cycle_report_[a].txt", 9), ("cycle_report_b*{1}.txt", 8), ("cycle_report_ c%41.txt", 8), ("cycle_report_d.txt", 1), ("other.txt", 30)):
        f = out / name
        f.write_text("x" * days)
        ts = (dt.datetime(2026, 4, 22, 12, tzinfo=dt.UTC) - dt.timedelta(days=days)).timestamp()
        os.utime(f, (ts, ts))
    done = rt.apply_retention(spark, str(out), AS_OF, 7, archive_path=str(tmp_path / "a"), by="mtime", glob="cycle_report_*").first()
    assert tuple(done) == (3, 0, 25, 0)
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == ["cycle_report_d.txt", "other.txt"]
    assert rt.read_archive(spark, str(tmp_path / "a")).count() == 3
    again = rt.apply_retention(spark, str(out), AS_OF, 7, mode="delete", by="mtime", glob="cycle_report_*").first()
    assert tuple(again) == (0, 0, 0, 0)


def test_dry_run_listing_in_name_order(spark):
    t = dt.datetime(2026, 4, 22)
    inv = _inv(spark, [("/d/digest_2026-04-02.md", t, 1), ("/d/digest_2026-04-01.md", t, 1),
                       ("/d/digest_2026-04-21.md", t, 1)])
    rows = [tuple(r) for r in rt.dry_run_listing(rt.mark_expired(inv, AS_OF, 7), "delete").collect()]
    assert rows == [("/d/digest_2026-04-01.md", "delete"), ("/d/digest_2026-04-02.md", "delete")]
