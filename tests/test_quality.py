"""Health: error-line scan, probe classification, scorecards, gate."""
import datetime as dt


from feedlake.operators import quality as qa


def test_error_lines(spark):
    lines = ["ERROR: fetch failed", "no errors today", "zero errors and no failures", "terror alert",
             "Traceback (most recent call last)", "Phase 2 exception handler", "all good",
             "Failure check passed", "an exception occurred", "error-free run with error"]
    df = spark.createDataFrame([(l,) for l in lines], "line string")
    got = [r.e for r in df.select(qa.is_error_line("line").alias("e")).collect()]
    assert got == [True, False, False, False, True, False, False, False, True, False]


def test_error_scan_newest_reports(spark):
    t0 = dt.datetime(2026, 4, 1)
    files = spark.createDataFrame([(f"r{i}", t0 + dt.timedelta(days=i), 1) for i in range(12)],
                                  "path string, modificationTime timestamp, length long")
    lines = spark.createDataFrame([(f"r{i}", "error here") for i in range(12)], "path string, line string")
    scan = qa.error_scan(lines, files, newest=10)
    assert sorted(r.path for r in scan.collect()) == sorted(f"r{i}" for i in range(2, 12))
    assert qa.error_total(scan).first().n_errors == 10


def _checks(spark, rows):
    return spark.createDataFrame(
        [(dt.datetime(2026, 4, 22), k, t, m, s, a) for k, t, m, s, a in rows],
        "cycle_ts timestamp, kind string, target string, method string, status int, attempt long")


def test_classify_reference_cases(spark):
    rows = [("arxiv", "api", "GET", 200, 1), ("arxiv", "api2", "GET", 429, 1), ("arxiv", "api3", "GET", 500, 1),
            ("feed", "u1", "HEAD", 200, 1), ("feed", "u2", "HEAD", 405, 1), ("feed", "u2", "GET", 200, 2),
            ("feed", "u3", "HEAD", 405, 1), ("feed", "u4", "HEAD", 404, 1), ("feed", "u5", "HEAD", 429, 1)]
    o = {r.target: (r.ok, r.status) for r in qa.classify_checks(_checks(spark, rows)).collect()}
    assert o == {"api": (True, 200), "api2": (True, 429), "api3": (False, 500), "u1": (True, 200),
                 "u2": (True, 200), "u3": (False, 405), "u4": (False, 404), "u5": (False, 429)}
    d = qa.feed_details(qa.classify_checks(_checks(spark, rows))).first()
    assert d.all_ok is False and d.n_feeds == 5 and d.details["u2"].ok is True


def test_scorecard_grades_and_gate(spark):
    def card(n_ok, n):
        rows = [("feed", f"t{i}", "GET", 200 if i < n_ok else 500, 1) for i in range(n)]
        return qa.scorecard(qa.classify_checks(_checks(spark, rows))).first()
    assert [card(k, 10).grade for k in (10, 9, 8, 7, 6)] == ["A", "A", "B", "C", "D"]
    c = card(4, 7)  # 0.571...
    assert (c.grade, c.passed, c.score_2dp) == ("D", False, 0.57)
    gates = spark.createDataFrame([("c1", "tests", True), ("c1", "health", None), ("c2", "errors", False)],
                                  "cycle string, gate string, ok boolean")
    g = {r.cycle: r.action for r in qa.release_gate(gates, ["cycle"]).collect()}
    assert g == {"c1": "FAST-FORWARD", "c2": "INVESTIGATE"}


def test_latest_artifact(spark):
    t0 = dt.datetime(2026, 4, 1)
    inv = spark.createDataFrame([("/d/digest_2026-04-01.md", t0, 5000), ("/d/digest_2026-04-02.md",
                                 t0 + dt.timedelta(days=1), 900), ("/d/other.md", t0 + dt.timedelta(days=5), 1),
                                 ("/d/digestX.md", t0 + dt.timedelta(days=6), 1)],
                                "path string, modificationTime timestamp, length long")
    r = qa.latest_artifact(inv).first()
    assert (r.path, r.length, r.ok) == ("/d/digest_2026-04-02.md", 900, False)


def test_gate_inputs(spark):
    runs = spark.createDataFrame([("c1", True, 0.02), ("c2", True, 6.0), ("c3", False, 0.1), ("c4", True, None)],
                                 "cycle string, ok boolean, duration_sec double")
    t = {r.cycle: r.ok for r in qa.test_run_gate(runs, ["cycle"]).collect()}
    assert t == {"c1": True, "c2": False, "c3": False, "c4": False}
    st = spark.createDataFrame([("c1", "?? new.txt"), ("c2", " M file.py"), ("c2", "?? x")],
                               "cycle string, line string")
    g = {r.cycle: r.ok for r in qa.clean_tree_gate(st, ["cycle"]).collect()}
    assert g == {"c1": True, "c2": False}
    gates = qa.test_run_gate(runs, ["cycle"]).unionByName(qa.clean_tree_gate(st, ["cycle"]))
    acts = {r.cycle: r.action for r in qa.release_gate(gates, ["cycle"]).collect()}
    assert acts == {"c1": "FAST-FORWARD", "c2": "INVESTIGATE", "c3": "INVESTIGATE", "c4": "INVESTIGATE"}


def test_release_gate_query_has_five_gates(spark, sf_small):
    from feedlake.plans import catalog as C
    gates = C.release_gates(spark, sf_small)
    assert {r.gate for r in gates.select("gate").distinct().collect()} == {"health", "report_errors", "digest_size", "tests", "clean_tree"}
    assert gates.groupBy("cycle", "gate").count().where("count > 1").count() == 0
    lone = spark.createDataFrame([("c", "health", None)], "cycle string, gate string, ok boolean")
    assert qa.release_gate(lone, ["cycle"], required=["tests", "clean_tree"]).first().action == "INVESTIGATE"
