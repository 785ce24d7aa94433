"""Operators 11 to 13 against brute force, with the edge cases their docstrings define."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from feedlake.llm import fim, language_id, queries, quality, repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


# 11 -----------------------------------------------------------------------------------------------
def cut_by_hand(key, text):
    """(n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


def test_fill_in_middle_equals_cutting_by_hand(spark, monkeypatch):
    pick = random.Random(5)
    letters = "abcZ é😀ñ<>PSM0\n 　"
    texts = [None, "", "a", "<", "<P", "<P>", "x<S>y", "<<M>", "aé" * 3000, "word " * 30000]
    texts += ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) for _ in range(600)]
    df = documents(spark, texts)
    df = df.unionByName(df.limit(40)).unionByName(df.limit(30).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    df = df.selectExpr("*", "1 as n", "2 as form", "'x' as output", "3 as h1")  # clashing names
    got = fim.round_trip(df).collect()
    want = sorted((cut_by_hand(r.doc_id, r.text) + (r.text or "", repr(r.doc_id)) for r in df.collect()), key=repr)
    assert sorted(((r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored, repr(r.doc_id)) for r in got), key=repr) == want
    assert {"plain", "psm", "spm"} == {r.form for r in got}
    # the two halves alone give the same; so do slices of a few rows
    made = fim.transform(df)
    again = fim.restore(made.select("form", "doc_id", "output"))
    assert sorted((repr(r.doc_id), r.text) for r in again.collect()) == sorted((w[-1], w[-2]) for w in want)
    assert fim.round_trip(df.limit(0)).count() == 0


def test_fill_in_middle_parts_of_a_batch():
    import pyarrow as pa

    texts = pa.array(["ab c", None, "é<", "x" * 50, ""] * 20)
    h = [np.arange(100) * k for k in (7, 13, 1, 3)]
    whole = fim.move(texts, h, fim.Rule())
    parts = [fim.move(texts.slice(i, 9), [x[i : i + 9] for x in h], fim.Rule()) for i in range(0, 100, 9)]
    for c in range(5):
        assert whole[c].to_pylist() == [v for p in parts for v in p[c].to_pylist()]
    back = fim.put_back(whole[0].slice(3, 40), whole[1].slice(3, 40), fim.Rule())
    assert back.to_pylist() == [t or "" for t in texts.to_pylist()[3:43]]


def test_fill_in_middle_rule():
    with pytest.raises(ValueError):
        fim.Rule(prefix=b"P")
    with pytest.raises(ValueError):
        fim.Rule(prefix=b"<S>")


def test_fill_in_middle_other_markers(spark):
    rule = fim.Rule(prefix=b"<PRE>", suffix=b"<SUF>", middle=b"<MID>", seed=9, moved_percent=100, spm_percent=50)
    df = documents(spark, [f"some text {i}, and <P> more é{i}" for i in range(60)])
    got = fim.round_trip(df, rule=rule).collect()
    assert {r.form for r in got} == {"psm", "spm"} and all(r.restored == f"some text {r.doc_id}, and <P> more é{r.doc_id}" for r in got)
    assert all(r.output.startswith("<PRE>" if r.form == "psm" else "<SUF>") and len(r.output) == len(r.restored) + 15 for r in got)


# 12 -----------------------------------------------------------------------------------------------
def test_language_id_on_held_out_documents(spark, sf_small):
    root = f"{sf_small}/../sf0.01"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    got = queries.op12_language_id(spark, root).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_does_not_see_its_labels(spark, sf_small):
    """Held-out labels and sources change nothing, nor does the order of rows."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    other = docs.selectExpr("doc_id", "case when crc32(cast(string(doc_id) as binary)) % 5 = 0 then 'xx' else lang end lang", "text").orderBy("text")
    a, b = (language_id.predict(docs.select("doc_id", "text"), language_id.train(d)).collect() for d in (docs, other))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_language_id_edges(spark):
    texts = ["der die das und", "the cat and the dog", "el perro y la casa", "le chien et la maison"] * 30
    langs = ["de", "en-GB", "es", "fr"] * 30
    rows = [(i, t + f" {i}", x, "s", 0) for i, (t, x) in enumerate(zip(texts, langs, strict=True))]
    rows += [(200, None, "en-GB", "s", 0), (201, "", "de", "s", 0), (202, "123 !?", "de", "s", 0), (None, "der die das und", "xx", "s", 0),
             (203, "der die das und", None, "s", 0), (203, "der die das und", None, "s", 0), (204, "le chien " * 50000, "fr", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'q' as lang_pred", "'z' as score", "1 as place", "2 as one", "3 as mixed")
    model = language_id.train(df)
    got = language_id.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "place", "one", "mixed", "lang_pred", "score"]
    found = {(r.doc_id, r.text): r for r in got.collect()}
    assert len(got.collect()) == len(rows)
    assert all(found[200 + i, t].lang_pred == "und" and found[200 + i, t].score == 0 for i, t in enumerate([None, "", "123 !?"]))
    assert found[None, "der die das und"].lang_pred == found[203, "der die das und"].lang_pred == "de"
    assert found[204, "le chien " * 50000].lang_pred == "fr"
    assert all(r.lang_pred == r.lang for (i, _), r in found.items() if i is not None and i < 120)
    nothing = language_id.predict(df, language_id.train(df.limit(0))).collect()
    assert all((r.lang_pred, r.score) == ("und", 0) for r in nothing)
    one = language_id.predict(df, language_id.train(df.where("lang = 'fr'"))).where("doc_id = 1").collect()[0]
    assert one.lang_pred == "fr"
    assert language_id.predict(df.limit(0), model).count() == 0


def test_language_id_counts_do_not_depend_on_chunks(monkeypatch):
    text = "".join(random.Random(2).choice("abcdé ,.") for _ in range(2000))
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "CHUNK", 97)
    assert np.array_equal(whole, language_id.counts(text)) and whole.sum() > 4000


def test_language_id_families():
    assert [language_id.family(x) for x in ("de", "en_US", "FR-ca", "qq")] == ["germanic", "germanic", "romance", "qq"]


# 13 -----------------------------------------------------------------------------------------------
BLANK, SPACE = " \t\n\x0b\x0c\r", " "


def damaged_by_hand(rows):
    """rows: (turn, role, text) of one conversation ``conv``; as the contract words it."""
    def one(conv, turn, role, text):
        role, text = SPACE if role is None else role, SPACE if text is None else text
        kind = zlib.crc32(f"{SPACE if conv is None else conv}:{SPACE if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        return [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return [x for r in rows for x in one(*r)]


def cheapest(kinds):
    """Least (cost, audit, emitted) by relaxation from the end. kinds: (initial, must go, truncated) per row."""
    best = {}
    for k in range(len(kinds), -1, -1):
        for s in "-sua":
            best[k, s] = (0, "", ()) if k == len(kinds) and s in "-a" else (10**9, "", ())
        for _ in range(4):
            for s in "-sua":
                follow = "a" if s == "u" else "u"
                options = [best[k, s]]
                c, a, e = best[k, follow]
                options.append((c + 5, "I" + a, ((None, follow), *e)))
                if k < len(kinds):
                    initial, must_go, cut = kinds[k]
                    c, a, e = best[k + 1, s]
                    options.append((c + 2, "D" + a, e))
                    if not must_go:
                        c, a, e = best[k + 1, follow]
                        options.append((c + 1 + 5 * cut, "R" + a, ((k, follow), *e)))
                        if initial == follow or initial == "s" and s == "-":
                            c, a, e = best[k + 1, initial]
                            options.append((c + 5 * cut, "K" + a, ((k, None), *e)))
                best[k, s] = min(options)[:3]
    return best[0, "-"]


def repaired_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    kinds = [(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True)]
    cost, audit, emitted = cheapest(kinds)
    names = {"u": "user", "a": "assistant"}
    said = [f"{names[to] if to else rows[k][1]}:{rows[k][2] if k is not None else ''}" for k, to in emitted]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(said)))


def by_hand(table):
    groups = {}
    for r in table:
        groups.setdefault(r[0], []).append(r)
    return sorted(((c, *repaired_by_hand(damaged_by_hand(rows))) for c, rows in groups.items()), key=repr)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("block", [1, 3, 64])
def test_auction_equals_relaxation(block):
    pick = random.Random(block)
    for i in range(700):
        codes = "".join(pick.choice("xsuaoSUAOuaua") for _ in range(pick.randint(0, 14 if i < 600 else 70)))
        cost, audit, plan = repair.repair_codes(codes, block)
        want = cheapest([(c.lower(), c == "x", c.isupper()) for c in codes])
        assert (cost, audit) == want[:2], codes
        assert [(v // 3, v % 3) for v in plan] == [(len(codes) if k is None else k, {None: 0, "u": 1, "a": 2}[to]) for k, to in want[2]]


def test_auction_of_a_long_conversation():
    import time

    codes = "suaaUxuaAo" * 2000
    began = time.time()
    cost, audit, plan = repair.repair_codes(codes)
    assert time.time() - began < 20 and len(audit) >= len(codes) and cost > 0
    shown = "".join({1: "u", 2: "a"}.get(v % 3) or codes[v // 3].lower() for v in plan)
    assert re.fullmatch("(s?(ua)+)?", shown)


def test_conversation_repair_equals_brute_force_on_driver_tables(spark, sf_small):
    for at in (sf_small, f"{sf_small}/../sf0.01"):
        got = sorted(map(tuple, queries.op13_conversation_repair(spark, at).select(*COLUMNS).collect()), key=repr)
        assert got == by_hand(map(tuple, spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))


def test_conversation_repair_equals_brute_force_on_odd_rows(spark):
    pick = random.Random(8)
    roles = ["user", "assistant", "system", "User", "", None, "tool", "u", "user", "assistant"]
    texts = ["Hi.", "No", " \t", "", None, "a.b! \r\n", "Hi.", "?", "é", "x。", "so? "]
    table = [(pick.choice([None, *range(120)]), pick.choice([None, *range(12), -3, 10**9]), pick.choice(roles), pick.choice(texts)) for _ in range(1500)]
    table += [(500, t, "user" if t % 2 else "assistant", "long " * 9000 + ".") for t in range(40)] + [(501, 1, None, None)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.selectExpr("*", "1 as copy", "2 as fault", "'x' as lost", "3 as rows", "4 as audit")  # clashing names
    digest = repair.repair(repair.damage(df), repair.F.col("lost")).withColumn(
        "repaired_sha256", repair.F.sha2(repair.transcript(), 256))
    assert sorted(map(tuple, digest.select(*COLUMNS).collect()), key=repr) == by_hand(table)
    assert repair.repair(df).count() == len({r[0] for r in table})
    assert repair.repair(repair.damage(df.limit(0)), repair.F.col("lost")).count() == 0


def test_conversation_with_nothing_left(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    r = repair.repair(repair.damage(df), repair.F.col("lost")).collect()[0]
    assert tuple(r)[:8] == (lost, 0, 0, 0, 0, 0, 0, "") and r.messages == []
    assert repair.repair(df).collect()[0].audit == "D"  # a lone user turn: deleting (2) is cheaper than a reply (5)


def test_quality_fold_is_the_contracts(spark):
    got = spark.range(50).select("id", quality.fold(repair.F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


# pipeline -----------------------------------------------------------------------------------------
def test_near_duplicate_stage_equals_brute_force(spark):
    """Ids repeated with unlike texts, with copies and with near copies of other ids."""
    import corpus_pipeline as pipe

    pick = random.Random(4)
    def text(n):
        return " ".join(pick.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(pick.randint(0, 99)) for _ in range(n))
    a, b, c = text(80), text(70), text(60)
    near_a = " ".join(a.split()[:-1]) + " other"
    rows = [(5, a), (5, b), (2, near_a), (7, c), (7, c.upper()), (7, c + "  "), (9, c), (11, None), (11, " "), (11, None), (None, a), (None, a),
            (20, text(40)), (20, text(40)), (21, "one two"), (22, "One  two"), (4, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS).repartition(3)
    kept = [(r.doc_id, r.text) for r in pipe.near_duplicate_stage(spark, docs, "").collect()]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return frozenset(map(tuple, (w[i : i + 5] for i in range(len(w) - 4)) if len(w) >= 5 else [w] if w else []))
    sets = sorted({shingles(t) for i, t in rows if i is not None} - {frozenset()}, key=sorted)
    group = {s: s for s in sets}
    for _ in sets:
        for x in sets:
            for y in sets:
                if 100 * len(x & y) >= 80 * len(x | y):
                    group[x] = group[y] = min(group[x], group[y], key=sorted)
    classes = {}
    for i, t in rows:
        if i is not None and shingles(t):
            classes.setdefault(group[shingles(t)], []).append(i)
    assert sorted(i for i, t in kept if i is not None and shingles(t)) == sorted(min(v) for v in classes.values())
    assert sorted(((i, t) for i, t in kept if i is None or not shingles(t)), key=repr) == sorted(((i, t) for i, t in rows if i is None or not shingles(t)), key=repr)
    assert (2, near_a) in kept and (4, b) in kept and (7, min(t for i, t in rows if i == 7)) in kept and sum(i == 20 for i, _ in kept) == 2


def test_scratch_removes_all_but_what_is_kept(spark):
    from feedlake.llm import common

    with common.scratch(spark) as kept:
        gone, stays, empty = (common.materialize(spark.range(n), "t") for n in (3, 4, 0))
        files = gone.inputFiles()
        kept.append(stays)
    assert stays.count() == 4 and files
    with pytest.raises(Exception, match="not exist|FileNotFound|FAILED_READ"):
        spark.read.parquet(files[0]).count()


def test_quality_stage_equals_scoring_row_by_row(spark, sf_small):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    kept = {r.doc_id for r in pipe.quality_stage(spark, docs, sf_small).collect()}
    model = quality.train(docs.select(*pipe.COLUMNS), spark.read.parquet(f"{sf_small}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if model.score([quality.features(r.text, r.n_chars)])[0] >= quality.THRESHOLD}
    assert kept == want and 0 < len(want) < docs.count()


def test_score_keeps_columns_with_clashing_names(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(20)
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    odd = docs.selectExpr("*", "'a' as _text", "2 as _n", "'x' as score", "'y' as i", "'z' as predicted")
    got = quality.score(odd, model)
    assert got.columns == [*docs.columns, "_text", "_n", "i", "score", "predicted"]
    plain = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert {(r._text, r._n, r.i) for r in got.collect()} == {("a", 2, "y")} and {r.doc_id: r.score for r in got.collect()} == plain


def test_repeats_are_decided_by_a_semi_join(spark):
    from feedlake.llm import repeats
    rows = [(d, 0, 0, 0, 1, 7, 1, 1) for d in range(300)] + [(d, 0, 9, 0, 1, 7, 2, d) for d in range(40)]
    entries = spark.createDataFrame(rows, "doc long, h long, p int, lo int, hi int, g long, s1 long, s2 long")
    decided, _, _ = repeats._level(entries, ["g"], ["s1", "s2"], False, False)
    plan = decided._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Inner" not in plan, plan
    assert sorted(r.doc for r in decided.collect()) == list(range(300))
