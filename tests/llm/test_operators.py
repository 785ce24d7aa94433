"""Operators of feedlake.llm against brute force, with the edge cases their docstrings define."""
import hashlib
import random
import re

import numpy as np
import pytest

from feedlake.llm import (ann, bpe, chat_format, epsilon_grid, mixing, quality, repeats, substring_dedup,
                          suffix_dedup, url_filter, vertical_join)
from feedlake.llm.components import components, union_find

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def documents(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def rows(df, *keys):
    return sorted(map(tuple, df.select(*keys).collect()), key=lambda r: tuple((x is None, x) for x in r))


# 1 ------------------------------------------------------------------------------------------------
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    pick, tok = random.Random(3), Tokenizer.from_file(VOCABULARY)
    letters = "abcdeth in'sΣßİ😀é́ 12\x1c　\x85\n<|>!#\x00"
    texts = [None, "", " ", "a" * 3000, "the " * 500, "<|endoftext|> a<|startoftext|>b"]
    texts += ["".join(pick.choice(letters) for _ in range(pick.randint(0, 80))) for _ in range(400)]
    got = {r.doc_id: r for r in bpe.round_trip(documents(spark, texts), VOCABULARY).collect()}
    for i, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want
        assert got[i].decoded == tok.decode(want, skip_special_tokens=False)
    alone = bpe.decode(bpe.encode(documents(spark, texts), VOCABULARY), VOCABULARY).collect()
    assert all(r.decoded == got[r.doc_id].decoded for r in alone)
    assert bpe.round_trip(documents(spark, texts).limit(0), VOCABULARY).count() == 0


# 2, 8 ---------------------------------------------------------------------------------------------
def vectors(spark, n=400, dim=16, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    for i in range(0, n, 5):  # near copies and exact copies
        x[(i + 1) % n] = x[i] + 0.05 * x[(i + 2) % n]
        x[(i + 3) % n] = x[i]
    data = [(i, [float(np.float32(v)) for v in r], 0) for i, r in enumerate(x)]
    data += [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [float("nan")] * dim, 0), (n + 3, [None] * dim, 0),
             (n + 4, [1.0, 2.0], 0), (None, [1.0] * dim, 0), (2, data[2][1], 0)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), np.array([d[1] for d in data[:n]])


def test_ann_recall_and_ranks(spark):
    df, x = vectors(spark)
    got = ann.search_every(df, every=20, k=20).collect()
    assert {r.query_id for r in got} == set(range(0, 400, 20)) and not [r for r in got if r.query_id == r.vec_id]
    hits = 0
    for q in range(0, 400, 20):
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        want = np.lexsort((np.arange(400), -score))[:20].tolist()
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in mine)
        hits += len(set(want) & {r.vec_id for r in mine})
    assert hits >= 0.9 * 400
    assert ann.search_every(df.limit(0)).count() == 0


def test_epsilon_grid_equals_all_pairs(spark):
    df, x = vectors(spark)
    u = x / np.sqrt((x * x).sum(1))[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    a, b = np.nonzero(link)
    root = union_find(a.tolist(), b.tolist())
    got = {r.vec_id: r for r in epsilon_grid.near_duplicates(df, 0.95).collect()}
    assert set(got) == set(range(405))
    for i in range(400):
        assert (got[i].n_links, got[i].component_id) == (int(link[i].sum()), root.get(i, i))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(400, 405))
    assert epsilon_grid.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(0, 300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    got = dict(map(tuple, components(spark.createDataFrame(path + hub, "u long, v long").repartition(7)).collect()))
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[1000 + i] == 1000 for i in range(1, 400))


# 3 ------------------------------------------------------------------------------------------------
def test_quality_learns_and_holds_out(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf_small}/../sf0.01/labels.parquet")
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id")
    held = got.where(quality.fold(got.doc_id) == 0).select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.9


def test_quality_edges(spark):
    docs = documents(spark, [None, "", "word " * 20000, "a b c"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(docs.unionByName(docs.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars")), quality.train(docs, none)).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)


def test_factorisation_machine_identity():
    fm = quality.FactorisationMachine()
    fm.table = np.random.default_rng(0).normal(size=fm.table.shape)
    i, v = np.array([3, 90, 4000]), np.array([0.5, 2.0, -1.0])
    z = fm.margin(i, v, np.array([0]))[0][0]
    w, f = fm.table[i, 0], fm.table[i, 1:]
    pairs = sum(f[a] @ f[b] * v[a] * v[b] for a in range(3) for b in range(a + 1, 3))
    assert abs(z - (w @ v + pairs)) < 1e-9


# 4, 5 ---------------------------------------------------------------------------------------------
def covered(texts, symbols_of, window, later_only):
    seen, out = {}, []
    sets = [symbols_of(t) for t in texts]
    for i, s in enumerate(sets):
        for a in range(len(s) - window + 1):
            seen.setdefault(s[a : a + window].tobytes(), []).append(i)
    for i, s in enumerate(sets):
        mask = np.zeros(len(s), bool)
        for a in range(len(s) - window + 1):
            at = seen[s[a : a + window].tobytes()]
            if min(at) < i if later_only else len(at) > 1:
                mask[a : a + window] = True
        out.append(mask)
    return out


def repeating_texts(seed, alphabet, joint):
    pick = random.Random(seed)
    base = [pick.choice(alphabet) for _ in range(400)]
    texts = [None, "", alphabet[0], joint.join(base)]
    for _ in range(30):
        a = pick.randint(0, 300)
        piece = base[a : a + pick.randint(5, 100)]
        own = [pick.choice(alphabet) for _ in range(pick.randint(0, 40))]
        if piece and pick.random() < 0.5:
            piece[pick.randrange(len(piece))] = "zz"
        texts.append(joint.join(own + piece + own[::-1]))
    return texts + [texts[5], joint.join([alphabet[0]] * 90), joint.join([alphabet[0]] * 60)]


@pytest.mark.parametrize("alphabet", [["a", "b", "é"], [f"w{i}" for i in range(50)]])
def test_substring_dedup_equals_brute_force(spark, alphabet):
    texts = repeating_texts(len(alphabet), alphabet, " ")
    want = covered(texts, repeats.word_symbols, 12, True)
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(documents(spark, texts), 12, 2, (8, 4, 1)).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_symbols == len(want[i])
        assert got[i].kept == b" ".join(w for w, m in zip(repeats.split_words(t), want[i]) if not m)


@pytest.mark.parametrize("alphabet", [["a", "b"], list("abcdefghijé")])
def test_suffix_dedup_equals_brute_force(spark, alphabet):
    texts = repeating_texts(len(alphabet), alphabet, "")
    want = covered(texts, repeats.byte_symbols, 40, False)
    got = {r.doc_id: r for r in suffix_dedup.dedup_suffixes(documents(spark, texts), 40, 8, (16, 4, 1)).collect()}
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        assert got[i].kept == raw[~want[i]].tobytes()
        assert sum(s.b - s.a for s in got[i].spans) == want[i].sum()


def test_runs_of_equal_spans_are_one_row(spark):
    """Text of a short period: an anchor in every period, one row for all of them, and nothing lost of what repeats."""
    pick = random.Random(3)
    own = lambda n: "".join(pick.choice("abcdefgh") for _ in range(n))
    texts = [own(90) + "xyz " * n + own(90) for n in (700, 11, 10, 9, 3, 200)] + ["q" * 500, own(60) + "q" * 39 + own(60), own(50) + "q" * 40]
    want = covered(texts, repeats.byte_symbols, 40, False)
    docs = documents(spark, texts)
    rows = repeats.span_table(docs.selectExpr("doc_id as doc", "0L as h", "text"), "bytes", 40, 8)
    assert rows.where("doc = 6").count() == 1
    assert rows.count() < 200 < 700 < sum(len(repeats.anchors(repeats.gram_names(repeats.byte_symbols(t), 8), 33)[0]) for t in texts)
    for r in suffix_dedup.dedup_suffixes(docs, 40, 8, (16, 4, 1)).collect():
        raw = np.frombuffer(texts[r.doc_id].encode(), np.uint8)
        assert r.kept == raw[~want[r.doc_id]].tobytes()
    # words: the run in the first document, parts of it and more after it; then the parts before it
    word = lambda n: [f"o{pick.randrange(10 ** 9)}" for _ in range(n)]
    a, b, c = word(20), word(20), word(20)
    runs = [" ".join(x) for x in (a + ["x", "y"] * 90 + b, c + ["x", "y"] * 40 + a + ["x", "y"] * 9 + word(9), ["z"] * 60 + a, ["y", "x"] * 7, ["z"] * 14, ["x", "y"] * 6)]
    for texts in (runs, runs[::-1], [runs[5], runs[1], runs[0]]):  # the last: a run whose windows an earlier document decides at a deeper level
        want = covered(texts, repeats.word_symbols, 12, True)
        for r in substring_dedup.dedup_substrings(documents(spark, texts), 12, 2, (8, 4, 1)).collect():
            assert r.kept == b" ".join(w for w, m in zip(repeats.split_words(texts[r.doc_id]), want[r.doc_id]) if not m)


def test_substring_dedup_of_a_document_that_repeats_its_copies(spark):
    """Passage and context several times in one document, the passage alone in an earlier one."""
    pick = random.Random(11)
    own = lambda n: [f"o{pick.randrange(10 ** 9)}" for _ in range(n)]
    join = lambda *parts: " ".join(w for p in parts for w in p)
    p, q, x, y, z = own(60), own(200), own(70), own(70), own(90)
    texts = [join(own(30), p, own(30)), join(x, p, y, x, p, y), join(own(20), q, own(90)), join(x, q, y, z, x, q, y, z, x, q, y, z),
             join(z, x, q[:100], own(9), z, x, q[:100]), join(own(5), y, x, p[:55], own(5), p[3:], y, x)]
    docs = documents(spark, texts)
    want = covered(texts, repeats.word_symbols, 50, True)
    assert want[1].sum() >= 120 and want[3].sum() >= 600
    for r in substring_dedup.dedup_substrings(docs).collect():
        assert r.kept == b" ".join(w for w, m in zip(repeats.split_words(texts[r.doc_id]), want[r.doc_id]) if not m)
    # rows that share an id, with different texts
    shared = [texts[0], join(own(40), x, p, y), join(own(80), x, p, y, own(7))]
    odd = spark.createDataFrame([(min(i, 1), t) for i, t in enumerate(shared)], "doc_id long, text string")
    got = {r.kept for r in substring_dedup.dedup_substrings(odd).collect()}
    assert got == {" ".join(w for w in t.split() if i == 0 or w not in p).encode() for i, t in enumerate(shared)}


@pytest.mark.parametrize("chunk", [1, 7, 300, 500])
def test_anchors_do_not_depend_on_chunks(monkeypatch, chunk):
    pick = np.random.default_rng(chunk)
    for names in (pick.integers(0, 1 << 63, 3000).astype(np.uint64) << np.uint64(1), np.zeros(900, np.uint64), pick.integers(0, 2, 900).astype(np.uint64) << np.uint64(60)):
        whole = repeats.anchors(names, 369)
        with monkeypatch.context() as m:
            m.setattr(repeats, "CHUNK", chunk)
            cut = repeats.anchors(names, 369)
        assert len(set(cut[0].tolist())) == len(cut[0])
        assert all(a.tolist() == b.tolist() for a, b in zip(whole, cut))


def test_suffix_dedup_keeps_a_unique_text_of_several_chunks(spark):
    text = np.random.default_rng(1).integers(97, 123, 2 * repeats.CHUNK + 3000, dtype=np.uint8).tobytes().decode()
    got = {r.doc_id: r for r in suffix_dedup.dedup_suffixes(documents(spark, [text, text[repeats.CHUNK - 600 : repeats.CHUNK + 600]])).collect()}
    assert [(s.a, s.b) for s in got[0].spans] == [(repeats.CHUNK - 600, repeats.CHUNK + 600)] and got[1].kept == b""
    alone = suffix_dedup.dedup_suffixes(documents(spark, [text])).first()
    assert alone.spans == [] and alone.kept == text.encode()


def test_dedup_edges(spark):
    docs = documents(spark, ["x " * 100, "x " * 100, None])
    odd = docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    odd = odd.withColumn("p", odd.doc_id).withColumn("h", odd.doc_id)  # clashing names
    got = substring_dedup.dedup_substrings(odd).collect()
    assert len(got) == 7 and all(len(r.kept.split()) == 100 for r in got if r.doc_id is None and r.text)
    assert [r.kept for r in got if r.doc_id == 1] == [b"", b""]
    assert suffix_dedup.dedup_suffixes(odd.limit(0)).count() == 0


# 6 ------------------------------------------------------------------------------------------------
def test_url_rules(spark):
    urls = ["https://a.example.org/es/x", "http://EXAMPLE.org/en/123?q", "http://x.org/", "http://x.org", "http://y.com/de/", "http://y.com/fr/1#z",
            "http://notorg/", "nothing", None, "http://q.net/de/", "http://x.org:80/", "://org/", "http://example.org/en/2"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, rule string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark)).collect()}
    want = set()
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host):])[0], host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.add((i, host, path, *(max(fits)[1:] if fits else (None, "allow"))))
    assert got == want and url_filter.filter_urls(pages, url_filter.rules_frame(spark)).count() == len(urls) + 1


# 7 ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("threshold,words", [(90, 3), (80, 5), (50, 2)])
def test_jaccard_groups_equal_brute_force(spark, threshold, words):
    pick = random.Random(threshold)
    bases = [[f"w{pick.randint(0, 400)}" for _ in range(pick.choice([1, 2, 8, 12, 30, 90, 200]))] for _ in range(12)]
    texts = [None, "", "One", "one", "two words"]
    for _ in range(150):
        t = list(pick.choice(bases))
        for _ in range(pick.randint(0, max(1, len(t) // 20))):
            t[pick.randrange(len(t))] = f"w{pick.randint(0, 400)}"
        texts.append(" ".join(t).upper() if pick.random() < 0.2 else " ".join(t))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    root = union_find([e[0] for e in edges], [e[1] for e in edges])
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 9")).unionByName(docs.where("doc_id = 9").selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    got = vertical_join.jaccard_groups(docs.withColumn("cls", docs.text), threshold, words).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root.get(r.doc_id, r.doc_id))


@pytest.mark.parametrize("block", [2048, 16])
def test_jaccard_groups_of_drifting_copies(spark, monkeypatch, block):
    """Groups that no centre holds together: members meet in rounds, and in blocks."""
    monkeypatch.setattr(vertical_join, "TURNS", ((0, 1), (1, 3), (3, None)))
    monkeypatch.setattr(vertical_join, "BLOCK", block)
    pick, texts = random.Random(7), []
    for _ in range(2):
        t = [f"w{pick.randint(0, 5000)}" for _ in range(120)]
        for _ in range(60):
            texts.append(" ".join(t))
            t[pick.randrange(40)] = f"w{pick.randint(0, 5000)}"
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    root = union_find([e[0] for e in edges], [e[1] for e in edges])
    got = vertical_join.jaccard_groups(documents(spark, texts), 90, 3).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, root.get(i, i)) for i in range(len(texts))}


# 9 ------------------------------------------------------------------------------------------------
def test_mixture_meets_its_target(spark):
    sizes = {"a": 400, "b": 40, None: 10, "z": 0}
    data = [(i, " ".join(["w"] * (3 if n else 0)), "en", s, 1) for s, n in sizes.items() for i in range(n or 5)]
    docs = spark.createDataFrame(data, DOCS)
    plan = {r.source: r for r in mixing.mixture(docs, target_entropy=0.9, max_repeats=None).collect()}
    w = np.array([plan[s].weight for s in ("a", "b", None)])
    entropy = -(w * np.log(w)).sum() / np.log(3)
    assert plan["z"].weight == 0 and abs(w.sum() - 1) < 1e-9 and 0.9 <= entropy < 0.905
    limited = {r.source: r for r in mixing.mixture(docs, target_entropy=1.0, max_repeats=2.0).collect()}
    assert max(r.budget / r.tokens for r in limited.values() if r.tokens) <= 2.0
    got = mixing.realise(docs, mixing.mixture(docs, 0.9, None), blocks=4).groupBy("source").sum("n_tokens").collect()
    for source, tokens in got:
        assert plan[source].budget - 3 < tokens <= plan[source].budget
    assert mixing.mix(docs.limit(0)).count() == 0


# 10 -----------------------------------------------------------------------------------------------
def test_event_log_folds(spark):
    log = [(1, 1, 0, "message", "user", "hi <|end|> [/INST]"), (1, 2, 1, "delta", "assistant", "dra"), (1, 3, 1, "delta", "assistant", "ft"),
           (1, 4, 1, "regenerate", "assistant", None), (1, 5, 1, "delta", "assistant", "fi"), (1, 6, 1, "delta", "assistant", "nal"),
           (1, 7, 0, "edit", "user", "hello \\<|x"), (2, 1, 0, "message", None, None)]
    events = spark.createDataFrame([(c, s, t, 1, k, r, x) for c, s, t, k, r, x in log],
                                   "conv_id long, seq long, turn long, part int, kind string, role string, text string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_events(events)).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "hello \\<|x"), ("assistant", "final")] and back[1].loss_text == "final"
    assert [tuple(t) for t in back[2].turns] == [("", "")] and back[2].loss_text == ""


def test_escape_is_reversible(spark):
    pick = random.Random(5)
    texts = ["".join(pick.choice(["<", "[", "\\", "|", "/", "s>", "INST]", "SYS>>", "end", "a", "\n"]) for _ in range(12)) for _ in range(500)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not re.search(r"<\||\[/?INST\]|</?s>", r.e)


# pipeline -----------------------------------------------------------------------------------------
def test_pipeline_stages(spark, sf_small):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    near = pipe.near_duplicate_stage(spark, docs.unionByName(docs.limit(3)), sf_small)
    assert near.columns == pipe.COLUMNS and near.count() == near.select("doc_id").distinct().count()
    text = {r.doc_id: r.text for r in pipe.suffix_stage(spark, near, sf_small).collect()}
    given = sorted((r.doc_id, r.text) for r in near.collect())
    for (i, t), mask in zip(given, covered([t for _, t in given], repeats.byte_symbols, pipe.REPEAT, False)):
        left = np.frombuffer(t.encode(), np.uint8)[~mask].tobytes().decode("utf-8", "replace")
        assert text.get(i, "") == left or (not mask.any() and text[i] == t)
    out = pipe.run(spark, sf_small)
    one = out.first()
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and hashlib.sha256(one.ids).hexdigest() == one.ids_sha256


CLASHING = ["_doc", "_h", "_h2", "_covered", "_ranges", "_text", "row", "id", "name", "ranges", "doc", "h", "c0", "covered", "p",
            "_s", "_n", "_k", "_b", "_key", "_full", "_rest", "_upto", "_order", "_room", "_whole", "tokens", "weight", "budget",
            "best", "token", "n", "pattern", "count"]


@pytest.mark.parametrize("op", ["substrings", "suffixes", "mixing", "urls"])
def test_extra_columns_with_helper_names_pass_through(spark, op):
    docs = documents(spark, ["x y " * 60, "x y " * 60, "one two", None])
    pages = spark.createDataFrame([(1, "http://b.com/de/1"), (2, "http://a.org/"), (3, None)], "page_id long, url string")
    apply, given = {
        "substrings": (substring_dedup.dedup_substrings, docs), "suffixes": (lambda d: suffix_dedup.dedup_suffixes(d, length=64), docs),
        "mixing": (mixing.mix, docs), "urls": (lambda d: url_filter.filter_urls(d, url_filter.rules_frame(spark)), pages)}[op]
    odd = given.selectExpr("*", *[f"'{c}' as `{c}`" for c in CLASHING])
    got, plain = apply(odd), apply(given)
    assert sorted(got.columns) == sorted([*plain.columns, *CLASHING])
    assert rows(got, *plain.columns) == rows(plain, *plain.columns) and got.count() > 0
    assert {tuple(r) for r in got.select(*CLASHING).distinct().collect()} == {tuple(CLASHING)}


def test_components_by_stars_equal_those_of_one_task(spark, monkeypatch):
    from feedlake.llm import components as cc
    edges = [(i, i + 1) for i in range(0, 40) if i % 13] + [(100, 7), (100, 100), (50, 60), (60, 50)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    settled = {tuple(r) for r in cc.components(df).collect()}
    root = cc.union_find(*zip(*[e for e in edges if e[0] != e[1]], strict=True))
    assert settled == {(x, r) for x, r in root.items() if x != r}
    monkeypatch.setattr(cc, "EDGES", 0)
    assert {tuple(r) for r in cc.components(df).collect()} == settled
    assert cc.components(df.limit(0)).count() == 0


def test_blocks_that_meet_many_are_dealt_to_several_tasks(spark, monkeypatch):
    import numpy as np

    from feedlake.llm import epsilon_grid as eg
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    x = np.concatenate([b + 0.02 * rng.normal(size=(30, 8)) for b in base])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = {tuple(r) for r in eg.near_duplicates(df).collect()}
    monkeypatch.setattr(eg, "BLOCK", 4)
    monkeypatch.setattr(eg, "PARTNERS", 2)
    assert {tuple(r) for r in eg.near_duplicates(df).collect()} == whole
    u = x / np.sqrt((x * x).sum(1))[:, None]
    n = ((u @ u.T) >= 0.95).sum(1) - 1
    assert {r[0]: r[1] for r in whole} == dict(enumerate(n.tolist()))


def test_a_common_passage_makes_no_pairs(spark, monkeypatch):
    """Pairs of sets that share a passage must not grow with the square of the corpus: their groups are left out."""
    pick, kept = random.Random(11), []
    passage = [f"p{i}" for i in range(60)]
    own = [[f"w{pick.randrange(10**9)}" for _ in range(pick.randint(120, 240))] for _ in range(150)]
    texts = [" ".join(passage + w) for w in own]
    for i in range(4):  # near copies, at the edge of the threshold and beyond it
        w = passage + own[i]
        n = len(w) * (i + 7) // 100
        texts.append(" ".join(w[n:] + [f"x{i}.{k}" for k in range(n)]))
    different = vertical_join._different_groups
    monkeypatch.setattr(vertical_join, "_different_groups", lambda g: kept.append(different(g)) or kept[-1])
    sets = [set(t.split()) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = union_find([e[0] for e in edges], [e[1] for e in edges])
    sizes = []
    write = vertical_join.materialize

    def written(df, name):
        out = write(df, name)
        if kept and df is kept[-1]:
            sizes.extend(r["count"] for r in out.groupBy("key").count().collect())
        return out

    monkeypatch.setattr(vertical_join, "materialize", written)
    got = vertical_join.jaccard_groups(documents(spark, texts), 80, 1).collect()
    assert edges and {(r.doc_id, r.component_id) for r in got} == {(i, root.get(i, i)) for i in range(len(texts))}
    assert sizes and sum(n * (n - 1) // 2 for n in sizes) < 1000


@pytest.mark.parametrize("threshold", [80, 90])
def test_linked_sets_share_a_needed_key(spark, threshold):
    """The keys that a set keeps hold one of each set that it links with, also where segments are empty."""
    pick, bands = random.Random(threshold), vertical_join.Bands(threshold)
    rng = np.random.default_rng(threshold)
    sets = []
    for n in [8, 9, 13, 18, 19, 20, 30, 31, 47, 70, 71, 100]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
            if pick.random() < 0.3:  # uneven names: many segments stay empty
                a = np.unique(a >> np.uint64(pick.randint(1, 3)))
            sets.append(a)
            for _ in range(5):  # one after the other away from it
                some = np.delete(a, pick.sample(range(len(a)), pick.randint(0, max(1, len(a) // 8))))
                sets.append(np.unique(np.concatenate([some, rng.integers(0, 1 << 63, pick.randint(0, max(1, len(a) // 12)), dtype=np.uint64)])))
    made = [bands.keys(a) for a in sets]
    keys = spark.createDataFrame([(int(k), i) for i, (own, _) in enumerate(made) for k in own.view(np.int64)], "key long, cls long").repartition(5)
    spare = spark.createDataFrame([(i, b, n) for i, (_, beyond) in enumerate(made) for b, n in beyond], "cls long, band int, spare int")
    kept = {}
    for r in vertical_join._needed_keys(vertical_join._shared_keys(keys).groupBy("key", "cls").count().drop("count"), spare).collect():
        kept.setdefault(r.cls, set()).add(r.key)
    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if both * 100 >= threshold * (len(a) + len(sets[j]) - both) and not np.array_equal(a, sets[j]):
                links += 1
                assert kept.get(i, set()) & kept.get(j, set())
    assert links > 300


def test_epsilon_grid_ships_blocks_in_tiles(spark, monkeypatch, tmp_path):
    """Where all blocks meet, a round ships few copies of the table, and nothing but the result stays."""
    monkeypatch.setattr(epsilon_grid, "BLOCK", 8)
    monkeypatch.setattr(epsilon_grid, "ROUND", 0)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(320, 16)).astype(np.float32)
    x[300:] = x[:20] + 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(2)
    sent, names, write, deal = [], [], epsilon_grid.materialize, epsilon_grid.tiles

    def written(frame, name):
        out = write(frame, name)
        names.append((name, out))
        return out

    def dealt(blocks, met):
        turns = deal(blocks, met)
        rows = [turn.collect() for turn in turns]
        sent.append((blocks.count(), [len(r) for r in rows]))
        pairs = [(a, r.block) for turn in rows for r in turn if r.side for a in r.partners]
        assert sorted(pairs) == sorted(map(tuple, met.select("a", "b").collect()))
        for turn in rows:  # a partner is in the tile of the block that it meets
            own = {(r.tile, r.block) for r in turn if not r.side}
            assert all((r.tile, a) in own for r in turn if r.side for a in r.partners)
        return turns

    monkeypatch.setattr(epsilon_grid, "tiles", dealt)
    monkeypatch.setattr(epsilon_grid, "materialize", written)
    got = {r.vec_id: r for r in epsilon_grid.near_duplicates(df, 0.95).collect()}
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert link.sum() >= 40 and {i: got[i].n_links for i in got} == dict(enumerate(link.sum(1).tolist()))
    blocks, rounds = sent[0]
    assert len(rounds) > 1 and all(n <= (epsilon_grid.SHIP + 4) * blocks for n in rounds)
    from feedlake.session import ensure_checkpoint_dir
    import os
    here = os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:"))
    for name, out in names:
        folders = {f.rsplit("/", 2)[1] for f in out.inputFiles()} if name == "near" else set()
        assert name != "near" or folders <= set(here)
    assert not [h for h in here if h.startswith("feedlake-grid-")]


def test_single_precision_loses_no_link():
    """Pairs at the very threshold are decided in double precision."""
    rng = np.random.default_rng(8)
    u = rng.normal(size=(300, 64))
    u /= np.sqrt((u * u).sum(1))[:, None]
    w = rng.normal(size=(300, 64))
    w -= (w * u).sum(1)[:, None] * u
    w /= np.sqrt((w * w).sum(1))[:, None]
    c = 0.95 + np.concatenate([np.linspace(-1e-7, 1e-7, 299), [1e-15]])
    v = c[:, None] * u + np.sqrt(1 - c * c)[:, None] * w
    v /= np.sqrt((v * v).sum(1))[:, None]
    got = epsilon_grid.join_blocks(u, v, u[:, :8], v[:, :8], 0.95, float(np.sqrt(0.1)), False)
    assert (got == ((u @ v.T) >= 0.95)).mean() > 0.9999 and 100 < np.diag(got).sum() < 200
    far = np.abs(c - 0.95) > 1e-12
    assert (np.diag(got)[far] == (c >= 0.95)[far]).all()
