"""Payload parsing: Atom, RSS, dispatch, rejects, arXiv, search pages."""

from conftest import payloads_df
from feedlake.operators import extract as ex

ATOM = '<feed xmlns="http://www.w3.org/2005/Atom">'


def _atom(entries, head=ATOM, tail="</feed>"):
    return head + "".join(entries) + tail


def _articles(spark, bodies):
    return [r.asDict() for r in ex.extract_articles(payloads_df(spark, bodies)).orderBy("payload_id", "pos").collect()]


def test_atom_entries_with_markup_and_attributes(spark):
    entries = ['<entry xml:lang="en"><id>tag:one</id><title type="html"><![CDATA[Tea & <b>kettles</b>]]></title>'
               '<link rel="alternate" type="text/html" href="https://brew.invalid/1?a=1&amp;b=2"/>'
               '<summary type="text">Boil &lt;twice&gt;.</summary><published>2025-11-03T23:59:59+02:00</published></entry>',
               '<entry><title>Second pot</title><link href="https://brew.invalid/2"/><content>Only content</content>'
               '<updated>2025-11-04T06:00:00Z</updated></entry>']
    one, two = _articles(spark, [_atom(entries)])
    assert one["title"] == "Tea & <b>kettles</b>" and one["link"] == "https://brew.invalid/1?a=1&b=2"
    assert (one["summary"], one["published"]) == ("Boil <twice>.", "2025-11-03")
    assert (two["title"], two["summary"], two["published"]) == ("Second pot", "Only content", "2025-11-04")


def test_titles_links_and_authors(spark):
    entries = [
        '<entry><link rel="self" href="http://self"/><link href="http://plain"/></entry>',
        '<entry><title></title><link rel="alternate" href="http://alt"/></entry>',
        '<entry><title>   </title><link rel="enclosure" href="http://e"/></entry>',
        '<entry><title>\nLead\nand embedded\n</title>'
        + "".join(f"<author><name>A{i}</name></author>" for i in range(5)) + '<author><name></name></author></entry>',
        '<entry><title>first</title><title>second</title><summary></summary><content> body </content>'
        '<updated>2026-4-2</updated></entry>',
    ]
    rows = _articles(spark, [_atom(entries)])
    assert [r["title"] for r in rows] == ["Untitled", "Untitled", "", "Lead and embedded", "first"]
    assert [r["link"] for r in rows] == ["http://plain", "http://alt", "", "", ""]
    assert rows[3]["authors"] == [f"A{i}" for i in range(5)]
    assert rows[4]["summary"] == "body" and rows[4]["published"] == "2026-04-02"


def test_rss_items_and_fallbacks(spark):
    rss = ('<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:media="http://m"><channel>'
           '<item><title>R1</title><media:title>decoy</media:title><link> http://l1 </link>'
           '<description> D </description><pubDate>Wed, 22 Apr 2026 23:30:00 -0700</pubDate></item>'
           '<item><link>http://l2</link><atom:updated>2026-04-20</atom:updated></item>'
           '</channel></rss>')
    rows = _articles(spark, [rss])
    assert [(r["title"], r["link"], r["summary"], r["published"]) for r in rows] == [
        ("R1", " http://l1 ", "D", "2026-04-22"), ("Untitled", "http://l2", "", "2026-04-20")]
    assert all(r["authors"] == [] for r in rows)


def test_root_dispatch_and_rejects(spark):
    bodies = [
        "<feed><entry><title>x</entry>",                                  # unclosed XML
        "HTTP 503 Service Unavailable",                                   # not XML
        "<Rss><channel><item><title>cap</title></item></channel></Rss>",  # root Rss
        "<items-root><item><title>bare</title></item></items-root>",      # unknown root, bare items
        _atom([]),                                                        # feed without entries
        "<feed><entry><title>no namespace</title></entry></feed>",        # Atom without namespace
        "\ufeff" + _atom(["<entry><title>bom</title></entry>"]),          # byte-order mark
        '<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:title>pref</a:title>'
        '<a:link href="http://p"/></a:entry></a:feed>',                   # prefixed Atom root
        '<rss xmlns:a10="http://www.w3.org/2005/Atom"><channel><item><title>rn</title>'
        '<a10:updated>2026-01-02T00:00:00Z</a10:updated></item></channel></rss>',
    ]
    df = payloads_df(spark, bodies)
    arts = {r.payload_id: (r.title, r.published) for r in ex.extract_articles(df).collect()}
    assert arts == {"p2": ("cap", ""), "p3": ("bare", ""), "p6": ("bom", ""), "p7": ("pref", ""),
                    "p8": ("rn", "2026-01-02")}
    assert sorted(r.payload_id for r in ex.rejects(df).collect()) == ["p0", "p1"]
    fmt = {r.payload_id: r.format for r in ex.feed_format(df).collect()}
    assert fmt["p0"] == "reject" and fmt["p2"] == "rss" and fmt["p4"] == "atom" and fmt["p3"] == "rss"


def test_arxiv_entries(spark):
    def entry(n, extra=""):
        return (f'<entry><id>http://arxiv.org/abs/1907.0{n}v{n}</id><title>On\n  lattices {n}</title><summary>  Rank {n}.  </summary>'
                f'<published>2019-07-0{n}T10:30:00Z</published><author><name>Noor {n}</name></author><author><name>Wen</name></author>'
                f'<category term="math.CO"/>{extra}</entry>')
    body = ('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'
            + entry(3, '<arxiv:primary_category term="math.CO"/><arxiv:comment>\n 12 figures </arxiv:comment>')
            + entry(4, '<category term="math.RT"/>') + "</feed>")
    first, second = ex.extract_papers(payloads_df(spark, [body], "arxiv")).orderBy("pos").collect()
    assert (first.arxiv_id, first.primary_category, first.comment) == ("1907.03v3", "math.CO", "12 figures")
    assert first.title == "On   lattices 3" and first.summary == "Rank 3." and first.published == "2019-07-03"
    assert second.authors == ["Noor 4", "Wen"] and second.categories == ["math.CO", "math.RT"]
    assert second.primary_category == "" and second.pdf_url.endswith("/1907.04v4.pdf")


def test_arxiv_prefix_rebinding(spark):
    body = ('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:ax="http://arxiv.org/schemas/atom">'
            '<entry><id>x/abs/1</id><ax:primary_category term="q"/></entry></feed>')
    (p,) = ex.extract_papers(payloads_df(spark, [body], "arxiv")).collect()
    assert p.primary_category == "q" and p.title == ""


def test_search_pages_without_hits(spark):
    rows = ex.extract_web_results(payloads_df(spark, ["", "<p>nothing here</p>", '<a class="other" href="u">t</a>'], "serp"), 3)
    assert rows.count() == 0


def test_search_page_blocks_and_limit(spark):
    block = ('<div><a rel="n" class="result__a" href="http://h{i}"><b>T{i}</b> &amp;</a> x '
             '<a class="result__snippet" href="#">S <i>{i}</i></a></div>')
    html = "".join(block.format(i=i) for i in range(7))
    rows = ex.extract_web_results(payloads_df(spark, [html], "serp"), 5).orderBy("pos").collect()
    assert [r.href for r in rows] == [f"http://h{i}" for i in range(5)]
    assert rows[0].title == "T0 &amp;" and rows[0].body == "S 0"


# ---- mixed content and DOCTYPE -------------------------------------------------------------------

ATOM_HEAD = '<feed xmlns="http://www.w3.org/2005/Atom">'


def _tree_text(xml, tag):
    """What the standard library's tree parser has as an element's text."""
    import xml.etree.ElementTree as ET
    return [(e.text or "") for e in ET.fromstring(xml).iter() if e.tag.split("}")[-1] == tag]


def test_leaves_stop_at_the_first_child(spark):
    leaves = ["a <b>x</b> c", "<div>hi <i>y</i></div>", "plain", "", " lead <br/> tail", "a &lt;b&gt;x&lt;/b&gt; c", "1 &lt; 2 &amp; 3",
              "<![CDATA[<title>a <b>x</b></title>]]>", "a<!-- c <b>d</b> -->b <i>e</i>f", "<![CDATA[x]]> y <![CDATA[<z>]]><q/>w",
              "x <a title='>' href=\"/title>\">l</a> y", "long " * 3000 + "<b>" + "in " * 3000 + "</b>"]
    atom = ATOM_HEAD + "".join(f'<entry><title type="xhtml">{t}</title><summary\n>{t}</summary ><link rel="self" href="u"/><link href="/v"/></entry>' for t in leaves) + "</feed>"
    rss = '<rss><channel>' + "".join(f"<item><title>{t}</title><description>{t}</description><link>u</link></item>" for t in leaves) + "</channel></rss>"
    df = payloads_df(spark, [atom, rss])
    for p, xml, body in (("p0", atom, "summary"), ("p1", rss, "description")):
        got = ex.extract_articles(df).where(f"payload_id = '{p}'").orderBy("pos").collect()
        assert [r.title for r in got] == [t.strip().replace("\n", " ") if t else "Untitled" for t in _tree_text(xml, "title")]
        assert [r.summary for r in got] == [t.strip() for t in _tree_text(xml, body)]
        assert {r.link for r in got} == {"/v" if p == "p0" else "u"}


def test_doctype_with_internal_subset(spark):
    items = "<channel><item><title>&e;x</title><description>&two;</description></item></channel>"
    subset = '<!-- > ] "odd --><!ENTITY e "E"><!ENTITY two "&e;&#33; &lt;b&gt; ]>"><!ELEMENT rss ANY>'
    bodies = [f"<!DOCTYPE rss [{subset}]><rss>{items}</rss>",
              f'﻿<?xml version="1.0"?>\n<!-- c --><!DOCTYPE rss SYSTEM "a>b.dtd" [{subset}] >\n<rss version="2.0">{items}</rss>',
              '<!DOCTYPE rss><rss><channel><item><title>plain</title></item></channel></rss>',
              '<!DOCTYPE rss PUBLIC "-//x//>" \'y\'><rss><channel><item><title>public</title></item></channel></rss>']
    got = {r.payload_id: (r.title, r.summary) for r in ex.extract_articles(payloads_df(spark, bodies)).collect()}
    assert got == {"p0": ("Ex", "E! <b> ]>"), "p1": ("Ex", "E! <b> ]>"), "p2": ("plain", ""), "p3": ("public", "")}
    atom = '<!DOCTYPE feed [<!ENTITY e "E">]>' + ATOM_HEAD + "<entry><title>&e;</title></entry></feed>"
    assert [r.title for r in ex.extract_articles(payloads_df(spark, [atom])).collect()] == ["E"]


def test_doctype_beyond_the_limit_is_a_reject(spark):
    many = "".join(f'<!ENTITY e{i} "x">' for i in range(17))
    bodies = [f"<!DOCTYPE rss [{many}]><rss><channel><item><title>a</title></item></channel></rss>",
              f'<!DOCTYPE rss [<!ENTITY e "{"x" * 1001}">]><rss><channel><item><title>a</title></item></channel></rss>',
              '<rss><channel><item><title>&unknown;</title></item></channel></rss>']
    df = payloads_df(spark, bodies)
    assert ex.extract_articles(df).count() == 0
    assert {r.payload_id for r in ex.rejects(df).collect()} == {"p0", "p1", "p2"}


def test_head_answers_as_the_whole_body(spark):
    from feedlake.functions import xml as X
    pad, ns = "x" * 3000, 'xmlns="http://www.w3.org/2005/Atom"'
    tag = f'<a:feed xmlns:a="http://www.w3.org/2005/Atom" q="a > b">'
    prologs = ["", "\n ", "<!-- a > b -->", f"<!-- {pad} <feed> > -->", f"<?xml {pad}?>", f'<!DOCTYPE feed [<!ENTITY e "{pad}">]>', " " * 5000, "HTTP 503 "]
    tags = [tag, f"<feed {ns}>", f'<feed p="{pad}>" {ns}>', f'<feed p="{pad}', "<feed", f"<rss p='>'", "<!-- open > ", f"<feed{' ' * 4000}{ns}>"]
    bodies = [p + t + "<entry/></a:feed>" for p in prologs for t in tags] + ["", None, "<", "plain > text"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string").withColumn("h", X.head("body"))
    for ask in (X.root_name, X.root_prefix, X.root_tag, X.has_default_namespace, lambda c: X.children_in(c, X.ATOM_NS)):
        assert df.where(~ask("body").eqNullSafe(ask("h"))).count() == 0
    long = spark.createDataFrame([(tag + pad * 5,)], "body string")
    assert long.select(X.head("body")).first()[0] == tag
