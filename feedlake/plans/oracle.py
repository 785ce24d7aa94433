"""DuckDB oracle SQL for the named queries.

The oracle does not parse payloads: it derives the expected item fields
directly from the driver tables, from the rules the fixtures were built with
and the semantics each operator must keep. Tables are the driver's views.
"""
from __future__ import annotations

from feedlake.functions.text import WHITESPACE
from feedlake.operators import quality as qa
from feedlake.operators import summarize as sm

WS = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
NL = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def one_line(x: str) -> str:
    return f"replace({strip(x)}, {NL}, ' ')"


def lit(s: str) -> str:
    """SQL string literal (newlines spelled with chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + f" || {NL} || ".join(quoted) + ")"


DOCS = """
docs AS (
  SELECT doc_id, text, lang, source, n_chars,
         doc_id // 100 AS chunk,
         (ascii(right(source, 1)) + doc_id // 100) % 4 AS fmt,
         (ascii(right(source, 1)) + doc_id // 100) % 5 AS r,
         CAST(DATE '2024-01-01' + CAST(doc_id // 100 AS INTEGER) AS DATE) AS fetch_day,
         CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS pub_day,
         split_part(text, '.', 1) AS title_src,
         doc_id % 6 AS n_auth,
         'Feed ' || upper(source) AS feed_name,
         'feed-' || source || '-' || CAST(doc_id // 100 AS VARCHAR) AS payload_id,
         row_number() OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id) - 1 AS pos
  FROM documents)"""

REGISTRY = """
registry AS (
  SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS BIGINT) AS registry_pos
  FROM (SELECT DISTINCT source FROM documents))"""


def _names(n: str, doc_id: str = "doc_id") -> str:
    return f"[('Author ' || CAST({doc_id} AS VARCHAR) || '.' || CAST(i AS VARCHAR)) FOR i IN range(1, {n} + 1)]"


ARTICLES = DOCS + "," + f"""
articles AS (
  SELECT doc_id, source, chunk, fmt, payload_id, pos, feed_name, fetch_day, text,
         CASE WHEN fmt IN (0, 1) THEN {one_line('title_src')}
              WHEN title_src = '' THEN 'Untitled' ELSE {one_line('title_src')} END AS title,
         'http://feeds.test/' || source || '/' || CAST(doc_id AS VARCHAR) AS link,
         {strip('text')} AS summary,
         CASE WHEN doc_id % 7 = 6 THEN 'not a date' ELSE strftime(pub_day, '%Y-%m-%d') END AS published,
         CASE WHEN fmt IN (0, 1) THEN {_names('least(n_auth, 4)')} ELSE []::VARCHAR[] END AS authors
  FROM docs)"""

PAPERS = DOCS + "," + f"""
papers0 AS (
  SELECT *, CASE lang WHEN 'en' THEN 'cs.CL' WHEN 'fr' THEN 'cs.AI' WHEN 'de' THEN 'cs.LG' ELSE 'cs.IR' END AS prim,
         '2401.' || printf('%05d', doc_id) || 'v' || CAST(doc_id % 3 + 1 AS VARCHAR) AS aid
  FROM docs),
papers AS (
  SELECT doc_id, 'arxiv-' || prim || '-' || CAST(chunk AS VARCHAR) AS payload_id,
         row_number() OVER (PARTITION BY prim, chunk ORDER BY doc_id) - 1 AS pos,
         aid AS arxiv_id, {one_line('title_src')} AS title, {strip('text')} AS summary,
         {_names('n_auth')} AS authors, strftime(pub_day, '%Y-%m-%d') AS published,
         prim AS primary_category,
         CASE WHEN doc_id % 3 = 0 THEN [prim, 'stat.ML'] ELSE [prim] END AS categories,
         'https://arxiv.org/pdf/' || aid || '.pdf' AS pdf_url,
         CASE WHEN doc_id % 4 = 1 THEN CAST(n_chars AS VARCHAR) || ' characters, ' || lang ELSE '' END AS comment,
         fetch_day
  FROM papers0)"""

SERP_PATTERN = (r'(?s)<a[^>]+class="result__a"[^>]+href="([^"]+)"[^>]*>(.*?)</a>'
                r'.*?<a[^>]+class="result__snippet"[^>]*>(.*?)</a>')
_NAV = r'<li><a href="([^"]*)">([^<]*)</a></li>'
_BLOCK = ('<li><a rel="nofollow" class="result__a" href="\\1">\\2</a> <span class="sep"></span>'
          '<a class="result__snippet" href="\\1">Snippet for <b>\\2</b> ...</a></li>')


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WEB = f"""
serp AS (
  SELECT page_id, 'serp-' || CAST(page_id AS VARCHAR) AS payload_id,
         CAST(DATE '2024-01-01' + CAST(page_id // 25 AS INTEGER) AS DATE) AS fetch_day,
         regexp_extract_all(regexp_replace(html, {_q(_NAV)}, {_q(_BLOCK)}, 'g'), {_q(SERP_PATTERN)}, 0) AS ms
  FROM pages),
hits0 AS (
  SELECT payload_id, fetch_day, unnest(ms[1:5]) AS m, generate_subscripts(ms[1:5], 1) - 1 AS pos FROM serp),
web AS (
  SELECT payload_id, fetch_day, pos,
         {strip(f"regexp_replace(regexp_extract(m, {_q(SERP_PATTERN)}, 2), '<[^>]+>', '', 'g')")} AS title,
         {strip(f"regexp_extract(m, {_q(SERP_PATTERN)}, 1)")} AS href,
         {strip(f"regexp_replace(regexp_extract(m, {_q(SERP_PATTERN)}, 3), '<[^>]+>', '', 'g')")} AS body,
         'web' AS source
  FROM hits0)"""

# ---- completions and the EXT-7 parse (window formulation) --------------------

def _bullets(mark: str, what: str) -> str:
    return f"coalesce(array_to_string(list_transform({what}, lambda x: {_q(mark)} || x), {NL}), '')"


# every line of the text is in the response: first, further lines as points, last
_SHAPES = f"""CASE doc_id % 4
      WHEN 0 THEN text
      WHEN 1 THEN 'HEADLINE: ' || ls[1] || {NL} || 'KEY POINTS:' || {NL} || {_bullets('- ', 'ls[2:]')}
                  || {NL} || 'RELEVANCE: ' || ls[len(ls)]
      WHEN 2 THEN 'Intro ' || ls[1] || {NL} || '- stray' || {NL} || 'headline: first' || {NL} || 'Key Points:'
                  || {NL} || {_bullets('-- ', 'ls[2:]')} || {NL} || '-' || {NL} || 'RELEVANCE:' || {NL} || ls[len(ls)]
                  || {NL} || 'HEADLINE: ' || ls[1]
      ELSE 'key points:' || {NL} || {_bullets('  - ', 'ls')} END"""

COMPLETIONS = f"""
comp0 AS (
  SELECT d.doc_id, d.payload_id || '#' || CAST(d.pos AS VARCHAR) AS item_id, d.text, string_split(d.text, {NL}) AS ls
  FROM docs d WHERE d.doc_id % 5 <> 3),
completions AS (SELECT 'article' AS item_kind, item_id, {_SHAPES} AS response FROM comp0)"""

_BREAKS = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

PARSED = f"""
c_lines AS (
  SELECT item_kind, item_id, response, unnest(string_split_regex(response, {_q(_BREAKS)})) AS raw,
         generate_subscripts(string_split_regex(response, {_q(_BREAKS)}), 1) AS i
  FROM completions),
c_tag AS (
  SELECT *, {strip('raw')} AS l,
         CASE WHEN starts_with(upper({strip('raw')}), 'HEADLINE:') THEN 'H'
              WHEN starts_with(upper({strip('raw')}), 'KEY POINTS:') THEN 'P'
              WHEN starts_with(upper({strip('raw')}), 'RELEVANCE:') THEN 'R' END AS tag
  FROM c_lines),
c_sec AS (
  SELECT *, last_value(tag IGNORE NULLS) OVER (PARTITION BY item_kind, item_id ORDER BY i
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec,
         {strip("substr(l, strpos(l, ':') + 1)")} AS val
  FROM c_tag),
c_lastr AS (
  SELECT item_kind, item_id, max(i) FILTER (WHERE tag = 'R') AS ri, max(i) FILTER (WHERE tag = 'H') AS hi
  FROM c_sec GROUP BY ALL),
c_parts AS (
  SELECT s.item_kind, s.item_id, any_value(s.response) AS response,
         max(s.val) FILTER (WHERE s.i = r.hi) AS head,
         max(s.val) FILTER (WHERE s.i = r.ri) AS relv,
         arg_min(s.l, s.i) FILTER (WHERE s.i > r.ri AND s.tag IS NULL AND s.sec = 'R' AND s.l <> '') AS relnext,
         count(*) FILTER (WHERE s.tag IS NULL AND s.sec = 'P' AND starts_with(s.l, '-')) AS npts,
         string_agg({strip("ltrim(s.l, '- ')")}, {NL} ORDER BY s.i)
           FILTER (WHERE s.tag IS NULL AND s.sec = 'P' AND starts_with(s.l, '-')) AS pts,
         string_agg('- ' || {strip("ltrim(s.l, '- ')")}, {NL} ORDER BY s.i)
           FILTER (WHERE s.tag IS NULL AND s.sec = 'P' AND starts_with(s.l, '-')) AS bullets
  FROM c_sec s JOIN c_lastr r USING (item_kind, item_id) GROUP BY ALL),
parsed AS (
  SELECT item_kind, item_id,
         CASE WHEN coalesce(head, '') <> '' THEN head ELSE left(split_part(response, {NL}, 1), 120) END AS headline,
         CASE WHEN npts > 0 THEN npts ELSE 1 END AS n_points,
         CASE WHEN npts > 0 THEN pts ELSE left(response, 200) END AS points,
         CASE WHEN npts > 0 THEN bullets ELSE '- ' || left(response, 200) END AS bullets,
         CASE WHEN coalesce(relv, '') <> '' THEN relv WHEN coalesce(relnext, '') <> '' THEN relnext
              ELSE {lit(sm.PARSED_DEFAULT_RELEVANCE)} END AS relevance
  FROM c_parts)"""

# ---- digests -------------------------------------------------------------------


def _body(headline: str, points: str, relevance: str) -> str:
    """Lines after the metadata: '', **headline**, '', bullets, '', relevance, '', ---, ''."""
    return (f"'' || {NL} || '**' || {headline} || '**' || {NL} || '' || {NL} || {points} || {NL} || '' || {NL}"
            f" || '_Relevance:_ ' || {relevance} || {NL} || '' || {NL} || '---' || {NL} || ''")


def digest_items_sql(summarize: bool = True, papers: bool = True, web: bool = True, capped: bool = True) -> str:
    """CTE chain ending in ``items(digest_key, section, rn, title, block)``."""
    ctes = [ARTICLES.strip(), REGISTRY.strip()]
    if summarize:
        ctes += [COMPLETIONS.strip(), PARSED.strip()]
    else:
        ctes.append("parsed AS (SELECT NULL::VARCHAR AS item_id, NULL::VARCHAR AS headline, NULL::BIGINT AS n_points,"
                    " NULL::VARCHAR AS points, NULL::VARCHAR AS bullets, NULL::VARCHAR AS relevance WHERE false)")
    # Articles: cap 15 per (day, feed) in feed order, numbered in registry order.
    ctes.append(f"""a_items AS (
  SELECT strftime(a.fetch_day, '%Y-%m-%d') AS digest_key, 2 AS section,
         row_number() OVER (PARTITION BY a.fetch_day ORDER BY g.registry_pos, a.payload_id, a.pos) AS rn,
         a.title,
         '- **Source:** ' || a.feed_name || {NL} || '- **Published:** ' || a.published || {NL}
           || '- **Link:** [' || a.link || '](' || a.link || ')' || {NL}
           || CASE WHEN len(a.authors) > 0 THEN '- **Authors:** ' || array_to_string(a.authors, ', ') || {NL} ELSE '' END
           || {_body('coalesce(p.headline, a.title)',
                     "CASE WHEN p.item_id IS NULL THEN '- ' || left(a.summary, 200) ELSE p.bullets END",
                     "coalesce(p.relevance, 'See article.')")} AS rest
  FROM articles a JOIN registry g USING (source)
  LEFT JOIN parsed p ON p.item_id = a.payload_id || '#' || CAST(a.pos AS VARCHAR)
  {'QUALIFY row_number() OVER (PARTITION BY a.fetch_day, a.payload_id ORDER BY a.pos) <= 15' if capped else ''})""")
    parts = ["SELECT digest_key, section, rn, title, rest FROM a_items"]
    if papers:
        ctes += [s.strip() for s in PAPERS.replace(DOCS + ",", "").split("\n,\n")]
        ctes.append(f"""p_items AS (
  SELECT strftime(fetch_day, '%Y-%m-%d') AS digest_key, 1 AS section,
         row_number() OVER (PARTITION BY fetch_day ORDER BY published DESC, arxiv_id DESC) AS rn, title,
         '- **Authors:** ' || array_to_string(authors[1:4], ', ') || CASE WHEN len(authors) > 4 THEN ' et al.' ELSE '' END
           || {NL} || '- **Published:** ' || published || ' | **Category:** ' || primary_category || {NL}
           || '- **PDF:** [' || pdf_url || '](' || pdf_url || ')' || {NL}
           || '- **arXiv ID:** [' || arxiv_id || '](https://arxiv.org/abs/' || arxiv_id || ')' || {NL}
           || CASE WHEN comment <> '' THEN '- **Comment:** ' || comment || {NL} ELSE '' END
           || {_body('title', "'- ' || left(summary, 200)", "'See abstract.'")} AS rest
  FROM papers {'QUALIFY rn <= 5' if capped else ''})""")
        parts.append("SELECT digest_key, section, rn, title, rest FROM p_items")
    if web:
        ctes += [s.strip() for s in WEB.strip().split("\n),\n")]
        ctes.append(f"""w_items AS (
  SELECT strftime(fetch_day, '%Y-%m-%d') AS digest_key, 3 AS section,
         row_number() OVER (PARTITION BY fetch_day ORDER BY payload_id, pos) AS rn, title,
         '- **Link:** [' || href || '](' || href || ')' || {NL} || '- **Source:** ' || source || {NL}
           || {_body('title', "'- ' || left(body, 200)", "'See source.'")} AS rest
  FROM web {'QUALIFY rn <= 5' if capped else ''})""")
        parts.append("SELECT digest_key, section, rn, title, rest FROM w_items")
    ctes.append("items AS (SELECT *, '### ' || CAST(rn AS VARCHAR) || '. ' || title || " + NL +
                " || rest AS block FROM (" + " UNION ALL ".join(parts) + "))")
    fixed = []
    for c in ctes:
        c = c.strip().rstrip(",")
        if not c.endswith(")"):
            c += ")"
        fixed.append(c)
    return "WITH " + ",\n".join(fixed)


def _section(n: int, header: str, empty: str) -> str:
    return (f"{lit(header)} || {NL} || '' || {NL} || coalesce(string_agg(block, {NL} ORDER BY rn) "
            f"FILTER (WHERE section = {n}), {lit(empty)} || {NL} || '')")


def render_sql(keys_sql: str | None = None, **kw) -> str:
    from feedlake.operators.digest import DEFAULT_FOOTER, DEFAULT_TITLE, SECTIONS
    body = digest_items_sql(**kw)
    src = "items"
    if keys_sql:
        body += (f",\nall_items AS (SELECT digest_key, section, rn, block FROM items UNION ALL "
                 f"SELECT DISTINCT digest_key, 0, 0, NULL FROM ({keys_sql}))")
        src = "all_items"
    md = (f"{lit('# ' + DEFAULT_TITLE)} || {NL} || '' || {NL} || '**Date:** ' || digest_key || {NL} || '' || {NL} || "
          + f" || {NL} || ".join(_section(n, *SECTIONS[n]) for n in (1, 2, 3))
          + f" || {NL} || {lit(DEFAULT_FOOTER)}")
    return body + f"""
SELECT digest_key, md5(md) AS md_md5, CAST(length(md) AS BIGINT) AS md_chars,
       CAST(len(string_split(md, {NL})) AS BIGINT) AS md_lines
FROM (SELECT digest_key, {md} AS md FROM {src} GROUP BY digest_key)"""


ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["q_digest_render"] = render_sql()

ORACLE_SQL["q_digest_files"] = render_sql(capped=False)

ORACLE_SQL["q_digest_items"] = digest_items_sql() + """
SELECT digest_key, CAST(section AS BIGINT) AS section, CAST(rn AS BIGINT) AS rn, title, md5(block) AS block_md5
FROM items"""

ORACLE_SQL["q_digest_empty_sections"] = render_sql(
    keys_sql="SELECT strftime(ts, '%Y-%m-%d') AS digest_key FROM events", summarize=False, papers=False, web=False)

_ART_OUT = """SELECT payload_id, CAST(pos AS BIGINT) AS pos, title, link, md5(summary) AS summary_md5,
       CAST(length(summary) AS BIGINT) AS summary_chars, published, array_to_string(authors, '|') AS authors
FROM articles"""

ORACLE_SQL["q_atom_articles"] = "WITH " + ARTICLES.strip() + "\n" + _ART_OUT + " WHERE fmt IN (0, 1)"
ORACLE_SQL["q_rss_articles"] = "WITH " + ARTICLES.strip() + "\n" + _ART_OUT + " WHERE fmt IN (2, 3)"

ORACLE_SQL["q_feed_dispatch"] = "WITH " + DOCS.strip() + """,
p AS (SELECT source, chunk, any_value(fmt) AS fmt, any_value(r) AS r, count(*) AS n FROM docs GROUP BY source, chunk)
SELECT format, CAST(count(*) AS BIGINT) AS n_payloads, CAST(sum(n) AS BIGINT) AS n_items FROM (
  SELECT CASE WHEN fmt IN (0, 1) THEN 'atom' ELSE 'rss' END AS format, n FROM p
  UNION ALL SELECT 'reject', 0 FROM p WHERE r IN (0, 1))
GROUP BY format"""

ORACLE_SQL["q_arxiv_papers"] = "WITH " + PAPERS.strip() + """
SELECT payload_id, CAST(pos AS BIGINT) AS pos, arxiv_id, title, md5(summary) AS summary_md5,
       array_to_string(authors, '|') AS authors, published, primary_category,
       array_to_string(categories, '|') AS categories, pdf_url, comment
FROM papers"""

ORACLE_SQL["q_paper_listing"] = "WITH " + PAPERS.strip() + """
SELECT arxiv_id AS id, title, published, array_to_string(authors, ', ') AS authors_text,
       array_to_string(categories, ', ') AS categories_text,
       md5(left(summary, 200) || '...') AS abstract_md5, CAST(length(left(summary, 200) || '...') AS BIGINT) AS abstract_chars,
       'https://arxiv.org/pdf/' || arxiv_id AS pdf
FROM papers"""

ORACLE_SQL["q_date_normalize"] = """
WITH d AS (SELECT doc_id, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS day FROM documents)
SELECT doc_id,
       CASE doc_id % 7
         WHEN 0 THEN strftime(day, '%Y-%m-%d') || 'T08:15:00Z'
         WHEN 1 THEN strftime(day, '%Y-%m-%d') || 'T23:30:00-07:00'
         WHEN 2 THEN strftime(day, '%Y-%m-%d')
         WHEN 3 THEN strftime(day, '%a, %d %b %Y') || ' 23:30:00 -0700'
         WHEN 4 THEN strftime(day, '%-d %b %Y') || ' 06:00:00 +0000'
         WHEN 5 THEN strftime(day, '%Y-%-m-%-d')
         ELSE 'not a date' END AS raw,
       CASE WHEN doc_id % 7 = 6 THEN 'not a date' ELSE strftime(day, '%Y-%m-%d') END AS published,
       CASE doc_id % 5 WHEN 0 THEN strftime(day, '%a, %d %b %Y 10.30.00 GMT') WHEN 1 THEN strftime(day, '%a %b %d 10:00:00 %Y')
         WHEN 2 THEN strftime(day, '%d %b') || ' 126 10:00:00 GMT' WHEN 3 THEN strftime(day, '%d %b %Y 10:00:00 +9999')
         ELSE strftime(day, '%A, %d-%b-%y 10:00:00 GMT') END AS raw_mail,
       CASE doc_id % 5 WHEN 2 THEN '0126-' || strftime(day, '%m-%d') WHEN 3 THEN left(strftime(day, '%d %b %Y'), 10)
         ELSE strftime(day, '%Y-%m-%d') END AS mail_day
FROM d"""

ORACLE_SQL["q_web_results"] = "WITH " + WEB.strip() + """
SELECT payload_id, CAST(pos AS BIGINT) AS pos, title, href, body, source FROM web"""

ORACLE_SQL["q_feed_registry_join"] = "WITH " + DOCS.strip() + "," + REGISTRY + """,
p AS (SELECT DISTINCT source, payload_id, r FROM docs)
SELECT p.payload_id || s.sfx AS payload_id, 'Feed ' || upper(p.source) AS feed_name, g.registry_pos
FROM p JOIN registry g USING (source)
JOIN (VALUES ('', -1), ('-bad', 0), ('-txt', 1)) AS s(sfx, rv) ON s.rv = -1 OR s.rv = p.r"""

ORACLE_SQL["q_source_selection"] = """
SELECT 'feed' AS kind, 'Feed ' || upper(source) AS feed_name, CAST(count(*) AS BIGINT) AS n_items
FROM documents GROUP BY source
UNION ALL SELECT 'arxiv', 'arXiv', CAST(count(*) AS BIGINT) FROM documents"""

ORACLE_SQL["q_feed_cap"] = "WITH " + ARTICLES.strip() + """
SELECT feed_name, payload_id, CAST(pos AS BIGINT) AS pos, title FROM articles
QUALIFY row_number() OVER (PARTITION BY payload_id ORDER BY pos) <= 15"""

ORACLE_SQL["q_search_papers"] = "WITH " + PAPERS.strip() + """
SELECT arxiv_id, published, title FROM papers WHERE list_contains(categories, 'cs.CL')
ORDER BY published DESC, arxiv_id DESC LIMIT 10"""

ORACLE_SQL["q_search_keyword"] = "WITH " + PAPERS.strip() + """
SELECT primary_category, CAST(rank AS BIGINT) AS rank, arxiv_id, published FROM (
  SELECT *, row_number() OVER (PARTITION BY primary_category ORDER BY published, arxiv_id) AS rank
  FROM papers
  WHERE list_contains(regexp_split_to_array(lower(title || ' ' || summary || ' ' || array_to_string(authors, ' ')),
                                            '[^\\p{L}\\p{N}_]+'), 'the'))
WHERE rank <= 5"""

ORACLE_SQL["q_listing_text"] = "WITH " + PAPERS.strip() + f""",
top AS (SELECT *, row_number() OVER (PARTITION BY primary_category ORDER BY published DESC, arxiv_id DESC) AS n
        FROM papers QUALIFY n <= 5),
ent AS (SELECT primary_category, n,
               CAST(n AS VARCHAR) || '. [' || arxiv_id || '] ' || title || {NL} || '   Authors: '
               || array_to_string(authors, ', ') || {NL} || '   Published: ' || published || ' | Categories: '
               || array_to_string(categories, ', ') || {NL} || '   Abstract: ' || left(summary, 200) || '...'
               || {NL} || '   PDF: https://arxiv.org/pdf/' || arxiv_id || {NL} || {NL} AS e FROM top)
SELECT primary_category, CAST(count(*) AS BIGINT) AS n_papers, md5(string_agg(e, '' ORDER BY n)) AS text_md5,
       CAST(length(string_agg(e, '' ORDER BY n)) AS BIGINT) AS text_chars
FROM ent GROUP BY primary_category"""


def _prompt(kind: str, title: str, text: str) -> str:
    tpl = sm.PROMPT_TEMPLATES[kind]
    a, b, c = tpl.split("%s")
    return f"{lit(a)} || {title} || {lit(b)} || {text} || {lit(c)}"


ORACLE_SQL["q_prompts"] = "WITH " + ARTICLES.strip() + ",\n" + ",\n".join(
    s.strip() for s in PAPERS.replace(DOCS + ",", "").split("\n,\n")) + ",\n" + WEB.strip() + f"""
SELECT item_kind, item_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_chars FROM (
  SELECT 'paper' AS item_kind, payload_id || '#' || CAST(pos AS VARCHAR) AS item_id,
         {_prompt('paper', 'title', 'summary')} AS prompt FROM papers
  UNION ALL
  SELECT 'article', payload_id || '#' || CAST(pos AS VARCHAR), {_prompt('article', 'title', 'left(summary, 4000)')}
  FROM articles
  UNION ALL
  SELECT 'web', payload_id || '#' || CAST(pos AS VARCHAR), {_prompt('web', 'title', 'left(body, 4000)')} FROM web)"""

_SUM_OUT = """SELECT item_kind, item_id, headline, CAST(n_points AS BIGINT) AS n_points, md5(points) AS points_md5, relevance"""

ORACLE_SQL["q_structured_summaries"] = "WITH " + DOCS.strip() + "," + COMPLETIONS + "," + PARSED + "\n" + \
    _SUM_OUT + " FROM parsed"

ORACLE_SQL["q_summary_fallback"] = "WITH " + ARTICLES.strip() + "," + COMPLETIONS + "," + PARSED + f"""
SELECT 'article' AS item_kind, a.payload_id || '#' || CAST(a.pos AS VARCHAR) AS item_id,
       coalesce(p.headline, a.title) AS headline, CAST(coalesce(p.n_points, 1) AS BIGINT) AS n_points,
       md5(coalesce(p.points, left(a.summary, 200))) AS points_md5,
       coalesce(p.relevance, 'See article.') AS relevance
FROM articles a LEFT JOIN parsed p ON p.item_id = a.payload_id || '#' || CAST(a.pos AS VARCHAR)"""

# ---- retention ------------------------------------------------------------------

INVENTORY = """
inv0 AS (
  SELECT doc_id, source, n_chars, doc_id % 10 AS v,
         CAST(DATE '2024-01-01' + CAST(doc_id // 20 AS INTEGER) AS DATE) AS day
  FROM documents),
inventory AS (
  SELECT '/digests/' || source || '/' || CAST(doc_id AS VARCHAR) || '/' ||
         CASE v WHEN 5 THEN 'digest_' || strftime(day, '%Y-%-m-%-d') || '.md'
                WHEN 7 THEN 'digest_' || strftime(day, '%Y-%m-%d') || '_x.md'
                WHEN 8 THEN 'digest_.md'
                WHEN 9 THEN 'other_' || strftime(day, '%Y-%m-%d') || '.md'
                ELSE 'digest_' || strftime(day, '%Y-%m-%d') || '.md' END AS path,
         CAST(day AS TIMESTAMP) + to_hours(CAST(doc_id % 24 AS INTEGER)) AS mtime,
         CAST(n_chars AS BIGINT) AS length, source AS folder,
         CASE WHEN v IN (7, 8, 9) THEN NULL ELSE day END AS file_date
  FROM inv0),
marked AS (
  SELECT *, CASE WHEN file_date IS NULL THEN 'skipped'
                 WHEN CAST(file_date AS TIMESTAMP) < TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY THEN 'expired'
                 ELSE 'kept' END AS status
  FROM inventory)"""

ORACLE_SQL["q_retention_plan"] = "WITH " + INVENTORY.strip() + """
SELECT folder, CAST(count(*) FILTER (WHERE status = 'expired') AS BIGINT) AS archived, CAST(0 AS BIGINT) AS deleted,
       CAST(coalesce(sum(length) FILTER (WHERE status = 'expired'), 0) AS BIGINT) AS bytes_freed
FROM marked GROUP BY folder"""

ORACLE_SQL["q_retention_kept"] = "WITH " + INVENTORY.strip() + """
SELECT path, strftime(file_date, '%Y-%m-%d') AS file_date, status FROM marked WHERE status <> 'expired'"""

ORACLE_SQL["q_retention_apply"] = """
WITH f AS (SELECT CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS DATE) AS day, sum(strlen(text) + 1) AS length
           FROM documents GROUP BY 1),
m AS (SELECT *, CAST(day AS TIMESTAMP) < TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY AS gone FROM f)
SELECT count(*) FILTER (WHERE gone) AS archived, CAST(0 AS BIGINT) AS deleted,
       CAST(coalesce(sum(length) FILTER (WHERE gone), 0) AS BIGINT) AS bytes_freed,
       count(*) FILTER (WHERE gone) AS partitions_removed,
       CAST(coalesce(sum(length) FILTER (WHERE gone), 0) AS BIGINT) AS bytes_archived,
       count(*) FILTER (WHERE NOT gone) AS files_left,
       CAST(coalesce(sum(length) FILTER (WHERE NOT gone), 0) AS BIGINT) AS bytes_left
FROM m"""

_LINE = """'step ' || CAST(event_id AS VARCHAR) || ': ' ||
    CASE WHEN event_type = 'error' AND value < 10 THEN 'retry done, no error left ' || props
         WHEN event_type = 'error' AND value < 20 THEN 'terror alert ' || props
         WHEN event_type = 'error' THEN 'ERROR failed to fetch ' || props
         WHEN event_type = 'signup' AND value < 5 THEN 'Phase 2 exception handler ready ' || props
         WHEN event_type = 'signup' THEN 'Traceback (most recent call last) ' || props
         ELSE event_type || ' ok ' || props END"""

_BENIGN = " OR ".join(f"contains(lower(line), {_q(p)})" for p in qa.BENIGN_PHRASES)
IS_ERROR = (f"(regexp_matches(line, {_q('(?i)\\b(' + '|'.join(qa.ERROR_WORDS) + ')\\b')}) "
            f"AND NOT ({_BENIGN}))")

REPORTS = f"""
lines AS (
  SELECT '/reports/cycle_report_' || strftime(ts, '%Y-%m-%d') || '.txt' AS path, strftime(ts, '%Y-%m-%d') AS cycle,
         CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 23 HOUR + INTERVAL 59 MINUTE AS mtime, {_LINE} AS line
  FROM events),
files AS (SELECT path, max(mtime) AS mtime, CAST(sum(strlen(line) + 1) AS BIGINT) AS length FROM lines GROUP BY path)"""

ORACLE_SQL["q_retention_by_mtime"] = "WITH " + REPORTS.strip() + """
SELECT CAST(0 AS BIGINT) AS archived,
       CAST(count(*) FILTER (WHERE mtime < TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAY) AS BIGINT) AS deleted,
       CAST(coalesce(sum(length) FILTER (WHERE mtime < TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAY), 0) AS BIGINT)
         AS bytes_freed
FROM files"""

ORACLE_SQL["q_error_scan"] = "WITH " + REPORTS.strip() + f""",
newest AS (SELECT path FROM files ORDER BY mtime DESC, path LIMIT 10)
SELECT path, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE {IS_ERROR}) AS BIGINT) AS n_errors
FROM lines SEMI JOIN newest USING (path) GROUP BY path"""

_DIGEST_FILE = "starts_with(split_part(path, '/', -1), 'digest_') AND ends_with(path, '.md')"

ORACLE_SQL["q_latest_artifact"] = "WITH " + INVENTORY.strip() + f"""
SELECT folder, path, length, length >= 1000 AS ok FROM inventory WHERE {_DIGEST_FILE}
QUALIFY row_number() OVER (PARTITION BY folder ORDER BY mtime DESC, path DESC) = 1"""

CHECKS = """
checks AS (
  SELECT strftime(ts, '%Y-%m-%d') AS cycle,
         CASE WHEN user_id % 5 = 0 THEN 'arxiv' ELSE 'feed' END AS kind,
         CASE WHEN user_id % 5 = 0 THEN 'arxiv' ELSE 'feed' END || ':' || CAST(user_id AS VARCHAR) AS target,
         CASE WHEN event_type = 'click' THEN 'HEAD' ELSE 'GET' END AS method,
         CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'purchase' THEN 429
              WHEN event_type = 'click' AND value < 20 THEN 405 ELSE 200 END AS status,
         event_id AS attempt
  FROM events),
rows AS (
  SELECT *, CASE WHEN kind = 'arxiv' THEN status IN (200, 429) WHEN status = 200 THEN true
                 WHEN method = 'HEAD' AND status = 405 THEN NULL ELSE false END AS rok
  FROM checks),
outcomes AS (
  SELECT cycle, kind, target,
         coalesce(arg_max(rok, attempt) FILTER (WHERE rok IS NOT NULL), false) AS ok,
         coalesce(arg_max(status, attempt) FILTER (WHERE rok IS NOT NULL), arg_max(status, attempt)) AS status
  FROM rows GROUP BY cycle, kind, target)"""

ORACLE_SQL["q_check_status"] = "WITH " + CHECKS.strip() + """
SELECT cycle, kind, target, ok, CAST(status AS BIGINT) AS status FROM outcomes"""

ORACLE_SQL["q_feed_details"] = "WITH " + CHECKS.strip() + """
SELECT cycle, bool_and(ok) AS all_ok, CAST(count(*) AS BIGINT) AS n_feeds,
       md5(string_agg(target || '=' || CAST(ok AS VARCHAR) || '/' || CAST(status AS VARCHAR), ';' ORDER BY target))
         AS details_md5
FROM outcomes WHERE kind = 'feed' GROUP BY cycle"""

SCORES = """
scores AS (
  SELECT cycle, count(*) AS n_checks, count(*) FILTER (WHERE ok) AS n_passed,
         (count(*) FILTER (WHERE ok)) / count(*) AS score
  FROM outcomes GROUP BY cycle)"""

ORACLE_SQL["q_scorecard"] = "WITH " + CHECKS.strip() + "," + SCORES + """
SELECT cycle, CAST(n_checks AS BIGINT) AS n_checks, CAST(n_passed AS BIGINT) AS n_passed,
       CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.7 THEN 'C' ELSE 'D' END AS grade,
       score >= 0.8 AS passed
FROM scores"""

ORACLE_SQL["q_release_gate"] = "WITH " + CHECKS.strip() + "," + SCORES + "," + REPORTS + "," + INVENTORY + f""",
runs AS (
  SELECT strftime(ts, '%Y-%m-%d') AS cycle, arg_max({{'ok': value >= 2, 'sec': CASE WHEN user_id % 11 <> 0 THEN value / 8 END}}, event_id) AS run
  FROM events WHERE event_type = 'signup' GROUP BY 1),
gates AS (
  SELECT 'health' AS gate, cycle, score >= 0.8 AS ok FROM scores
  UNION ALL SELECT 'errors', cycle, count(*) FILTER (WHERE {IS_ERROR}) = 0 FROM lines GROUP BY cycle
  UNION ALL SELECT 'size', strftime(mtime, '%Y-%m-%d'), length >= 1000 FROM inventory WHERE {_DIGEST_FILE}
    QUALIFY row_number() OVER (PARTITION BY strftime(mtime, '%Y-%m-%d') ORDER BY mtime DESC, path DESC) = 1
  UNION ALL SELECT 'tests', cycle, run.ok AND coalesce(run.sec <= 5.0, false) FROM runs
  UNION ALL SELECT 'tree', strftime(ts, '%Y-%m-%d'), count(*) FILTER (WHERE event_type = 'view' AND value < 0.2) = 0 FROM events GROUP BY ALL),
seen AS (
  SELECT cycle, bool_and(ok) AS ok, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS bad,
         2 - count(*) FILTER (WHERE gate IN ('tests', 'tree')) AS absent FROM gates GROUP BY cycle)
SELECT cycle, ok AND absent = 0 AS ok, CAST(n + absent AS BIGINT) AS n_gates, CAST(bad + absent AS BIGINT) AS n_failed,
       CASE WHEN ok AND absent = 0 THEN 'FAST-FORWARD' ELSE 'INVESTIGATE' END AS action
FROM seen"""

ORACLE_SQL["q_search_hits"] = """
SELECT 'hits-' || CAST(page_id // 5 AS VARCHAR) AS payload_id, page_id % 5 AS pos,
       CASE WHEN page_id % 4 <> 0 THEN 'Page ' || page_id ELSE 'Untitled' END AS title, coalesce(url, '') AS href,
       md5(CASE WHEN page_id % 7 <> 0 THEN coalesce(html, '') ELSE '' END) AS body_md5, 'web' AS source FROM pages"""

_COUNTS = "count(*) AS n_items, CAST(sum(length(title)) AS BIGINT) AS title_chars FROM"
ORACLE_SQL["q_item_tables"] = f"""
WITH a AS (WITH {ARTICLES.strip()} SELECT * FROM articles), p AS (WITH {PAPERS.strip()} SELECT * FROM papers), w AS (WITH {WEB.strip()} SELECT * FROM web)
SELECT 'articles' AS kind, strftime(fetch_day, '%Y-%m-%d') AS digest_key, {_COUNTS} a GROUP BY ALL
UNION ALL SELECT 'papers', strftime(fetch_day, '%Y-%m-%d'), {_COUNTS} p GROUP BY ALL
UNION ALL SELECT 'web', strftime(fetch_day, '%Y-%m-%d'), {_COUNTS} w GROUP BY ALL"""

ORACLE_SQL["q_stream_ingest"] = "WITH " + ARTICLES.strip() + """
SELECT payload_id, CAST(pos AS BIGINT) AS pos, title, link, md5(summary) AS summary_md5,
       CAST(length(summary) AS BIGINT) AS summary_chars, published, array_to_string(authors, '|') AS authors,
       feed_name
FROM articles"""

# Append mode emits a day window once the watermark (max event time - 1 hour) passes its end.
# no late rows in one drain of the table: the streamed outcomes give the batch scores of every day
ORACLE_SQL["q_stream_scorecard"] = ORACLE_SQL["q_scorecard"]

# ---- files written and read back ---------------------------------------------------

ORACLE_SQL["q_landed_files"] = "WITH " + ARTICLES.strip() + """
SELECT payload_id, feed_name, count(*) AS n_items FROM articles JOIN
  (SELECT source AS src, 'Feed ' || upper(source) AS reg_name FROM (SELECT DISTINCT source FROM documents)) r ON source = src
GROUP BY ALL"""

ORACLE_SQL["q_pair_summaries"] = "WITH " + PAPERS.strip() + "," + COMPLETIONS + "," + PARSED + """,
p AS (SELECT arxiv_id, title, row_number() OVER (ORDER BY length(arxiv_id), arxiv_id) - 1 AS position FROM papers),
s AS (SELECT item_id, headline, row_number() OVER (ORDER BY item_id) - 1 AS position FROM parsed)
SELECT position, arxiv_id, title, item_id, md5(headline) AS headline_md5 FROM p JOIN s USING (position)"""

ORACLE_SQL["q_file_inventory"] = """
WITH f AS (SELECT CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS DATE) AS day, CAST(sum(strlen(text) + 1) AS BIGINT) AS length
           FROM documents GROUP BY 1),
m AS (SELECT *, CAST(day AS TIMESTAMP) < TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY AS gone FROM f)
SELECT strftime(day, '%Y-%m-%d') AS file_date, length, CASE WHEN gone THEN 'expired' ELSE 'kept' END AS status,
       CASE WHEN gone THEN 'delete' END AS action FROM m"""

ORACLE_SQL["q_report_lines"] = f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) - 1 AS line_no,
       md5({_LINE}) AS line_md5 FROM events"""

ORACLE_SQL["q_scorecard_files"] = "WITH " + CHECKS.strip() + "," + SCORES + """
SELECT cycle, CAST(printf('%.2f', score) AS DOUBLE) AS score FROM scores"""
