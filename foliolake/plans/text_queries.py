"""Paging, chunking, cleaning and scalar text functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import repair, text as X
from ..functions.once import once
from ..operators import browse, chunking, paging, segments, stats
from ..sources import files
from .bindings import BLANKS, PAGES, SPACES, TITLE, documents, lit, names, pages, sql_fold, sql_normalise, sql_strip, table, titled
from .registry import query

# --- paging -----------------------------------------------------------------------------------


@query(f"""WITH {PAGES} SELECT doc_id, page_number, length(text_content) AS char_count, md5(text_content) AS text_md5 FROM doc_pages""")
def page_pack(spark, sf):
    return pages(spark, sf).select("doc_id", "page_number", "char_count", F.md5("text_content").alias("text_md5"))


@query(f"""WITH parts AS (
  SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda p: {sql_strip('p')} <> '') AS ps FROM documents),
folded AS (SELECT doc_id, text, CASE WHEN len(ps) = 0 THEN NULL ELSE list_reduce(
    list_transform(ps, lambda p: {{'done': []::VARCHAR[], 'cur': p}}),
    lambda s, x: CASE WHEN length(s.cur) >= 200 THEN {{'done': list_append(s.done, s.cur), 'cur': x.cur}}
      ELSE {{'done': s.done, 'cur': {sql_strip("s.cur || chr(10) || x.cur")}}} END) END AS f FROM parts),
chunked AS (SELECT doc_id, CASE WHEN f IS NULL THEN [text] ELSE list_append(f.done, f.cur) END AS chunks FROM folded)
SELECT doc_id, CAST(generate_subscripts(chunks, 1) AS INTEGER) AS page_number, md5(unnest(chunks)) AS text_md5 FROM chunked""")
def page_split_sections(spark, sf):
    out = paging.split_pages(documents(spark, sf), separator="\n")
    return out.select("doc_id", "page_number", F.md5("text_content").alias("text_md5"))


@query(f"""WITH t AS (SELECT doc_id, replace(text, '. ', chr(12)) AS text FROM documents),
parts AS (SELECT doc_id, text, contains(text, chr(12)) AS fed,
  list_filter(string_split(text, CASE WHEN contains(text, chr(12)) THEN chr(12) ELSE chr(10) || chr(10) END), lambda p: {sql_strip('p')} <> '') AS ps FROM t),
folded AS (SELECT *, CASE WHEN len(ps) = 0 OR fed THEN NULL ELSE list_reduce(
    list_transform(ps, lambda p: {{'done': []::VARCHAR[], 'cur': p}}),
    lambda s, x: CASE WHEN length(s.cur) >= 200 THEN {{'done': list_append(s.done, s.cur), 'cur': x.cur}}
      ELSE {{'done': s.done, 'cur': {sql_strip("s.cur || chr(10) || chr(10) || x.cur")}}} END) END AS f FROM parts),
chunked AS (SELECT doc_id, CASE WHEN len(ps) = 0 THEN [text] WHEN fed THEN ps ELSE list_append(f.done, f.cur) END AS chunks FROM folded)
SELECT doc_id, CAST(generate_subscripts(chunks, 1) AS INTEGER) AS page_number, length(unnest(chunks)) AS char_count, md5(unnest(chunks)) AS text_md5 FROM chunked""")
def page_split_form_feeds(spark, sf):
    """Pages at form feeds, put in for the ends of sentences; texts without any are split at blank lines."""
    fed = documents(spark, sf).select("doc_id", F.replace("text", F.lit(". "), F.lit("\f")).alias("text"))
    return paging.split_pages(fed).select("doc_id", "page_number", F.col("char_count").cast("bigint").alias("char_count"), F.md5("text_content").alias("text_md5"))


_CLEAN = (r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), """
          r"""'[|_=\-]{10,}', '', 'g'), '[ \t]{5,}', '  ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')""")

@query(rf"""WITH c AS (SELECT doc_id, trim({_CLEAN}, {BLANKS}) AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n FROM c WHERE length(t) >= 200),
s AS (SELECT doc_id, t, n, CASE WHEN n <= 3200 THEN [0] ELSE list_concat(
   list_transform(generate_series(0, CAST(ceil((n - 3200) / 2400.0) AS BIGINT)), lambda i: i * 2400),
   CASE WHEN n - 800 > CAST(ceil((n - 3200) / 2400.0) AS BIGINT) * 2400 THEN [n - 800] ELSE [] END) END AS starts FROM n),
e AS (SELECT doc_id, t, n, unnest(starts) AS st, CAST(generate_subscripts(starts, 1) - 1 AS INTEGER) AS chunk_index FROM s)
SELECT doc_id, chunk_index, CAST(st AS INTEGER) AS char_offset, md5({sql_strip('substr(t, st + 1, 3200)')}) AS chunk_md5,
  CAST(length({sql_strip('substr(t, st + 1, 3200)')}) // 4 AS INTEGER) AS token_count_est FROM e""")
def chunk_fixed(spark, sf):
    out = chunking.chunk(documents(spark, sf), boundaries=False)
    return out.select("doc_id", "chunk_index", "char_offset", F.md5("chunk_text").alias("chunk_md5"), "token_count_est")


@query()
def chunk_boundaries(spark, sf):
    out = chunking.chunk(titled(spark, sf), title="title")
    return out.select("doc_id", "chunk_index", "char_offset", F.md5("chunk_text").alias("chunk_md5"), "token_count_est")


@query(f"""SELECT doc_id, md5(trim({_CLEAN}, {BLANKS})) AS clean_md5 FROM documents""")
def clean_ocr_noise(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(X.clean_ocr("text")).alias("clean_md5"))


# --- timed segments ---------------------------------------------------------------------------

_SEGMENTS = """seg AS (SELECT user_id, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 // 60 AS st0, value FROM events),
s AS (SELECT user_id, event_id, CAST(st0 AS DOUBLE) AS st, CAST(st0 + 1 + event_id % 9 AS DOUBLE) AS en FROM seg)"""


@query(f"""WITH {_SEGMENTS},
l AS (SELECT user_id, list({{'c': 0.0::DOUBLE, 'n': 0, 'e': en, 'pages': []::INTEGER[]}} ORDER BY st, en, event_id) AS xs, list(event_id ORDER BY st, en, event_id) AS ids FROM s GROUP BY user_id),
f AS (SELECT user_id, ids, list_reduce(list_prepend({{'c': 0.0::DOUBLE, 'n': 1, 'e': 0.0::DOUBLE, 'pages': []::INTEGER[]}}, xs),
  lambda a, x: {{'c': CASE WHEN x.e - a.c >= 30 THEN x.e ELSE a.c END, 'n': CASE WHEN x.e - a.c >= 30 THEN a.n + 1 ELSE a.n END,
    'e': x.e, 'pages': list_append(a.pages, a.n)}}) AS r FROM l)
SELECT user_id, unnest(ids) AS event_id, CAST(unnest(r.pages) AS BIGINT) AS page_number FROM f""")
def segment_page_numbers(spark, sf):
    return segments.number_segments(_segments(spark, sf), media="user_id", order=["start", "end", "event_id"]).select(
        "user_id", "event_id", "page_number")


def _segments(spark, sf):
    """Events as speech segments: one minute of event time is one second of the recording."""
    seconds = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 1000000)
    start = F.floor(seconds / 60).cast("double")
    return table(spark, sf, "events").select("user_id", "event_id", start.alias("start"),
                                             (start + 1 + F.pmod("event_id", F.lit(9))).alias("end"), F.col("event_type").alias("text"))


@query(f"""WITH {_SEGMENTS},
l AS (SELECT user_id, list({{'c': 0.0::DOUBLE, 'n': 0, 'e': en, 'pages': []::INTEGER[]}} ORDER BY st, en, event_id) AS xs, list(event_id ORDER BY st, en, event_id) AS ids FROM s GROUP BY user_id),
f AS (SELECT user_id, ids, list_reduce(list_prepend({{'c': 0.0::DOUBLE, 'n': 1, 'e': 0.0::DOUBLE, 'pages': []::INTEGER[]}}, xs),
  lambda a, x: {{'c': CASE WHEN x.e - a.c >= 30 THEN x.e ELSE a.c END, 'n': CASE WHEN x.e - a.c >= 30 THEN a.n + 1 ELSE a.n END,
    'e': x.e, 'pages': list_append(a.pages, a.n)}}) AS r FROM l),
p AS (SELECT user_id, unnest(ids) AS event_id, CAST(unnest(r.pages) AS BIGINT) AS page_number FROM f)
SELECT p.user_id, page_number, string_agg(event_type, ' ' ORDER BY s.st, s.en, s.event_id) AS text_content FROM p
 JOIN s ON s.event_id = p.event_id JOIN events e ON e.event_id = p.event_id GROUP BY ALL""")
def transcript_pages(spark, sf):
    return segments.segment_pages(_segments(spark, sf), media="user_id", order=["start", "end", "event_id"]).drop("char_count")


# --- identity ---------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({sql_normalise('text')}) AS content_hash FROM documents")
def content_hash(spark, sf):
    return documents(spark, sf).select("doc_id", X.content_hash("text").alias("content_hash"))


@query(f"SELECT doc_id, 'txt-' || substr(sha256({sql_normalise('text')}), 1, 12) AS txt_id, 'doc-' || substr(sha256(text), 1, 12) AS raw_id FROM documents")
def content_ids(spark, sf):
    return documents(spark, sf).select("doc_id", X.content_id("text", "txt-").alias("txt_id"), X.bytes_id("text", "doc-").alias("raw_id"))


@query("SELECT page_id, substr(md5(url), 1, 16) AS resume_key FROM pages")
def resume_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.resume_key("url").alias("resume_key"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages),
n AS (SELECT page_id, string_split(u, '/')[-1] AS name FROM b)
SELECT page_id, trim(translate(CASE WHEN length(regexp_extract(name, '^(.+)\.[^.]+$', 1)) > 0 THEN regexp_extract(name, '^(.+)\.[^.]+$', 1) ELSE name END, '_-', '  ')) AS title,
 lower(regexp_extract(name, '^.+\.([^.]+)$', 1)) AS extension FROM n""")
def title_from_path(spark, sf):
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", X.title_from_path(bare).alias("title"), X.suffix(bare).alias("extension"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


# --- mail headers rendered from orders and conversations ---------------------------------------

_MAIL_SQL = r"""mails AS (SELECT o_orderkey, CASE o_orderkey % 5
  WHEN 0 THEN '| From: | a\_b' || o_custkey || ' |' || chr(10) || '| Subject: | Order ' || o_orderkey || ' | x |' || chr(10) || '| Date: | Mon, ' || strftime(o_orderdate, '%-m/%-d/%Y') || ' 10:08 |'
  WHEN 1 THEN 'From: c' || o_custkey || chr(10) || 'Subject: Re ' || o_orderpriority || chr(10) || 'Date: Thu, ' || strftime(o_orderdate, '%d %b %Y') || ' 01:00'
  WHEN 2 THEN 'to: x' || chr(10) || 'date: ' || strftime(o_orderdate, '%Y-%m-%d')
  WHEN 3 THEN 'Memo' || chr(10) || 'Date: 2015-13-45'
  ELSE 'nothing here' END AS body FROM orders)"""


def _mails(spark, sf):
    o = table(spark, sf, "orders")
    key, day, nl = F.col("o_orderkey").cast("string"), F.col("o_orderdate"), F.lit("\n")
    kind = F.pmod("o_orderkey", F.lit(5))
    body = (
        F.when(kind == 0, F.concat(F.lit("| From: | a\\_b"), F.col("o_custkey").cast("string"), F.lit(" |\n| Subject: | Order "), key,
                                   F.lit(" | x |\n| Date: | Mon, "), F.date_format(day, "M/d/yyyy"), F.lit(" 10:08 |")))
        .when(kind == 1, F.concat(F.lit("From: c"), F.col("o_custkey").cast("string"), F.lit("\nSubject: Re "), F.col("o_orderpriority"),
                                  F.lit("\nDate: Thu, "), F.date_format(day, "dd MMM yyyy"), F.lit(" 01:00")))
        .when(kind == 2, F.concat(F.lit("to: x"), nl, F.lit("date: "), F.date_format(day, "yyyy-MM-dd")))
        .when(kind == 3, F.lit("Memo\nDate: 2015-13-45"))
        .otherwise("nothing here")
    )
    return o.select("o_orderkey", body.alias("body"))


@query(rf"""WITH {_MAIL_SQL} SELECT o_orderkey, {sql_strip(r"coalesce(nullif(regexp_extract(body, '(?i)\|\s*Subject:\s*\|\s*(.+?)(?:\s*\||\n)', 1), ''), nullif(regexp_extract(body, '(?im)^Subject:\s*(.+)$', 1), ''))")} AS subject FROM mails""")
def subject_from_text(spark, sf):
    return _mails(spark, sf).select("o_orderkey", X.subject_from_text("body").alias("subject"))


@query(rf"""WITH {_MAIL_SQL} SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso_date FROM orders""")
def date_from_text(spark, sf):
    return _mails(spark, sf).select("o_orderkey", F.date_format(X.date_from_text("body"), "yyyy-MM-dd").alias("iso_date"))


def _sql_header(field: str) -> str:
    found = (rf"coalesce(nullif(regexp_extract(body, '(?i)\|\s*{field}:\s*\|\s*(.+?)(?:\s*\||\n)', 1), ''), "
             rf"nullif(regexp_extract(body, '(?im)^{field}:\s*(.+)$', 1), ''))")
    return sql_strip(rf"regexp_replace({found}, '\\(.)', '\1', 'g')") + f" AS h_{field.lower()}"


@query(rf"""WITH {_MAIL_SQL} SELECT o_orderkey, regexp_matches(body, '(?i)\|\s*From:\s*\|') OR regexp_matches(body, '(?im)^From:\s+\S') AS is_mail,
 {', '.join(_sql_header(f) for f in V.EMAIL_HEADERS)} FROM mails""")
def email_headers(spark, sf):
    parsed = _mails(spark, sf).select("o_orderkey", X.looks_like_email("body").alias("is_mail"), X.email_headers("body").alias("h"))
    return parsed.select("o_orderkey", "is_mail", *[F.col(f"h.{f.lower()}").alias(f"h_{f.lower()}") for f in V.EMAIL_HEADERS])


# --- display ----------------------------------------------------------------------------------


@query(r"SELECT doc_id, md5(regexp_replace(text, '(?i)(the|tion\.|und)', '<mark>\1</mark>', 'g')) AS marked_md5 FROM documents")
def highlight_terms(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(X.highlight("text", ["the", "tion.", "und"])).alias("marked_md5"))


@query(r"""SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
 '(?i)(the|and)', '<mark>\1</mark>', 'g')) AS marked_md5 FROM documents""")
def highlight_escaped(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(X.highlight("text", ["the", "and"], escape=True)).alias("marked_md5"))


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS INTEGER) AS n FROM documents")
def occurrence_count(spark, sf):
    return documents(spark, sf).select("doc_id", X.occurrences("text", "The").alias("n"))


_EXT = r"CASE WHEN position('.' IN u) > 0 THEN lower(string_split(u, '.')[-1]) ELSE lower(u) END"
_TAGS = "['', 'markitdown; xlsx', 'eml; html', 'transcript', 'image; png', 'html', 'txt'][page_id % 7 + 1]"


def _typed_pages(spark, sf):
    tags = F.element_at(F.array(*[F.lit(t) for t in ["", "markitdown; xlsx", "eml; html", "transcript", "image; png", "html", "txt"]]),
                        F.pmod("page_id", F.lit(7)).cast("int") + 1)
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("u"), tags.alias("tags"))


def _sql_type_case() -> str:
    out = "CASE"
    for label, fragments, extensions in V.DOCUMENT_TYPES:
        rule = f"regexp_matches(tags, '{'|'.join(fragments)}')" + (f" OR ext IN ({names(extensions)})" if extensions else "")
        out += f" WHEN {rule} THEN '{label}'"
    return out + " ELSE 'Doc' END"


_TYPED = rf"""t AS (SELECT page_id, tags, {_EXT} AS ext FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u, {_TAGS} AS tags FROM pages))"""


@query(f"WITH {_TYPED} SELECT page_id, {_sql_type_case()} AS label FROM t")
def document_type(spark, sf):
    return _typed_pages(spark, sf).select("page_id", X.document_type("tags", "u").alias("label"))


@query(f"""WITH {_TYPED} SELECT page_id FROM t WHERE (contains(tags, 'html') OR ext = 'html') AND NOT regexp_matches(tags, 'email|eml')""")
def document_type_filter(spark, sf):
    return _typed_pages(spark, sf).filter(X.matches_type_filter("tags", "u", "html")).select("page_id")


@query(rf"""WITH m AS (SELECT page_id, url, url || ['', '/a.mp3', '\b.MOV', '/x.vtt'][page_id % 4 + 1] AS path FROM pages)
SELECT page_id, coalesce(nullif(string_split(replace(path, '\', '/'), '/')[-1], ''), 'Unknown file') AS base_name,
 CASE lower(string_split(path, '.')[-1]) WHEN '' THEN 'Unknown' {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in V.MEDIA_FORMATS.items())} ELSE upper(string_split(path, '.')[-1]) END AS media_format FROM m""")
def media_labels(spark, sf):
    ends = F.array(*[F.lit(x) for x in ["", "/a.mp3", "\\b.MOV", "/x.vtt"]])
    path = F.concat("url", F.element_at(ends, F.pmod("page_id", F.lit(4)).cast("int") + 1))
    return table(spark, sf, "pages").select("page_id", X.base_name(path).alias("base_name"), X.media_format(path).alias("media_format"))


@query(f"""SELECT doc_id, length({sql_strip('text')}) < 100 OR regexp_matches({sql_strip('text')}, '^[A-Z]+[0-9]+$') AS image_heavy FROM documents""")
def image_heavy(spark, sf):
    return documents(spark, sf).select("doc_id", X.is_image_heavy("text").alias("image_heavy"))


_SECTIONS = ["people", "objects", "setting"]


@query(r"""SELECT conv_id, turn, coalesce(nullif(trim(split_part(text, ' ', 1)), ''), '') || ' more ' || split_part(text, ' ', 2) AS people,
 split_part(text, ' ', 3) AS objects, split_part(text, ' ', 4) || ' again' AS setting FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations)""")
def caption_sections(spark, sf):
    w = [F.split_part(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" "), F.lit(i)) for i in range(1, 5)]
    body = F.concat(F.lit("intro\nPEOPLE: "), w[0], F.lit("\n  more "), w[1], F.lit("\n\nobjects: "), w[2], F.lit("\nSetting:  "), w[3], F.lit("\nagain"))
    got = table(spark, sf, "conversations").select("conv_id", "turn", X.caption_sections(body).alias("m"))
    return got.select("conv_id", "turn", *[F.element_at("m", F.lit(s)).alias(s) for s in _SECTIONS])


@query(f"""SELECT doc_id, md5(concat_ws(chr(10), nullif({TITLE}, ''), CASE WHEN doc_id % 2 = 0 THEN lang END, nullif(text, ''))) AS body_md5 FROM documents""")
def analysis_text(spark, sf):
    d = titled(spark, sf).withColumn("summary", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("lang")))
    return d.select("doc_id", F.md5(X.analysis_text("title", "summary", "text")).alias("body_md5"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END AS body, CASE WHEN doc_id % 4 = 0 THEN source END AS summary FROM documents)
SELECT doc_id, md5(coalesce(nullif(body, ''), summary)) AS body_md5 FROM d WHERE length(body) > 50 OR coalesce(summary, '') <> ''""")
def embeddable_text(spark, sf):
    d = documents(spark, sf).select("doc_id", F.when(F.pmod("doc_id", F.lit(10)) == 0, "").otherwise(F.col("text")).alias("body"),
                                    F.when(F.pmod("doc_id", F.lit(4)) == 0, F.col("source")).alias("summary"))
    return d.filter(X.is_embeddable("body", "summary")).select("doc_id", F.md5(X.embeddable_text("body", "summary")).alias("body_md5"))


@query("SELECT doc_id, lang || '; ' || source AS tags, string_split(lang || '; ' || source, '; ')[2] AS second FROM documents")
def list_text_round_trip(spark, sf):
    joined = documents(spark, sf).select("doc_id", F.array_join(F.array("lang", "source"), "; ").alias("tags"))
    return joined.withColumn("second", F.element_at(F.split("tags", "; "), 2))


@query("""SELECT doc_id, md5(substr(text, 1, 2000)) AS body_md5, substr(text, 1, 200) AS snippet, substr(text, 1, 150) AS question,
 CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '...' ELSE text END AS answer FROM documents""")
def truncations(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(X.truncate("text", 2000)).alias("body_md5"), X.truncate("text", 200).alias("snippet"),
                                       X.truncate("text", 150).alias("question"), X.truncate("text", 600, "...").alias("answer"))


@query("SELECT page_id, '[Image file: ' || name || ']' AS stub, CAST(length(name) + 14 AS INTEGER) AS char_count FROM (SELECT page_id, 'img' || page_id || '.png' AS name FROM pages)")
def image_stubs(spark, sf):
    f = table(spark, sf, "pages").select("page_id", F.concat(F.lit("/x/img"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"),
                                         F.col("html").cast("binary").alias("content"))
    stub = files.image_stubs(f)
    return stub.select(F.regexp_extract("text", r"img(\d+)\.png", 1).cast("bigint").alias("page_id"), F.col("text").alias("stub"), "char_count")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) AS y_text FROM orders")
def year_buckets(spark, sf):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select("o_orderkey", X.year_of(text).alias("y"), F.substring(text, 1, 4).alias("y_text"))


@query("""WITH d AS (SELECT doc_id, text, hex(encode(text)) AS h FROM documents),
 k AS (SELECT *, len(list_filter(range(1, length(h), 2), lambda i: substr(h, i, 2) IN ('81', '8D', '8F', '90', '9D'))) = 0 AND NOT contains(text, chr(65533)) AS repaired FROM d)
 SELECT doc_id, repaired, md5(CASE WHEN repaired THEN text END) AS text_md5 FROM k""")
def mojibake_repair(spark, sf):
    """Every text is misread and then repaired; five bytes have no letter in the Western code, texts with them stay as they are."""
    misread = documents(spark, sf).select("doc_id", "text", repair.as_misread("text").alias("misread"))
    fixed = once(misread, fixed=repair.fix_mojibake("misread"))
    same = F.col("fixed") == F.col("text")
    return fixed.select("doc_id", same.alias("repaired"), F.md5(F.when(same, F.col("fixed"))).alias("text_md5"))


# --- sources ----------------------------------------------------------------------------------

_BLOCK_END = r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|ul|ol|table|article|section)>"


def _sql_decode(expr: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


_VISIBLE = (r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), "
            rf"'(?is)<title\b.*?</title>', ' ', 'g'), '{_BLOCK_END}', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g')")
_BODY = sql_strip(rf"regexp_replace(regexp_replace({_sql_decode(_VISIBLE)}, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')")


@query(rf"""SELECT page_id, 'doc-' || substr(sha256(html), 1, 12) AS doc_id, md5({_BODY}) AS text_md5,
 {_sql_decode(sql_strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title FROM pages""")
def html_documents(spark, sf):
    return files.html_documents(table(spark, sf, "pages")).select("page_id", "doc_id", F.md5("text").alias("text_md5"), "title")


@query(f"""SELECT 'txt-' || substr(sha256({sql_normalise('text')}), 1, 12) AS doc_id, title FROM (SELECT text, 'Note Of ' || upper(substr(lang, 1, 1)) || substr(lang, 2) AS title FROM documents)
 WHERE {sql_strip('text')} <> ''""")
def text_file_documents(spark, sf):
    raw = documents(spark, sf).select(F.concat(F.lit("/in/note_of-"), F.col("lang"), F.lit(".txt")).alias("path"), "text")
    return files.text_to_documents(raw).select("doc_id", "title")


_URL_EXT = r"lower(regexp_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '^.+\.([^.]+)$', 1))"


def _sql_family(default: str) -> str:
    rules = " ".join(f"WHEN ext IN ({names(m)}) THEN '{f}'" for f, m in V.SCAN_FAMILIES.items())
    return f"CASE {rules} ELSE {default} END"


@query(f"""WITH e AS (SELECT {_URL_EXT} AS ext FROM pages) SELECT coalesce({_sql_family("'other'")}, 'total') AS family, count(*) AS n FROM e GROUP BY 1
UNION ALL SELECT 'total', count(*) FROM e""")
def file_census(spark, sf):
    return stats.file_census(table(spark, sf, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("path")))


@query(f"""WITH e AS (SELECT {_URL_EXT} AS ext FROM pages) SELECT {_sql_family("coalesce(nullif(ext, ''), 'other')")} AS family, count(*) AS n FROM e GROUP BY 1
UNION ALL SELECT 'total', count(*) FROM e""")
def file_census_staging(spark, sf):
    return stats.file_census(table(spark, sf, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("path")), keep_unknown=True)


# --- query text -------------------------------------------------------------------------------

_SYMBOLS = r"[?!;:@#$%^&*()\[\]{}<>~/\\|`]"
_NO_STAR = r"[?!;:@#$%^&()\[\]{}<>~/\\|`]"


@query(rf"""SELECT conv_id, turn, {sql_strip(f"regexp_replace(regexp_replace(text || '* (a) b?', '{_SYMBOLS}', ' ', 'g'), '{SPACES}', ' ', 'g')")} AS q FROM conversations WHERE role = 'user'""")
def sanitize_unified(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", X.sanitize_query(F.concat("text", F.lit("* (a) b?"))).alias("q"))


@query(rf"""WITH c AS (SELECT conv_id, turn, {sql_strip(f"regexp_replace(regexp_replace(regexp_replace(text || ' record* * (x)', '([^\\p{{L}}\\p{{N}}_])[*]', '\\1 ', 'g'), '{_NO_STAR}', ' ', 'g'), '{SPACES}', ' ', 'g')")} AS t
  FROM conversations WHERE role = 'user'),
k AS (SELECT conv_id, turn, t, array_to_string(list_filter(string_split(t, ' '), lambda w: lower(w) NOT IN ({names(V.QUERY_STOP_WORDS)})), ' ') AS kept FROM c)
SELECT conv_id, turn, CASE WHEN kept = '' THEN t ELSE kept END AS q FROM k""")
def sanitize_question(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", X.sanitize_question(F.concat("text", F.lit(" record* * (x)"))).alias("q"))


@query(rf"""WITH c AS (SELECT conv_id, turn, text, {sql_strip(f"regexp_replace(regexp_replace(regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])[*]', '\\1 ', 'g'), '{_NO_STAR}', ' ', 'g'), '{SPACES}', ' ', 'g')")} AS t FROM conversations),
k AS (SELECT *, array_to_string(list_filter(string_split(t, ' '), lambda w: lower(w) NOT IN ({names(V.QUERY_STOP_WORDS)})), ' ') AS kept FROM c)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN CASE WHEN coalesce(text, '') = '' THEN '' WHEN kept = '' THEN t || '|' ELSE kept || '|' END || 'bank*' WHEN 1 THEN 'alpha' ELSE '' END AS parsed FROM k""")
def planned_queries(spark, sf):
    """Every turn as a planner's reply: its whole text among the queries, a bare list, or no list at all."""
    c = table(spark, sf, "conversations")
    listed = F.to_json(F.array("text", F.lit(""), F.lit("bank*")))
    reply = (
        F.when(F.pmod("turn", F.lit(4)) == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
        .when(F.pmod("turn", F.lit(4)) == 1, F.lit(' ["alpha"] '))
        .when(F.pmod("turn", F.lit(4)) == 2, F.lit('{"a": 1}'))
        .otherwise("no json")
    )
    return c.select("conv_id", "turn", F.array_join(X.parse_planned_queries(reply), "|").alias("parsed"))
