"""Scalar text functions on hand-written inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from foliolake.functions import noise, repair, text as X


def one(spark, fn, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[f"c{i}" for i in range(len(values))])).collect()[0][0]


def test_content_hash_ignores_case_and_blanks(spark):
    want = hashlib.sha256("wire transfer to äbc".encode()).hexdigest()
    assert one(spark, X.content_hash, "  Wire  TRANSFER\n\tto  Äbc ") == want


def test_strip_removes_all_unicode_blanks(spark):
    assert one(spark, X.strip, "　\x1c\n a b \x85") == "a b"


@pytest.mark.parametrize("raw, want", [
    ("a" * 15, "aaa"), ("x\x00\x07y", "xy"), ("a" + "-" * 12 + "b", "a---b"), ("a      b", "a  b"), ("a\n\n\n\nb", "a\n\nb"),
    ("  keep  ", "keep"), ("|=_-|=_-|=_-x", "x"),
])
def test_clean_ocr(spark, raw, want):
    assert one(spark, X.clean_ocr, raw) == want


@pytest.mark.parametrize("raw, want", [
    ("| Date: | Mon, 1/24/2014 10:08:18 PM |", "2014-01-24"), ("| Date: | 4/16/2016 9:33:24 PM UTC |", "2016-04-16"),
    ("From: x\nDate: Thu, 01 Jan 2015 10:00", "2015-01-01"), ("date: 7 march 2016", "2016-03-07"), ("x\nDate: 2015-01-07", "2015-01-07"),
    ("Date: 2015-13-45", None), ("no date", None), ("| Date: | 24/1/2014 |", "2014-01-24"),
])
def test_date_from_text(spark, raw, want):
    got = one(spark, X.date_from_text, raw)
    assert (got.isoformat() if got else None) == want


def test_subject_prefers_table_cell(spark):
    assert one(spark, X.subject_from_text, "Subject: line\n| Subject: | Cell here | x |") == "Cell here"
    assert one(spark, X.subject_from_text, "a\nsubject:  Re: plan \nb") == "Re: plan"
    assert one(spark, X.subject_from_text, "nothing") is None


def test_email_headers(spark):
    got = one(spark, X.email_headers, "| From: | a\\_b@x.org |\n| To: | c |\nSubject: hi\nDate: today")
    assert (got["from"], got["to"], got["subject"], got["date"], got["cc"]) == ("a_b@x.org", "c", "hi", "today", None)


@pytest.mark.parametrize("query, want", [
    ("recommend* the plan?", "recommend* plan"), ("a * b", "b"), ("who is it", "who is it"), ("(wire) [transfer]!", "wire transfer"), ("", ""),
    ("What did Kash request?", "Kash request"), ("***", ""),
])
def test_sanitize_question(spark, query, want):
    assert one(spark, X.sanitize_question, query) == want


def test_sanitize_query_drops_every_star(spark):
    assert one(spark, X.sanitize_query, "bank* {fraud} \\ x|y`") == "bank fraud x y"


@pytest.mark.parametrize("reply, want", [
    ('["wire transfer", "bank*"]', ["wire transfer", "bank*"]), ('```json\n["x b", "", "c"]\n```', ["x b", "c"]), ("", []), ("garbage", []),
    ('{"q": 1}', []), ('["the"]', ["the"]),
])
def test_parse_planned_queries(spark, reply, want):
    assert one(spark, X.parse_planned_queries, reply) == want


def test_caption_sections(spark):
    got = one(spark, X.caption_sections, "intro\nPEOPLE: two men\n  in suits\n\nText: none\nNOTABLE:\nPEOPLE: last wins\nmore")
    assert got == {"people": "last wins more", "text": "none", "notable": ""}


def test_highlight_escapes_terms_and_markup(spark):
    assert one(spark, lambda c: X.highlight(c, ["a.b", ""]), "xA.By a-b") == "x<mark>A.B</mark>y a-b"
    assert one(spark, lambda c: X.highlight(c, ["lt"], escape=True), "<b> lt") == "&<mark>lt</mark>;b&gt; <mark>lt</mark>"


@pytest.mark.parametrize("path, name, kind", [("a\\b/c.MP3", "c.MP3", "MP3 Audio"), ("x/y.vtt", "y.vtt", "VTT"), ("x/", "Unknown file", "X/"), ("a.", "a.", "Unknown")])
def test_media_labels(spark, path, name, kind):
    assert one(spark, X.base_name, path) == name and one(spark, X.media_format, path) == kind


@pytest.mark.parametrize("tags, path, want", [
    ("pdf; email", "a.txt", "PDF"), (None, "x.eml", "Email"), ("xls", None, "Spreadsheet"), ("docx", "a.xlsx", "Spreadsheet"), ("", "a.vtt", "Transcript"),
    ("jpeg", "", "Image"), ("", "a.mp4", "Doc"), ("video", "", "Video"), ("md", "", "Text"), ("htm", "", "HTML"), ("ppt", "", "Slides"), ("doc", "", "Word"),
])
def test_document_type(spark, tags, path, want):
    assert one(spark, X.document_type, tags, path) == want


def plain_repair(text):
    try:
        fixed = text.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return text
    return text if "\ufffd" in fixed else fixed


def test_mojibake(spark):
    garbled = ["Ñandú – «día»".encode().decode("cp1252", errors="ignore"), "ï¿½ lost", "Ã", "Ã©Ã", "â‚¬ 5 â€œqâ€\x9d", "\x81Ã©", ""]
    for text in ["plain", "déjà vu", "naïve — “q”", "cafÃ© â€“", *garbled]:
        assert one(spark, repair.fix_mojibake, text) == plain_repair(text), text
    assert one(spark, repair.fix_mojibake, "cafÃ©") == "café"
    assert one(spark, repair.as_misread, "café “q") == "cafÃ© â€œq"



def test_noise_presets(spark):
    words = ["Ann Lee", "Main St", "12px", "mr", "a{b", "x](y", "ab", "123", "9ab", "12345", "A\nB", "covid", "shipped", "Deutsche Bank", "NASA", "p.s.",
             "x" * 60, "a1b2c3", "http://x", "50%", "Sent from my iPhone", "Jeffrey", "4 N.", "a=b"]
    df = spark.createDataFrame([(w,) for w in words], "text string")

    def kept(preset):
        return {r[0] for r in df.filter(noise.noise_filter(preset)).collect()}

    assert kept("directory") == {"Ann Lee", "Deutsche Bank", "NASA", "p.s.", "x" * 60, "a1b2c3", "http://x", "4 N.", "a=b", "shipped"}
    assert kept("graph_nodes") == {"Ann Lee", "x](y", "Sent from my iPhone", "Deutsche Bank", "p.s.", "x" * 60, "a1b2c3"}
    assert "http://x" not in kept("graph_edges") and "Main St" in kept("graph_edges")
    assert kept("project") >= {"ab", "Main St", "12px"} and not kept("project") & {"mr", "a1b2c3", "x" * 60, "p.s."}
    assert not kept("case") & {"p.s.", "x](y", "A\nB", "covid"} and "Main St" not in kept("case_person")


def test_html(spark):
    page = "<html><head><title> A &amp; B </title><style>p{}</style></head><body><p>one<br>two</p><script>x('</p>')</script><div>3 &lt; 4</div><!-- c --></body>"
    assert one(spark, X.html_to_text, page) == "one\ntwo\n3 < 4"
    assert one(spark, X.html_title, page) == "A & B"


def test_link_signals_and_year(spark):
    df = spark.createDataFrame([("2016-02-30",), ("2017-05-01",), (None,)], "d string")
    assert [r[0] for r in df.select(X.year_of("d")).collect()] == [None, 2017, None]
    assert df.select(F.count_if(X.is_image_heavy(F.lit("ABC00012345")))).collect()[0][0] == 3
