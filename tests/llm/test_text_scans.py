"""PII, secrets and page extraction against plain versions."""

import time
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wosearch.llm import html_text, pii, secrets

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def base_of(spans: str, kinds: dict) -> str:
    return ",".join(s for s in spans.split(",") if s.split(":")[0] in kinds)


@pytest.mark.parametrize("odd", [True, False])
def test_pii_base_spans(spark, odd):
    docs = brute.odd_documents(spark) if odd else spark.read.parquet(DOCUMENTS)
    found = pii.find_spans(docs).select("text", pii.digest(F.col("pii_spans")).alias("s")).collect()
    assert len(found) == docs.count()
    for row in found:
        assert base_of(row.s, brute.PII) == brute.spans(brute.PII, row.text)


def test_pii_checksums_and_context(spark):
    texts = ["my iban is DE89 3704 0044 0532 0130 00", "DE88370400440532013000",
             "ssn 123-45-6789", "part 123-45-6789", "ssn 000-45-6789"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = pii.find_spans(docs).select("text", pii.digest(F.col("pii_spans")).alias("s")).collect()
    got = {r.text: r.s for r in rows}
    assert [got[t] for t in texts] == ["iban:11:38", "", "ssn:4:15", "", ""]


def test_redaction_leaves_no_base_span(spark):
    docs = brute.odd_documents(spark)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    for row in clean.collect():
        assert row.n_chars == len(row.text or "")
        assert "@c.de" not in (row.text or "") and "555-2186" not in (row.text or "")
    assert pii.redact(docs.limit(0)).count() == 0


def masked(text, spans):
    """Plain redaction: overlapping spans become one mark, named by the first."""
    out, at = "", 0
    for kind, start, end in spans:
        if start >= at:
            out += text[at:start] + f"<{kind.upper()}>"
        at = max(at, end)
    return out + text[at:]


@pytest.mark.parametrize("odd", [True, False])
def test_redaction_masks_the_spans(spark, odd):
    """The spans found hold all base spans of brute force, and exactly they are masked."""
    docs = (brute.odd_documents(spark) if odd else spark.read.parquet(DOCUMENTS)).filter("doc_id IS NOT NULL")
    spans = {r.doc_id: (r.text, r.s) for r in pii.find_spans(docs).select(
        "doc_id", "text", pii.digest(F.col("pii_spans")).alias("s")).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert set(spans) == set(clean)
    for i, (text, found) in spans.items():
        listed = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in found.split(",") if s)]
        assert set(filter(None, brute.spans(brute.PII, text).split(","))) <= set(found.split(","))
        assert clean[i] == (masked(text, listed) if listed else text)


def test_numbers_inside_longer_runs(spark):
    """Phones and cards next to other digits are no base spans; the method adds them."""
    texts = {
        "+1 (456) 555-2186 4436387346764662 4436": "tel:0:17,pan:18:34",
        "pay 4111 1111 1111 1111 20260101 now": "pan:4:23",
        "+49 30 12345678 4111-1111-1111-1111 x": "tel:0:15,pan:16:35",
        "1234 5678 9012 3456 7890 1234 5678": "",
        "4111 1111 1111 1111": "card:0:19",
    }
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = pii.find_spans(docs).select("text", pii.digest(F.col("pii_spans")).alias("s")).collect()
    assert {r.text: r.s for r in rows} == texts


def test_many_spans_in_one_text(spark):
    """100 000 addresses in a text: all found, all masked, in time linear in the text."""
    n = 50_000
    text = "".join(f"a{i}@b.de 10.0.0.{i % 256} " for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "x" * 10**6 + " é@b.c"), (3, "é" * 10**6)], "doc_id long, text string")
    start = time.time()
    rows = {r.doc_id: r.s for r in pii.find_spans(docs).select(
        "doc_id", pii.digest(F.col("pii_spans")).alias("s")).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.time() - start < 60
    assert rows[1] == brute.spans(brute.PII, text) and rows[2] == "" and rows[3] == ""
    assert clean[1] == "<EMAIL> <IP> " * n and clean[3] == "é" * 10**6


def test_context_words_in_any_case(spark):
    """What the words find in a text put in lower case, with any character beside, before and inside them."""
    rows = spark.range(1, 0xA800).filter("id < 12544 or id > 42000").select(F.format_string("%c", F.col("id").cast("int")).alias("c"))
    for kind in pii.KINDS:
        words = [w.replace("\\b", "").replace("-?", "") for w in kind.context.split("|")]
        forms = F.array(*(form for w in words for form in (
            F.concat(F.lit(w.title()), "c"), F.concat("c", F.lit(w.upper())), *(
                F.concat(F.lit(w[:i].upper()), F.col("c"), F.lit(w[i + 1:])) for i in range(len(w))
            ),
        )))
        texts = rows.select(F.explode(forms).alias("t"))
        assert texts.filter(F.lower("t").rlike(kind.context)).count() > 0
        assert texts.filter(F.lower("t").rlike(kind.context) != F.col("t").rlike(pii.in_any_case(kind.context))).count() == 0


def test_redaction_needs_no_table_of_cases(spark):
    """lower() and upper() make Spark set up ICU's cases, gigabytes of garbage in each executor."""
    docs = spark.createDataFrame([(1, "EMAIL a@b.de Card 4111 1111 1111 1111")], "doc_id long, text string")
    clean = pii.redact(docs)
    plan = clean._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" not in plan and "upper(" not in plan
    assert clean.first().text == "EMAIL <EMAIL> Card <CARD>"
    scores = pii.find_spans(docs).first().pii_spans
    assert [s.score for s in scores if s.kind in ("email", "card")] == [1.0, 1.0]


def test_redaction_of_overlapping_spans(spark):
    texts = ["see 10.0.0.0 4111 1111 1111 1111 there", "call +49 30 1234567@x.com now"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    card, mail = (r.text for r in sorted(pii.redact(docs).collect()))
    assert "1111" not in card and card.startswith("see <") and card.endswith("> there")
    assert "@x.com" not in mail and mail.startswith("call <") and mail.endswith("> now")


@pytest.mark.parametrize("odd", [True, False])
def test_secret_base_spans(spark, odd):
    docs = brute.odd_documents(spark) if odd else spark.read.parquet(DOCUMENTS)
    found = secrets.find_secrets(docs.select("doc_id", "text")).select(
        "doc_id", secrets.digest(F.col("spans")).alias("s")).collect()
    want = [(r.doc_id, brute.spans(brute.SECRETS, r.text)) for r in docs.collect()]
    got = [(r.doc_id, base_of(r.s, brute.SECRETS)) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_secret_checksums():
    body = "x" * 30
    value, check = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        check = secrets._BASE_62[digit] + check
    good, bad = f"ghp_{body}{check}", f"ghp_{body}{'0' * 6}"
    kinds = [secrets.KINDS[r].name for _, r, _ in secrets.scan(f"{good} {bad}")]
    assert kinds == ["github"]


def plain_scan(text):
    """Every start of every kind's pattern in turn, without keywords or memory of failures."""
    found = []
    for rank, kind in enumerate(secrets.KINDS):
        for m in kind.pattern.finditer(text):
            if kind.holds(m):
                found.append((m.start(), rank, m.end()))
    return sorted(found)


def test_scan_finds_what_patterns_find(spark):
    header = "eyJhbGciOiJIUzI1NiJ9"
    texts = [r.text for r in spark.read.parquet(DOCUMENTS).select("text").collect() if r.text]
    texts += [t for t in brute.ODD_TEXTS if t] + [
        f"eyJ{header}.{header}.abcdefghij {header}.eyJx {header}.{header}.abcdefgh-_", f"{header}{header}.{header}.aaaaaaaa",
        "sk_live_" + "a" * 30 + " xoxb-123456789-abcdefghijk AIza" + "x" * 35, "-----BEGIN RSA PRIVATE KEY----- eyJ.eyJ.eyJ",
    ]
    for text in texts:
        assert secrets.scan(text) == plain_scan(text)


@pytest.mark.parametrize("unit", ["eyJ", "eyJaaaaaaaa", "eyJaaaaaaaa.", "token=", "password ", "AKIA", "xoxb-1", "-----BEGIN "])
def test_many_keywords_in_one_text(unit):
    text = unit * 300_000
    start = time.time()
    found = secrets.scan(text)
    assert time.time() - start < 20
    assert all(0 <= a < b <= len(text) for a, _, b in found)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home of the site</a></li></ul></nav>
<div id="content"><h2>Head  line</h2><p>First &amp; long paragraph<br>with two lines of text.
<p>Ok.</p><script>var x = "<p>no</p>";</script><aside>Read on</aside>
<div class="comments"><p>A comment that is really much longer than any part of the text here.</p></div>
<p>The last paragraph has some more words to say.</div><form><p>Your mail, please, for our letters</p></form>
<footer>&copy; us</footer>"""


def test_page_text():
    want = ("Head line\nFirst & long paragraph with two lines of text.\nOk.\n"
            "The last paragraph has some more words to say.")
    assert html_text.main_text(PAGE) == want
    article = PAGE.replace('<div id="content">', "<article>", 1).replace("say.</div>", "say.</article>")
    assert html_text.main_text(article) == want


def test_page_of_sections():
    """Content regions of a page without an article, broken by a list, all count."""
    first, third = (["".join(f"{w} " * 60)[:299] + "." for w in ws] for ws in (("alpha", "beta", "gamma"), ("delta", "eta")))
    items = [f"Item {i} of a short list" for i in range(6)]
    page = (
        '<html><body><nav><a href="/">Home</a></nav><div id="content"><section><h2>Head</h2>'
        + "".join(f"<p>{p}</p>" for p in first) + "</section><section><ul>"
        + "".join(f"<li><a href='#'>{i}</a></li>" for i in items) + "</ul></section><section>"
        + "".join(f"<p>{p}</p>" for p in third) + "</section></div><footer>us</footer></body></html>")
    assert html_text.main_text(page) == "\n".join(["Head", *first, *items, *third])


PARAGRAPHS = ["".join(f"{w} " * 60)[:300].strip() + "." for w in ("alpha", "beta", "gamma")]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = '<div class="menu"><a href="/">Home</a><a href="/a">All about us and our many friends</a></div>'
TEASERS = '<div class="sidebar"><article><p>Another story that is told somewhere else on our pages.</p></article></div>'
COMMENTS = ('<div id="comments" class="comments-list">'
            + "".join(f'<article class="comment"><p>Reader {i} thinks otherwise here.</p></article>' for i in range(5)) + "</div>")


@pytest.mark.parametrize("wrapper", [
    '<div class="layout with-sidebar">{}</div>', '<div class="post comments-open">{}</div>', '<div class="widget-content">{}</div>',
    '<div id=page class="no-banner">{}</div>', '<div class="sidebar-left-page">{}</div>', '<div class="content related">{}</div>',
])
@pytest.mark.parametrize("inner", ["<article>{}</article>", '<div class="content">{}</div>', "<main><div>{}</div></main>", "{}"])
def test_wrappers_keep_their_article(wrapper, inner):
    page = f"<html><body>{MENU}{wrapper.format(inner.format(BODY))}{TEASERS}{COMMENTS}<footer>us</footer></body></html>"
    assert html_text.main_text(page) == "\n".join(PARAGRAPHS)


@pytest.mark.parametrize("name", ["comments", "sidebar", "related", "ad banner", "cookie-notice", "site-footer", "newsletter-box"])
def test_named_parts_are_left_out(name):
    aside = f'<div class="{name}"><p>Words that are not a part of the story told here.</p></div>'
    for inside in (True, False):
        page = f"<body><article>{BODY}{aside if inside else ''}</article>{'' if inside else aside}</body>"
        assert html_text.main_text(page) == "\n".join(PARAGRAPHS)


@pytest.mark.parametrize("unit", ["<div>x", "<b>x", "<p>x</q>", "<span><i>y</section>", "<li>x</b>", "<div></span>x"])
def test_many_unclosed_elements(unit):
    n = 400_000 // len(unit)
    start = time.time()
    text = html_text.main_text(unit * n)
    assert time.time() - start < 10 and sum(text.count(c) for c in "xy") == n


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav>x"), (None, "u", "plain"), (3, "u", "<nav>x"),
            (4, "u", "<p>" + "long text " * 50000), (5, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {(r.page_id, r.n_chars) for r in html_text.extract(pages).collect()}
    assert got == {(1, 0), (2, 0), (3, 0), (None, 5), (4, 499999), (5, 4)}
    assert html_text.extract(pages.limit(0)).count() == 0
