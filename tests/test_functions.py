import random
import re
from datetime import datetime
from html import escape

import pytest
from pyspark.sql import functions as F

from cairnfield.functions import dates, highlight, html, text, urls
from cairnfield.functions.encoders import HashingEncoder, OverlapScorer

AS_OF = datetime(2024, 6, 1)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Site.ORG:443/a/", "https://site.org/a"),
        ("http://site.org:8080/a#part", "http://site.org:8080/a"),
        ("https://site.org/", "https://site.org/"),
        ("https://site.org", "https://site.org"),
        ("https://site.org/a?utm_source=x&b=2&a=1&fbclid=9", "https://site.org/a?a=1&b=2"),
        ("https://site.org/a?page=1", "https://site.org/a"),
        ("https://site.org/a?page=2", "https://site.org/a?page=2"),
        ("https://site.org/a?q=a+b&q=", "https://site.org/a?q=&q=a+b"),
        ("mailto:a@site.org", "mailto:a@site.org"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(url, want):
    assert urls.canonical(url) == want


def test_url_columns(spark):
    df = spark.createDataFrame([("https://www.Site.org:80/a",), (" Plain Text ",), (None,)], "u string")
    assert [r[0] for r in df.select(urls.source_domain(F.col("u"))).collect()] == ["site.org", "plain text", None]
    one = spark.createDataFrame([("https://a.org/x/login/1", ["*/x/*"]), ("https://a.org/page", ["*.PAG?"]), ("https://a.org/page", ["*/pag?"])], "u string, p array<string>")
    assert [r[0] for r in one.select(urls.matches_glob(F.col("u"), ["*/login*"])).collect()] == [True, False, False]
    assert [r[0] for r in one.select(urls.matches_glob(F.col("u"), F.col("p"))).collect()] == [True, False, True]


def norm(spark, s):
    return spark.createDataFrame([(s,)], "t string").select(text.normalize_text(F.col("t"))).first()[0]


def test_normalize_text(spark):
    raw = "# Head\r\n\r\n\r\n\r\nSee [the plan](http://x.org/a) and ![pic](y.png)http://x.org/b  now\n-----\nWe use Cookies here\nFree prior consent\nManage preferences | save\n"
    assert norm(spark, raw) == "# Head\n\nSee the plan and now\n\nFree prior consent"


def test_truncate_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0, 9.0],), ([0.0, 0.0, 1.0],)], "v array<float>")
    got = [r[0] for r in df.select(text.truncate_normalize(F.col("v"), 2)).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2023-05-01", "2023-05-01 00:00:00"),
        ("20230501", "2023-05-01 00:00:00"),
        ("2023-05-01T10:00:00Z", "2023-05-01 10:00:00"),
        ("2023-05-01T10:00:00+02:00", "2023-05-01 08:00:00"),
        ("2023-05-01 something", "2023-05-01 00:00:00"),
        ("1970-01-01", None),
        ("2031-01-01", None),
        ("May 1, 2023", None),
        ("01/05/2023", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_iso_date(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "d string")
    assert df.select(dates.parse_iso_date(F.col("d"), AS_OF).cast("string")).first()[0] == want


def test_published_at_priority(spark):
    head = '<meta name="date" content="2020-01-01"><META content="2021-02-03" property="article:published_time">'
    rows = [(None, head), ({"date": "2019-09-09"}, head), (None, '<script>{"datePublished": "2022-03-04"}</script>'), (None, "<meta name='pubdate' content='2018-01-02'>"), (None, None), (None, '<meta name="date" content="soon">')]
    df = spark.createDataFrame(rows, "m map<string,string>, h string")
    got = [r[0] for r in df.select(F.date_format(dates.published_at(F.col("m"), F.col("h"), AS_OF), "yyyy-MM-dd")).collect()]
    assert got == ["2021-02-03", "2019-09-09", "2022-03-04", "2018-01-02", None, None]


def test_main_text():
    page = '<html><head><title> A &amp; B </title><style>p{}</style></head><body><nav>menu</nav><div class="x cookie-banner"><div>accept</div></div><p>One <b>two</b><br>three</p><footer>foot</footer><!-- no --></body>'
    assert html.main_text(page) == ("A & B", "One two\nthree")
    assert html.main_text(None) == ("", "")


@pytest.mark.parametrize(("written", "title"), [("the&amp;&amp", "the&&amp"), ("A &lt;b&gt; &amp;amp &quot", 'A <b> &amp &quot'), ("&ampx; R&D &#39;&#x27; &#39", "&ampx; R&D '' &#39"), ("Caf&eacute; &amp;lt;", "Café &lt;")])
def test_only_whole_references_of_a_title_are_read(written, title):
    assert html.main_text(f"<head><TITLE id=t>{written}</TITLE></head><p>R&ampD &copy") == (title, "R&D ©")


ARTICLE = "The committee set out how firms should report on their emissions, and what auditors are to look at in each of the three scopes."


def test_link_lists_chrome_and_consent_tables_go_and_articles_stay():
    links = "".join(f'<li><a href="/topic/{i}/a-long-path?x={i}">Topic number {i} of the site</a></li>' for i in range(12))
    consent = "".join(f'<tr class="c r{i}"><td id="n{i}"><span class="k">_ga{i}</span></td><td><span class="p">Google</span></td><td><span class="d">2 years</span></td></tr>' for i in range(8))
    page = f"""<html><head><title>Report</title></head><body>
      <div class="share"><span>Share this</span></div>
      <div class="menu"><ul>{links}</ul></div>
      <article><h1>New rules</h1><p>{ARTICLE}</p><h2>Scope</h2><p>{ARTICLE} See <a href="/x">the annex</a> for more.</p><p>It is binding.</p><h2>Related</h2></article>
      <div class="tb"><table>{consent}</table></div>
      <div>Print</div></body></html>"""
    assert html.main_text(page) == ("Report", f"New rules\n{ARTICLE}\nScope\n{ARTICLE} See the annex for more.\nIt is binding.")
    assert "Topic number 3 of the site" in html.main_text(page, prune=False)[1]


def test_main_text_of_odd_pages():
    # nothing would stay: all does
    assert html.main_text("<p>one</p><p>two</p>")[1] == "one\ntwo"
    # unclosed paragraphs, stray ends, deep nesting, text without any block
    assert html.main_text(f"<p>{ARTICLE}<p>{ARTICLE}</div></b>")[1] == f"{ARTICLE}\n{ARTICLE}"
    assert html.main_text("<div>" * 3000 + ARTICLE)[1] == ARTICLE
    assert html.main_text(ARTICLE)[1] == ARTICLE
    assert html.main_text("<ul>" + "<li>item of a plain list that has no links at all" * 3 + "</ul>")[1].count("plain list") == 3


def _query_terms(query):
    words = re.findall(r"[A-Za-z0-9][A-Za-z0-9\-']+", query.lower())
    return list(dict.fromkeys(w for w in words if len(w) > 2 and w not in highlight.STOP_WORDS))


def _highlight(query, body, size=highlight.WINDOW_CHARS, slack=highlight.SLACK_CHARS):
    """One sentence after the other joins, right and left by turns."""
    query, body = query or "", body or ""
    wanted = _query_terms(query)
    parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+|\n+", body.strip()) if p.strip()]
    if parts:
        count = [sum(p.lower().count(t) for t in wanted) for p in parts]
        lo = hi = count.index(max(count))
        right = True
        while len(" ".join(parts[lo: hi + 1])) < size and (lo > 0 or hi < len(parts) - 1):
            if (right and hi < len(parts) - 1) or lo == 0:
                hi += 1
            else:
                lo -= 1
            right = not right
        whole = " ".join(parts[lo: hi + 1])
        if len(whole) > size + slack:
            whole = whole[: size + slack].rsplit(" ", 1)[0] + "…"
    else:
        whole = body[:size]
    safe = escape(whole)
    return re.sub(rf"\b({'|'.join(map(re.escape, wanted))})\b", r"<mark>\1</mark>", safe, flags=re.IGNORECASE) if wanted else safe


def test_highlight(spark):
    rng = random.Random(3)
    words = ["carbon", "Rules", "scope-3", "it's", "a", "prix", "élan", "the", "<b>", "&", "x" * 50, "carbon's", "ca"]
    rows = [("carbon rules", "First one.\nCarbon rules & carbon prices! Third?"), ("", "plain <b>"), ("x", ""), ("word", "word " * 300), ("word", "x" * 900), (None, None), ("abc", " \n "), ("lan", "élan lan"), ("the of it", "The sea. It is.")]
    for _ in range(120):
        body = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "! ", "\n", "\n\n", "?\n "]) for _ in range(rng.randint(1, 200)))
        rows.append((" ".join(rng.sample(words, 3)), body))
    df = spark.createDataFrame(rows, "q string, t string")
    got = df.select(highlight.highlight(F.col("q"), F.col("t")).alias("h"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    found = [r.h for r in got.collect()]
    for (q, t), h in zip(rows, found, strict=True):
        assert h == _highlight(q, t), (q, t)
    assert "<mark>Carbon</mark> <mark>rules</mark> &amp; <mark>carbon</mark> prices" in found[0]


def test_best_place_is_that_of_the_native_count(spark):
    """Each term is looked for once in a text: a long query on a long text takes no time for each pair of sentence and term."""
    rng = random.Random(4)
    words = ["ana", "anana", "banana", "x-ray", "it's", "Élan", "İna", "Kelvin", "na", "Ananas"]
    rows = [("ana", None), (None, "ana. ana ana"), ("zzz", "One. Two."), ("ana", " \n "), ("ana banana", "anana.\nbanana ananana! ana")]
    rows += [(" ".join(rng.choices(words, k=4)), "".join(rng.choice(words) + rng.choice([" ", " ", ". ", "\n", "? "]) for _ in range(60))) for _ in range(60)]
    many = [f"w{i:04}" for i in range(2000)]
    rows.append((" ".join(many), ". ".join(" ".join(rng.choices(many, k=5)) for _ in range(2000))))
    df = spark.createDataFrame(rows, "q string, t string").withColumn("b", highlight.best_place(F.col("q"), F.col("t")))
    found = df.select(highlight.highlight(F.col("q"), F.col("t"), best=F.col("b")).alias("h")).collect()
    for (q, t), r in zip(rows[:-1], found, strict=False):
        assert r.h == _highlight(q, t), (q, t)
    assert found[-1].h.count("<mark>") > 20
    parts = rows[-1][1].split(". ")
    begins = [sum(p.count(t) for t in many) for p in parts]
    assert highlight.best_sentence(parts, many) == begins.index(max(begins))


def test_highlights_query_against_brute_force(spark, sf_dir):
    from cairnfield.plans.registry import QUERIES

    rows = QUERIES["highlights"](spark, sf_dir).collect()
    assert rows and all(r.highlight == _highlight(r.query, r.text) for r in rows)


def test_default_scorers():
    v = HashingEncoder(16).encode(["a b", "a b", ""])
    assert (v[0] == v[1]).all() and abs((v[0] ** 2).sum() - 1) < 1e-6 and not v[2].any()
    assert OverlapScorer().score(["a b", "a b", ""], ["a b c", "z", "z"]).tolist() == [4.0, -4.0, -4.0]
