"""URL filter, extraction, archives: against brute force and exact round trips."""

import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from gridloom.llm import html, urls, warc
from gridloom.llm.common import Workspace, shared_dir
from gridloom.llm.queries import RULES

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/7?x", "https://m.example.com/en/71#t", "http://example.com/en/8/", "http://notexample.com/en/7",
    "http://a.NET/de/1", "http://example.net/de/80", "http://x.example.net/de/8?q#f", "http://example.net.de/de/8", "http://org/es/", "http://org", "http://org/es",
    "ftp://a.org/es/?://b.com/en/", "http://h.com?/en/", "http://u@h.com:80/en/1", "x://y.com/en/\n2",
]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host, path = "", ""
    for i, c in enumerate(rest):
        if c in "/?#":
            path = rest[i:]
            break
        host += c
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [r for _, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fit, key=len, default=None)


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "h", 0.5) for i, u in enumerate(URLS)], "page_id long, url string, host string, score double")
    got = {r.page_id: r for r in urls.filter_urls(df, RULES, urls.UrlModel([], -8.0, [{}, {}, {}])).collect()}
    verdict = {r: v for v, r in RULES}
    for i, u in enumerate(URLS):
        host, path, rule = brute_rule(u)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict.get(rule, "allow")), u
    assert urls.filter_urls(df.where("false"), RULES, urls.fit_on(df.where("false"))).count() == 0


def labelled(n, seed):
    import random

    r, out = random.Random(seed), []
    for _ in range(n):
        bad = r.random() < 0.3
        name = r.choice(["casino-win", "spam-farm", "cheap-pills"] if bad else ["news", "garden", "library", "museum"])
        tail = "&".join(f"k{j}={r.getrandbits(40)}" for j in range(r.randrange(3, 7))) if bad else ""
        out.append((f"https://{r.choice(['www.', 'm.', ''])}{name}{r.randrange(3)}.example.{r.choice(['com', 'net'])}/{'/'.join('ab' for _ in range(r.randrange(1, 4)))}{'?' + tail if tail else ''}", int(bad)))
    return out


def test_model_accuracy():
    model = urls.UrlModel.fit(*map(list, zip(*labelled(2000, 1))))
    test = labelled(500, 2)
    right = sum((p >= 0.5) == bool(y) for p, (_, y) in zip(model.score([u for u, _ in test]), test))
    assert right / len(test) > 0.97
    hosts = urls.UrlModel.fit(*map(list, zip(*[(u.split("?")[0], y) for u, y in labelled(2000, 3)])))
    assert sum((p >= 0.5) == bool(y) for p, (_, y) in zip(hosts.score([u.split("?")[0] for u, _ in test]), test)) / len(test) > 0.95


def test_fit_on_table(spark):
    df = spark.createDataFrame([(u, y) for u, y in labelled(300, 4)] + [(None, None), (None, 0), ("x" * 200_000, 1)], "url string, y int")
    assert urls.fit_on(df, label_col="y").trees and not urls.fit_on(df).trees
    n, precision, recall = urls.held_out(df, label_col="y")
    assert n > 50 and precision > 0.9 and recall > 0.9
    one = urls.fit_on(df.where("y = 1"), label_col="y")
    assert not one.trees and one.score(["http://a.com/"])[0] > 0.5 and urls.fit_on(df.where("false"), label_col="y").score(["u"])[0] < 0.5


def brute_score(model, url):
    """The model's sum over its trees, walked one by one over features worked out here."""
    import math

    host, _, rule = brute_rule(url)
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    path = "" if not rest else rest.split("?")[0].split("#")[0]
    u = url or ""
    share = {c: u.count(c) / len(u) for c in set(u)}
    dots = host.split(".")
    x = [len(u), len([p for p in path.split("/")[1:] if p]), sum(map(str.isdigit, u)) / len(u) if u else 0.0, -sum(p * math.log2(p) for p in share.values()), len([p for p in u.split("#")[0].partition("?")[2].split("&") if p])]
    x += [model.shares[k].get(".".join(dots[-k - 1 :]), model.mean) for k in range(3)]
    total = model.prior
    for tree in model.trees:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
        total += urls.RATE * tree
    return rule, 1 / (1 + math.exp(-total))


def test_verdicts_by_brute_force(spark):
    """Rules first, the trees' sum for the rest, over URLs that the rules label and others, some odd, some twice."""
    some = [u for u, _ in labelled(200, 6)] + [f"http://{h}.example.{t}/{p}/{k}{q}" for h in ("a", "m.b", "c") for t in ("com", "net", "org") for p in ("en", "de", "es", "fr") for k in range(5, 9) for q in ("", "?x=1&y=2")]
    rows = [(i, u) for i, u in enumerate([*some, *URLS, *URLS, "http://a.example.com/en/" + "9" * 100_000])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    model = urls.fit_on(df, rules=RULES)
    got = {r.page_id: r for r in urls.filter_urls(df, RULES, model).collect()}
    assert model.trees and len(got) == len(rows)
    for i, u in rows:
        rule, score = brute_score(model, u)
        assert got[i].score == pytest.approx(score, abs=1e-9), u
        assert got[i].verdict == (dict((r, v) for v, r in RULES)[rule] if rule else "block" if score >= 0.5 else "allow")
    assert {r.verdict for r in got.values()} == {"allow", "block"}


def test_suffixes_of_all_rows(spark, tmp_path, monkeypatch):
    """Hosts that the sample of trees misses have shares of their own, sent or joined."""
    rows = labelled(400, 5) + [(f"http://h{i}.example.com/a", i % 2) for i in range(300)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, y int").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    model = urls.fit_on(df, label_col="y", sample=60)
    every = urls._shares(urls._counts(*map(list, zip(*rows))), model.mean)
    assert model.trees and model.table is None and [set(x) for x in model.shares] == [set(x) for x in every]
    assert all(abs(model.shares[k][s] - v) < 1e-9 for k in range(3) for s, v in every[k].items())
    sent = {r.page_id: r.score for r in urls.filter_urls(df, RULES, model).collect()}
    monkeypatch.setattr(urls.common, "BROADCAST_ROWS", 10)
    model = urls.fit_on(df, label_col="y", sample=60)
    assert model.table is not None and len(model.shares[2]) < len(every[2])
    joined = {r.page_id: r.score for r in urls.filter_urls(df, RULES, model).collect()}
    assert sent.keys() == joined.keys() and all(abs(sent[i] - joined[i]) < 1e-9 for i in sent)


def page(host, k, body, menu="Home", extra=""):
    return f"""<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>T{k}</title><style>p{{x:1}}</style><script>var a="</p><article>";</script></head>
<body><header><a href=/>{host}</a></header><nav class="menu"><ul>{"".join(f"<li><a href='/{i}'>{menu} {i}</a></li>" for i in range(k % 4 + 1))}</ul></nav>{extra}
<div id='cookie-notice'>We use cookies</div><article><h1>Title {k} &amp; more</h1>{body}</article><aside>Side {k}</aside>
<section class="comments"><p>first! {k}</p></section><form><input name=q><p>Search</p></form><footer>&copy; {host}</footer></body></html>"""


def test_extraction(spark):
    bodies = {
        1: ("<p>One  <b>two</b>\n three</p><p>f&uuml;r &lt;x&gt; &#65;</p>", "One two three für <x> A"),
        2: ("<p><b>open<br><p>next</p><ul><li>a<li>b</ul>", "open next a b"),
        3: ("<p>x<i>y</i>z</p><div class='ad'>Buy <p>now</p></div><p>end</p><!-- <p>no</p> -->", "xyz end"),
        4: ("", ""), 5: ("<table><tr><td>1</td><td>2</td></tr></table><pre>a\tb</pre>", "1 2 a b"),
        6: ("<p>" + "long " * 40_000 + "</p>", " ".join(["long"] * 40_000)), 7: ("<p title='a > b'>attr</p>", "attr"),
    }
    rows = [(100 * h + k, f"http://h{h}.org/{k}", page(f"h{h}", k, b, extra="<div class=promo>Hi</div>" if k % 2 else ""), "t") for h in (1, 2) for k, (b, _) in bodies.items()]
    odd = [(900, "http://h1.org/z", None, "t"), (901, None, "", "t"), (902, "http://h1.org/y", "plain <b>text</b> &amp; more", "t"), (903, "http://lone.org/", page("lone", 9, "<p>alone</p>"), "t"), (902, "http://h1.org/y", "plain <b>text</b> &amp; more", "t")]
    df = spark.createDataFrame(rows + odd, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.url, r.text) for r in html.extract(df).collect()}
    for i, u, _, _ in rows:
        k = i % 100
        assert got[i] == (u, " ".join(x for x in (f"Title {k} & more", bodies[k][1]) if x)), (i, got[i][1][:100])
    assert got[900][1] == "" and got[901][1] == "" and got[902][1] == "plain text & more" and got[903][1] == "Title 9 & more alone"
    assert html.extract(df).count() == len(rows) + len(odd)
    assert html.extract(df.where("false")).count() == 0
    before, html.PLACES = html.PLACES, -1  # slots travel by a join
    try:
        assert {r.page_id: (r.url, r.text) for r in html.extract(df).collect()} == got
    finally:
        html.PLACES = before


def test_expression():
    """Groups and slots by what pages have and lack."""
    w = html.infer([f"<body><h1>T{k}</h1>{'<p>x</p>' * k}{'<hr><b>s</b>' if k == 2 else ''}<ul><li>Home<li>About</ul></body>" for k in range(1, 4)])
    assert w.expression(False) == [["one", "body", "fixed", [["one", "h1", "text", []], ["repeated", "p", "text", []], ["one", "ul", "none", [["repeated", "li", "fixed", []]]]]]] or w.expression(False)[0][1] == "body"
    inside = {x[1]: x for x in w.expression(False)[0][3]}
    assert inside["h1"][:3] == ["one", "h1", "text"] and inside["p"][:3] == ["repeated", "p", "text"] and inside["ul"][3] == [["repeated", "li", "fixed", []]]
    w = html.infer(["<body><p>a</p><div><i>x</i></div></body>", "<body><p>b</p></body>"])
    assert w.expression(False)[0][3][1][:2] == ["optional", "div"]
    assert html.infer([]).expression(False) == [] and html.apply(html.infer([]), "") == ""


def test_alignment_in_any_order():
    import random

    r = random.Random(3)
    pages = [plain_page("h", k, r) for k in range(12)]
    streams = [html.stream(p) for p in pages]
    one = html.infer(pages).places[False]
    for _ in range(5):
        r.shuffle(streams)
        parts = [streams[:4], streams[4:5], streams[5:]]
        joined = {}
        for part in parts:
            held = {}
            for x in part:
                html.align(held, x)
            html.align(joined, held)
        assert joined == one


def plain_page(host, k, r):
    """A page without an article element or telling names: a menu, a notice and a foot that all pages share, and a body of its own."""
    body = "".join(f"<div><p>{host} body {k} {j} {r.random()}</p></div>" for j in range(r.randrange(1, 5)))
    return f"<html><body><table><tr><td>Start</td><td>Archive</td></tr></table><div><section>We value your privacy</section></div><h2>Head {host} {k}</h2>{body}<div class=zz>Call 555</div><div class=ads>buy {k}</div></body></html>"


def test_the_wrapper_makes_the_text(spark, monkeypatch):
    """Without article elements and telling names: taking away the slots, the host or the frame words changes the text."""
    import random
    import re

    r = random.Random(4)
    pages = {(h, k): plain_page(h, k, r) for h in ("a.org", "b.org") for k in range(9)}
    rows = [(i, f"http://{h}/{k}", p) for i, ((h, k), p) in enumerate(pages.items())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {x.page_id: x.text for x in html.extract(df).collect()}
    for i, _, p in rows:
        body = re.sub(r"<table>.*?</table>|<section>.*?</section>|<div class=zz>.*?</div>|<div class=ads>.*?</div>", "", p)
        assert got[i] == " ".join(re.sub(r"<[^>]*>", " ", body).split())
    # each page with a wrapper of its own keeps what the host's pages share
    alone = {i: html.apply(html.infer([p]), p) for i, _, p in rows}
    assert all("privacy" in alone[i] and "privacy" not in got[i] for i in got)
    # no slots: no text
    page = html.read(rows[0][2])
    assert html.text_of(page, frozenset()) == "" and html.text_of(page, html.infer([p for _, u, p in rows if "a.org" in u]).slots(False)) == got[0]
    monkeypatch.setattr(html, "FRAME_WORDS", set())
    assert "buy 0" in html.apply(html.infer([p for _, _, p in rows[:9]]), rows[0][2])


def test_malformed_pages_in_one_pass():
    import time

    for x in ("<a ", '<a "', "<a title='x", '<a ">" ', "<div>", "<p class=ad>x</p>", "</p>", "<!", "<b><p class=ad></b>", "<!--", "<script>"):
        page = x * (1_000_000 // len(x))
        began = time.process_time()
        list(html.tokens(page))
        assert time.process_time() - began < 5, x
    assert html.apply(html.infer(["<a <b x"]), "<a <b x") == "<a <b x"
    assert list(html.tokens("a<b")) == [("", "a", False), ("", "<", False), ("", "b", False)]
    assert list(html.tokens("<p title='a>b'>x")) == [("p", "p", False), ("", "x", False)]
    assert [t for t, _, _ in html.tokens("<p title='a>b")] == ["p", ""]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_query_against_a_parser(spark):
    """Every page of the smallest table, against what a standard parser finds inside the article."""
    from html.parser import HTMLParser

    class Inside(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.article, self.skipped = [], 0, 0

        def handle_starttag(self, tag, attrs):
            gone = tag in ("aside", "form", "nav", "footer", "header", "script", "style", "button") or any(w in html.FRAME_WORDS for k, v in attrs if k in ("class", "id", "role") for w in (v or "").lower().replace("_", "-").split("-"))
            if tag == "article":
                self.article += 1
            elif self.skipped or gone and self.article:
                self.skipped += tag not in html.VOID | {"p", "b", "li", "i"}
            if tag not in html.INLINE:
                self.parts.append(" \n")

        def handle_endtag(self, tag):
            if tag == "article":
                self.article, self.skipped = self.article - 1, 0
            elif self.skipped and tag not in {"p", "b", "li", "i"}:
                self.skipped -= 1
            if tag not in html.INLINE:
                self.parts.append(" \n")

        def handle_data(self, data):
            if self.article and not self.skipped:
                self.parts.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {x.page_id: x.text for x in html.extract(pages).collect()}
    for x in pages.collect():
        p = Inside()
        p.feed(x.html or "")
        p.close()
        assert got[x.page_id] == " ".join("".join(p.parts).split()), x.page_id


def test_templates_of_a_host(spark):
    """Two templates and a rare page kind on one host: each page's own nesting counts, and no page is left out."""
    frame = lambda k, x: f"<html><head></head><body><nav><a>Menu</a></nav>{x}<footer>Foot</footer></body></html>"
    pages = [(k, frame(k, f"<article><h1>A{k}</h1><p>one {k}</p></article>"), f"A{k} one {k}") for k in range(40)]
    pages += [(100 + k, frame(k, f"<div><h1>B{k}</h1></div><section>Join us</section><div>two {k}</div>"), f"B{k} two {k}") for k in range(40)]
    pages += [(200, frame(0, "<div><h1>C</h1></div><p>rare</p>"), "C rare")]
    pages += [(300 + k, frame(0, "<div><h1>Same</h1></div><b>copied</b>"), "Same copied") for k in range(5)]
    df = spark.createDataFrame([(i, f"http://h.org/{i}", h) for i, h, _ in pages], "page_id long, url string, html string")
    expected = {i: t for i, _, t in pages}
    assert {r.page_id: r.text for r in html.extract(df.repartition(3)).collect()} == expected
    before, html.PLACES = html.PLACES, -1
    try:
        assert {r.page_id: r.text for r in html.extract(df.repartition(5)).collect()} == expected
    finally:
        html.PLACES = before


def test_pages_that_a_wrapper_lacks():
    one = lambda k, more="": f"<html><body><nav>Menu</nav><article><h1>T{k}</h1><p>a{k}</p></article>{more}<footer>F</footer></body></html>"
    w = html.infer([one(k) for k in range(3)])
    assert html.apply(w, one(9)) == "T9 a9"
    assert html.apply(w, one(9, "<article><p>second</p></article>")) == "T9 a9 second"
    plain = lambda k, more="": f"<html><body><section>Join us{more}</section><div>{k}</div></body></html>"
    w = html.infer([plain(k) for k in range(3)])
    assert html.apply(w, plain(7)) == "7"
    assert html.apply(w, plain(7, "<table><tr><td>figures</table>")) == "Join us figures 7"
    assert html.apply(w, plain(8).replace("</body></html>", "")) == "8"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.mark.parametrize("least", [0, 4])
def test_warc(spark, tmp_path, least):
    texts = ["<p>é</p>", "same", "same", None, "", "same", "x" * 300_000, "tiny", "abc", "abc", "line\r\n\r\nline", *("hot" for _ in range(20))]
    ids = [5, 9, 3, 12, 11, 4, 1, 2, 31, 30, 7, *range(50, 70)]
    rows = [(i, f"http://a/{i} b\n", t, "x") for i, t in zip(ids, texts)] + [(None, None, "same", "x"), (77, "u", "only", "x"), (77, "u", "only", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3).write.parquet(str(tmp_path / "t"))
    path = Workspace(spark, "warc-test").path
    manifest = warc.write_warc(spark.read.parquet(str(tmp_path / "t")), path, least)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    back = warc.read_warc(spark, path).collect()
    first = {}
    for i, _, t, _ in rows:
        if len((t or "").encode()) >= least and i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    expected = sorted(((i, len((t or "").encode()), digest((t or "").encode()), *(("response", None) if len((t or "").encode()) < least or first[t or ""] == i else ("revisit", first[t or ""]))) for i, _, t, _ in rows), key=str)
    twice = (77, 4, digest(b"only"), "response", None)
    expected.remove(twice)
    expected.append((77, 4, digest(b"only"), "revisit", 77))
    assert sorted(((r.page_id, r.payload_length, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == sorted(expected, key=str)
    for r in back:
        assert r.payload is None if r.record_type == "revisit" else digest(bytes(r.payload)) == r.payload_digest
    only = warc.read_warc(spark, path, "skip").where("record_type = 'revisit' and refers_to is not null and page_id in (9, 4, 1)").collect()
    assert sorted(r.page_id for r in only) == [4, 9] and all(r.payload is None for r in only)
    assert warc.read_warc(spark, path, "verify").where("payload_length > 1000").count() == 1


def test_warc_empty_and_plain(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    path = Workspace(spark, "warc-test").path
    warc.write_warc(empty, path)
    assert warc.read_warc(spark, path).count() == 0


def test_equal_payloads_when_cores_change(spark, tmp_path):
    """Every repeated payload keeps its one response, however the scan is cut the second time."""
    cores = "spark.sql.leafNodeDefaultParallelism"
    rows = [(i, "u", f"page {i % 50} " + "x" * 500) for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8).write.parquet(str(tmp_path / "t"))
    path = Workspace(spark, "warc-test").path
    kept = warc.sized

    def later(df):  # between the choice of responses and the writing
        spark.conf.set(cores, "1")
        return kept(df)

    try:
        spark.conf.set(cores, "8")
        warc.sized = later
        pages = spark.read.parquet(str(tmp_path / "t"))
        warc.write_warc(pages.unionAll(pages), path)
        back = warc.read_warc(spark, path, "verify").collect()
    finally:
        warc.sized = kept
        spark.conf.unset(cores)
    assert len(back) == 800 and sorted(r.page_id for r in back if r.record_type == "response") == list(range(50))
    assert all(r.refers_to == r.page_id % 50 for r in back if r.record_type == "revisit")


def test_odd_page_ids(spark, tmp_path):
    words = spark.createDataFrame([("a", "u", "x")], "page_id string, url string, html string")
    with pytest.raises(ValueError, match="integer"):
        warc.write_warc(words, Workspace(spark, "warc-test").path)
    none = spark.createDataFrame([(None, "u", "x"), (None, "u", "x"), (None, None, "y" * 3_000_000), (1, "u", "x")], "page_id int, url string, html string")
    path = Workspace(spark, "warc-test").path
    warc.write_warc(none, path)
    back = warc.read_warc(spark, path).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_length) for r in back), key=str) == [(1, "response", None, 1), (None, "response", None, 3_000_000), (None, "revisit", 1, 1), (None, "revisit", 1, 1)]
    names = [h for f in warc._files(*warc._fs(path)) for h in record_names(warc._fs(path)[1] + "/" + f)]
    assert len(names) == 4 == len(set(names))


def record_names(path):
    return [line for line in gzip.open(path).read().split(b"\r\n") if line.startswith(b"WARC-Record-ID")]


def foreign():
    """Records as other writers make them: (record, type, payload)."""
    http = "HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\n"
    out = [("WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 12\r\n\r\nsoftware: x\n\r\n\r\n", "warcinfo", "software: x\n")]
    for n in (0, 5, 9000, 70_000):
        payload = "p" * n
        out.append((f"WARC/1.1\r\nwarc-type: response\r\nWARC-TARGET-URI: http://a/{n}\r\nWarc-Payload-Digest: sha1:{digest(payload.encode())}\r\nContent-Type:application/http;\r\n msgtype=response\r\ncontent-length: {len(http) + n}\r\n\r\n{http}{payload}\r\n\r\n", "response", payload))
    out.append((f"WARC/1.1\r\nWARC-Type: revisit\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n{http}\r\n\r\n", "revisit", None))
    out.append(("WARC/1.1\r\nWARC-Type: metadata\r\nContent-Type: text/plain\r\nContent-Length: 10\r\n\r\na\r\n\r\nb: c\n\r\n\r\n", "metadata", "a\r\n\r\nb: c\n"))
    return [(a.encode(), b, c if c is None else c.encode()) for a, b, c in out]


@pytest.mark.parametrize("kind", ["members", "whole", "plain"])
def test_archives_of_other_writers(spark, tmp_path, kind):
    data = [r for r, _, _ in foreign()]
    name, packed = {"members": ("a.warc.gz", b"".join(map(gzip.compress, data))), "whole": ("a.warc.gz", gzip.compress(b"".join(data))), "plain": ("a.warc", b"".join(data))}[kind]
    (tmp_path / name).write_bytes(packed)
    got = [(r.record_type, r.payload if r.payload is None else bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert got == [(t, p) for _, t, p in foreign()]
    skipped = warc.read_warc(spark, str(tmp_path), "skip").where("target_uri like 'http://a/9%' or record_type = 'metadata'").select("record_type", "payload_length", "page_id").collect()
    assert [tuple(r) for r in skipped] == [("response", 9000, None), ("metadata", 10, None)]
    assert [r.payload_length for r in warc.read_warc(spark, str(tmp_path), "skip").where("target_uri >= 'http://a/5'").collect()] == [5, 70_000, 9000][:1] + [9000, 70_000]
    assert warc.read_warc(spark, str(tmp_path), "verify").count() == len(data)


def test_digests_are_verified(tmp_path):
    import pyarrow as pa

    data = warc.record("urn:x", 2, "u", b"pppp", digest(b"pppp"), None, "2024")
    assert list(warc.records(pa.BufferReader(data), lambda h: True, "verify"))[0][0]["page_id"] == 2
    broken = data.replace(b"pppp", b"pqpp", 1)
    assert list(warc.records(pa.BufferReader(broken), lambda h: True, "full"))[0][1] == b"pqpp"
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(pa.BufferReader(broken), lambda h: True, "verify"))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records(pa.BufferReader(data[:-10]), lambda h: True, "full"))
    warc.verify(b"x", {"warc-payload-digest": "sha256:" + hashlib.sha256(b"x").hexdigest()})
    warc.verify(b"x", {"warc-payload-digest": "crc:1"})


def test_pushdown():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    r = warc.WarcReader({"path": "/x"})
    left = list(r.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_length",), 5), EqualTo(("payload",), b""), StringStartsWith(("target_uri",), "http:"), GreaterThan(("date",), "2024")]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "EqualTo"] and len(r.wanted) == 3
    head = {"record_type": "response", "target_uri": "http://x", "date": "2025"}
    assert r.accepts(head) and not r.accepts(head | {"date": None}) and not r.accepts(head | {"target_uri": "ftp://x"})
    with pytest.raises(ValueError, match="payload"):
        warc.WarcReader({"path": "/x", "payload": "other"})


def test_shared_dir_follows_the_session(spark):
    assert Workspace(spark, "t").path.startswith(shared_dir(spark))
