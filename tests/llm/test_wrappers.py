"""Wrappers: known templates read back, optional and repeated parts inferred, broken markup, awkward rows."""
from parcelwise.llm import op6_wrappers as op

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul>{menu}</ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>A &amp; B {n}</h1></header><p><b>First</b> par{n}a&eacute;.<br><p>Second   one
{extra}</article><aside>side</aside><section id="comments"><article class="comment"><p>{noise}</p></article></section>
<form><input value="x">Your name</form><footer>&copy; foot</footer></body></html>"""


def page(n, extra=""):
    return PAGE.format(n=n, extra=extra, menu="".join(f"<li><a href='/{i}'>m{i}</a></li>" for i in range(3 + n % 4)), noise="comment " * 50 * n)


def want(n, extra=""):
    return " ".join(f"A & B {n} First par{n}aé. Second one {extra}".split())


def path_of(pages):
    w = op.wrapper_of(op.parse(pages[0]))
    for p in pages[1:]:
        w = op.merge(w, op.wrapper_of(op.parse(p)))
    return w, op.content_path(w)


def test_template():
    extras = ["", "<p>third", "<ul><li>x<li>y</ul>", "<div class='share'>tweet</div>", "<p>third<p class=ad>buy"]
    pages = [page(i, e) for i, e in enumerate(extras)]
    w, path = path_of(pages)
    assert path[-1] == "article"
    assert [op.extract(op.parse(p), path) for p in pages] == [want(0), want(1, "third"), want(2, "x y"), want(3), want(4, "third")]
    text = op.regex(w)
    assert "(<li> <a> # </> </>)+" in text and ")?" in text and "|" not in text


def test_host_without_article():
    pages = [f"<body><div class=top><a href=x>home</a> <a href=y>news</a></div><div class=wrap><div class=body><h2>t{i}</h2><p>{'word ' * 60}{i}</p><p>more {i}</p></div></div></body>" for i in range(4)]
    _, path = path_of(pages)
    assert op.extract(op.parse(pages[2]), path) == f"t2 {'word ' * 60}2 more 2"


def test_broken_markup():
    for html in ("", "plain text", "<p>a<p>b", "<article>a <b>c</article>", "<article><p>x</p", "<<a", "<article>1 < 2 &lt; 3</article>", "<div>" * 3000 + "deep"):
        tree = op.parse(html)
        op.extract(tree, op.content_path(op.wrapper_of(tree)))
    assert op.extract(op.parse("<article>1 &lt; 2<i>a</i>b</article>"), ["article"]) == "1 < 2ab"


def test_rows(spark):
    rows = [(i, "http://a.example/x" if i % 2 else "https://u@B.example:80/y", page(i), "h", "p") for i in range(12)]
    rows += [(None, None, "<p>alone</p>", "h", "p"), (3, rows[3][1], page(3), "h", "p"), (20, "not a url", None, "h", "p"), (21, "http://a.example/z", "", "h", "p"),
             (22, "http://a.example/long", page(5, "<p>" + "long " * 40_000), "h", "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string").repartition(4)
    out = op.main_text(df).collect()
    assert len(out) == len(rows)
    got = {(r["page_id"]): r["text"] for r in out}
    assert all(got[i] == want(i) for i in range(12))
    assert got[None] == "alone" and got[20] == got[21] == "" and got[22] == want(5, "long " * 40_000)
    assert op.main_text(df.limit(0)).collect() == []


def test_deep_pages(spark):
    """Pages nested deeper than Python's own stack, by hosts of their own and among others."""
    deep = {1: "<font>" * 3000 + "inline", 2: "<article>" + "<div>" * 3000 + "text <b>below", 3: "<article>" + "<div><p>a</p>" * 3000}
    rows = [(i, f"http://{h}.example/", html) for i, html in deep.items() for h in ("same", f"h{i}")] + [(9, "http://same.example/", page(9))]
    got = {(r["page_id"], r["url"]): r["text"] for r in op.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    assert len(got) == 7 and got[1, "http://h1.example/"] == "inline" and got[9, "http://same.example/"] == want(9)
    assert got[2, "http://h2.example/"] == got[2, "http://same.example/"] == "text below"
    assert got[3, "http://h3.example/"] == " ".join("a" * 3000)
    w, _ = path_of([page(0), page(1, "<p>third"), deep[3]])
    assert op.dumped(op.loaded(op.dumped(w))) == op.dumped(w) and op.regex(op.loaded(op.dumped(w))) == op.regex(w)
