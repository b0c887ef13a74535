import time
from html.parser import HTMLParser

import duckdb
import pytest
from texts import prose, seeded

from sensorloom.llm import html_text as H
from sensorloom.llm import license_scan as S


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
        ("<ul><li>a<li>b<ol start=3><li>c</li><li>d</ol></ul>end", "- a\n- b\n  3. c\n  4. d\n\nend"),
        ("<table><tr><th>n<th>value<tr><td>longer<td>1<tr><td colspan=2>both of them together</table>", "n       value\nlonger  1\nboth of them together"),
        ("<pre> a\n   b</pre>x", " a\n   b\n\nx"),
        ("a<script>var t='</p>';</script>b<style>.z{display: none}</style><i class=z>no</i><i hidden>no</i><b style='visibility:hidden'>no</b>c", "abc"),
        ("<head><title>t</title></head><body>x &amp; y&nbsp;z &lt;p&gt;", "x & y z <p>"),
        ("<details><summary>open me</summary>inside</details><details open>seen</details>", "open me\nseen"),
        ("a <b>b</b>\n c</i></div>  d", "a b c d"),
        ("<dl><dt>k<dd>v<dt>l</dl>", "k\nv\nl"),
        ("x<!-- no --!>y<!doctype html>z<", "xyz<"),
        ("", ""),
        ("<pre>a\n<b>b</b>\nc</pre>", "a\nb\nc"),
        ("<pre>\r\n\r\n x\r\n\r\ny\n</pre>z", " x\n\ny\n\nz"),
        ("<style>@media print{.x{display:none}}</style><p class=x>seen", "seen"),
        ("<style>@media screen and (min-width:600px){.x{display:none}} @media (max-width:600px){.y{display:none}}</style><b class=x>no</b><b class=y>yes</b>", "yes"),
        ("<style>.x{display:none}.x{display:block}</style><p class=x>seen", "seen"),
        ("<style>.x{display:none}</style><p class=x style='display:block'>seen", "seen"),
        ("<style>.x{display:none !important}</style><p class=x style='display:block'>no", ""),
        ("<style>div.x{display:none} p.x{color:red}</style><div class=x>no</div><p class=x>seen", "seen"),
        ("<style>#a .b > i{display:none} .q i{display:none}</style><div id=a><p class=b><i>no</i><b><i>yes</i></b></div>", "yes"),
        ("<style>a:hover{display:none} p{display:none} #s{display:block}</style><a>link</a><p>no<p id=s>seen", "link\n\nseen"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
        ("<style media=print>p{display:none}</style><p hidden>no<p>seen", "seen"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td colspan=300>wide<td>x<tr>" + "<td>i" * 300 + "<td>y</table>", "wide" + " " * 896 + "x\n" + "i  " * 300 + "y"),
        ("<svg><title>no</title><text>label</text><path d='M'/></svg><math><mi>x</mi><annotation>no</annotation></math>", "label\nx"),
        ("<div>" * 5000 + "deep", "deep"),
    ],
)
def test_layout(page, text):
    assert H.visible_text(page) == text


def test_deep_pages_take_time_in_proportion():
    for page in ("<div>" * 16_000 + "deep", "<p><span>" * 8_000 + "deep", "<p><button>" + "<div>" * 16_000 + "deep", "<ul><li>" * 4_000 + "<div>" * 8_000 + "deep"):
        start = time.process_time()
        assert H.visible_text(page).endswith("deep")
        assert time.process_time() - start < 1.5


class Naive(HTMLParser):
    """All text outside of head, script and style."""

    def __init__(self):
        super().__init__()
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("head", "script", "style") and tag != "script" or tag == "script"

    def handle_endtag(self, tag):
        self.skip -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_pages_keep_all_visible_words(spark):
    path = "/root/testdata/sf0.001"
    pages = dict(duckdb.sql(f"select page_id, html from '{path}/pages.parquet'").fetchall())
    got = {r["page_id"]: r["text"] for r in H.op9_html_text(spark, path).collect()}
    assert len(got) == len(pages)
    for k, page in pages.items():
        naive = Naive()
        naive.feed(page)
        naive.close()
        mine = [w for w in got[k].split() if w != "-"]
        assert "".join(mine) == "".join(w for w in naive.words if w != "-")


def test_null_pages(spark):
    pages = spark.createDataFrame([(None, None, "u"), (1, "", "u"), (1, "<p>x", "u"), (1, "<p>x", "u")], "page_id long, html string, text string")
    assert sorted((str(r["page_id"]), r["text"]) for r in H.extract(pages).collect()) == [("1", ""), ("1", "x"), ("1", "x"), ("None", "")]
    assert H.extract(pages.limit(0)).count() == 0


def test_every_template_is_found_in_prose(spark):
    rng = seeded(11)
    texts, wanted = [None, "", prose(rng, 50), "We license nothing and copyright less.", "licen " * 3000], [set()] * 5
    for name, wording in S.TEMPLATES:
        texts.append(f"{prose(rng, 40)}\n  {wording.replace(' ', chr(10), 2)}\n{prose(rng, 40)}")
        wanted.append({name})
    texts.append(prose(rng, 3000) + " Released under the MIT License. " + prose(rng, 300) + " Licensed under CC BY-NC 4.0. " + prose(rng, 3))
    wanted.append({"MIT", "CC-BY-NC-4.0"})
    texts.append("Released under the Mitten Licence.")  # another wording
    wanted.append(set())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: {f["license"] for f in r["findings"]} for r in S.scan(docs).collect()}
    assert [got[k] for k in range(len(texts))] == wanted
    assert S.scan(docs.limit(0)).count() == 0


def test_differences_are_counted():
    scanner = S.Scanner(S.Settings())
    wording = S.TEMPLATES[2][1]
    n, found = scanner.findings(wording.replace("free of charge", "free of any charge").replace("and/or sell", "and sell"))
    assert n == 1 and [(f["license"], f["missing"], f["between"]) for f in found] == [("MIT", 1, 1)]


def least_differences(template, block):
    """Fewest missing and inserted words over every stretch of the block, cell by cell; words that tell licenses apart count as very many."""
    row, lost, put = [0] * (len(block) + 1), *([S.FAR if x else 1 for x in S.telling(words)] for words in (template, block))
    for i, w in enumerate(template):
        new = [row[0] + lost[i]]
        for j, b in enumerate(block):
            new.append(min(row[j + 1] + lost[i], new[-1] + put[j], row[j] if b == w else 10**12))
        row = new
    return min(row)


def test_alignment_equals_brute_force():
    rng = seeded(31)
    scanner = S.Scanner(S.Settings())
    for _ in range(60):
        k = rng.randrange(len(S.ALL))
        own = list(scanner.words[k])
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(0, 3)] = [rng.choice(["other", "word", own[at]]) for _ in range(rng.randrange(0, 3))]
            own = own or ["x"]
        block = prose(rng, rng.randrange(0, 30)).split() + own + prose(rng, rng.randrange(0, 30)).split()
        least, found = least_differences(scanner.words[k], block), scanner.places(block, k, len(scanner.words[k]) - 1)
        assert bool(found) == (least < len(scanner.words[k]))
        if not found:
            continue
        missing, between, a, b = found[0]
        assert missing + between == least
        assert b - a == len(scanner.words[k]) - missing + between and least_differences(scanner.words[k], block[a:b]) == missing + between


def test_edited_notices_are_found_as_brute_force_says():
    """A notice with words lost or put in anywhere, its first ones too, counts exactly if some template's differences are few."""
    rng = seeded(32)
    scanner, most = S.Scanner(S.Settings()), S.Settings().most_different
    for _ in range(80):
        k = rng.randrange(len(S.ALL))
        own = S.ALL[k][1].split()
        for _ in range(rng.randrange(0, max(2, len(own) // 6))):
            at = rng.randrange(len(own))
            if not scanner.blocks(own[at]) and len(own) > 3:
                own[at : at + 1] = [] if rng.random() < 0.5 else [own[at], "elsewhere"]
        text = prose(rng, 60) + "\n" + " ".join(own) + "\n" + prose(rng, 60)
        words = S._WORD.findall(text.lower())
        fits = {S.ALL[j][0] for j, template in enumerate(scanner.words) if least_differences(template, words) <= most * len(template)}
        found = {f["license"] for f in scanner.findings(text)[1]}
        assert bool(found) == bool(fits) and found <= fits


def test_notices_without_their_first_words():
    for wording, name in ((S.TEMPLATES[2][1].split(" ", 3)[3], "MIT"), (next(t for n, t in S.TEMPLATES if n == "ISC"), "ISC")):
        n, found = S.Scanner(S.Settings()).findings("before this " + wording + " and after")
        assert n == 1 and [f["license"] for f in found] == [name]


def names(text):
    return [f["license"] for f in S.Scanner(S.Settings()).findings(text)[1]]


def test_words_that_tell_licenses_apart():
    commons = "This work is licensed under a Creative Commons Attribution{} International License."
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("This library is licensed under the GNU Lesser General Public License, version 2.1.") == ["LGPL-2.1"]
    assert names(commons.format("-NoDerivatives 4.0")) == ["CC-BY-ND-4.0"] and names(commons.format("-NonCommercial-ShareAlike 4.0")) == ["CC-BY-NC-SA-4.0"]
    assert names(commons.format(" 4.0")) == ["CC-BY-4.0"] and names(commons.format(" 5.0")) == []
    assert names("This work is licensed under a Creative Commons Attribution 3.0 Unported License.") == ["CC-BY-3.0"] and names("Licensed under CC BY-SA 2.0.") == ["CC-BY-SA-2.0"]
    assert names("This work is licensed under the GNU General Public License, version 4.") == [] and names("Licensed under the Apache License, Version 1.1.") == []
    assert names("This work is licensed under the GNU Affero General Public License, version 3.") == ["AGPL-3.0"]
    free = next(t for n, t in S.TEMPLATES if n == "GPL-2.0")
    assert names(free.replace("General", "Lesser General")) == [] and names(free.replace("version 2", "version 7")) == []
    assert names("MIT License") == ["MIT"] and names("Released under the BSD 4-Clause License.") == ["BSD-4-Clause"]
    for name in S.TAGGED:
        assert names(f"// SPDX-License-Identifier: {name}\nint main()")[0] == name.removesuffix("-only").removesuffix("-or-later")


def test_repeated_notices_take_no_longer_each():
    import time

    scanner, notice = S.Scanner(S.Settings()), "This work is licensed under the GNU General Public License, version 3. "
    began = time.process_time()
    for text, n in ((notice * 400, 400), ((notice + "Released under the MIT License. ") * 3000, 6000)):
        found = scanner.findings(text)[1]
        assert len(found) == n and [f["word"] for f in found] == sorted(f["word"] for f in found)
    assert time.process_time() - began < 5


def test_repeated_rows_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "MIT License", 7, "x"), (1, "MIT License", 7, "x"), (None, None, None, None)], "doc_id long, text string, findings int, n_blocks string")
    assert sorted(str((r["doc_id"], r["n_blocks"], len(r["findings"]))) for r in S.scan(docs).collect()) == ["(1, 1, 1)", "(1, 1, 1)", "(None, 0, 0)"]


def page(html):
    return H.visible_text(html)


def test_first_attribute_counts():
    assert page('<p style="color:red" style="display:none">a</p>') == "a"
    assert page("<style>.y{display:none}</style><p class=x class=y>a") == "a"


def test_siblings_and_places():
    css = lambda rule, body: page(f"<style>{rule} {{display:none}}</style>{body}")
    assert css(".a + .b", "<p class=a>1<p class=b>2<p class=b>3") == "1\n\n3"
    assert css(".a ~ .b", "<p class=b>0<p class=a>1<p>2<p class=b>3") == "0\n\n1\n\n2"
    assert css("li:first-child", "<ul><li>1<li>2</ul>") == "- 2" and css("li:last-child", "<ul><li>1<li>2</ul>") == "- 1"
    assert css("li:nth-child(2n+1)", "<ul><li>1<li>2<li>3<li>4</ul>") == "- 2\n- 4" and css("li:nth-last-child(-n+2)", "<ul><li>1<li>2<li>3</ul>") == "- 1"
    assert css("p:not(.k):not(#j)", "<p class=k>1<p id=j>2<p>3") == "1\n\n2" and css("p:only-child", "<div><p>1</div><div><p>2<p>3</div>") == "2\n\n3"
    assert css("div > h2 + p ~ .x", "<div><h2>a</h2><p>b</p><i>c</i> <b class=x>d</b></div>") == "a\n\nb\n\nc"
    assert css("p:hover", "<p>1") == "1" and css("p::before", "<p>1") == "1" and css(".a:is(p)", "<p class=a>1") == "1"
    assert css("[title='a > b'] p", "<div title='a > b'><p>1</div><p>2") == "2"
    assert css("p:not(.a, .b)", "<p class=a>1<p class=b>2<p>3") == "1\n\n2"


def test_numbers_and_white_space():
    assert page("<ol><li>a<li value=9>b<li>c</ol>") == "1. a\n9. b\n10. c" and page("<ol start=-1><li>a<li>b<li value=x>c</ol>") == "-1. a\n0. b\n1. c"
    assert page("<style>.c{white-space:pre}</style><div class=c>a  b\n c<b>d</b></div><div>a  b\n c</div>") == "a  b\n cd\na b c"
    assert page('<div style="white-space:pre-line">a  b\n  c</div>') == "a b\nc" and page('<pre style="white-space:normal">a  b\nc</pre>') == "a b c"
    assert page("x<pre>\r\n\na</pre>") == "x\n\n\na" and page("x<pre>\na\n\n b</pre>y") == "x\n\na\n\n b\n\ny"


def naive_layout(node, kept=False):
    """Tokens of a tree, by recursion: words, one blank, or line ends set before and after."""
    out = []
    for child in node:
        if isinstance(child, str):
            if kept:
                for k, line in enumerate(child.split("\n")):
                    out += [("line",)] * (k > 0) + [("word", line)] * bool(line)
            else:
                words = child.split()
                out += [("blank",)] * child[:1].isspace()
                for k, w in enumerate(words):
                    out += [("blank",)] * (k > 0) + [("word", w)]
                out += [("blank",)] * (child[-1:].isspace() and bool(words))
            continue
        tag, inside = child
        if tag == "br":
            out.append(("line",))
        elif tag == "span":
            out += naive_layout(inside, kept)
        elif tag == "li":
            text = naive_text(naive_layout(inside, kept))
            if text:
                first, *rest = text.split("\n")
                out += [("apart", 1), ("word", "\n".join(["- " + first, *["  " + x if x else "" for x in rest]]))]
            out.append(("apart", 1))
        else:
            n = {"div": 1, "ul": 2, "p": 2, "pre": 2}[tag]
            out += [("apart", n), *naive_layout(inside, kept or tag == "pre"), ("apart", n)]
    return out


def naive_text(tokens):
    text, apart, lines, blank = "", 0, 0, False
    for token, *of in tokens:
        if token == "word":
            text += ("\n" * (apart + lines) or " " * blank if text else "") + of[0]
            apart, lines, blank = 0, 0, False
        elif token == "apart":
            # A block's distance takes in line ends before it.
            apart, lines, blank = max(apart + lines, of[0]), 0, False
        elif token == "line":
            lines, blank = lines + 1, False
        else:
            blank = True
    return text


def test_layout_equals_a_naive_renderer_on_random_trees():
    rng = seeded(41)

    def tree(depth, allowed):
        out = []
        for _ in range(rng.randrange(0, 5)):
            tag = rng.choice(["text", "text", "br", *allowed])
            if tag == "text":
                out.append(rng.choice(["a", " b", "c ", " d e ", "f  g", "h\ni", " "]))
            elif tag == "br":
                out.append(("br", []))
            elif depth:
                inner = {"span": [a for a in allowed if a == "span"], "p": ["span"], "pre": ["span"], "ul": ["li"]}.get(tag, ["span", "div", "p", "ul", "pre"])
                inside = tree(depth - 1, inner)
                out.append((tag, [x for x in inside if isinstance(x, tuple) and x[0] == "li"] if tag == "ul" else inside))
        return out

    def html_of(node):
        return "".join(x if isinstance(x, str) else "<br>" if x[0] == "br" else f"<{x[0]}>{html_of(x[1])}</{x[0]}>" for x in node)

    def plain(node):  # lists within lists stand closer, which the naive renderer doesn't know
        return all(isinstance(x, str) or x[0] not in ("ul", "pre") and plain(x[1]) for x in node)

    compared = 0
    for _ in range(3000):
        node = tree(4, ["span", "div", "p", "ul", "pre"])
        if all(isinstance(x, str) or x[0] != "ul" or all(plain(li[1]) for li in x[1]) for x in node) and not any("<ul><li>" in html_of(x[1]) for x in node if isinstance(x, tuple) and x[0] != "ul") and "<pre>" not in html_of(node).replace("<pre>a", ""):
            compared += 1
            assert H.visible_text(html_of(node)) == naive_text(naive_layout(node)), html_of(node)
    assert compared > 500
