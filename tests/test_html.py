import time

from citeweave.operators import html


def blocks(page):
    return [(p[1], p[2], p[5]) for p in html.parse(page)[0]]


def texts(page):
    return [p[5] for p in html.parse(page)[0]]


def test_end_tags_are_implied():
    page = "<main><p>one two three four five<b> six<br><p>seven eight nine ten eleven</b> twelve<div>apart from all of the others</div>"
    assert texts(page) == ["one two three four five six", "seven eight nine ten eleven twelve"]
    assert texts("<main><p>one two three four five six<h2>Title</h2>no part of it</main>") == ["one two three four five six"]
    # a button hides an open paragraph, a table does too
    assert texts("<main><p>one two three four <button><p>five six seven eight nine ten</p></button> eleven</main>")[0].endswith("ten eleven")
    assert len(texts("<main><p>one two three four five six</p><table><tr><td><p>first cell with many words<td><p>second cell with many words<tr><td>x</table></main>")) == 3


def test_nested_blocks_are_passages_too():
    page = "<main><ul><li>one two three four five six<ul><li>inner item of some length<li>second inner item of length</ul>tail<li>next outer item of some length</ul></main>"
    assert texts(page) == ["one two three four five six inner item of some length second inner item of length tail", "inner item of some length", "second inner item of length", "next outer item of some length"]


def test_pieces_are_joined_by_a_space():
    assert texts("<main><p>These <b>words</b>stand<!-- x -->apart &amp; <i>a</i>lone here</p></main>") == ["These words stand apart & a lone here"]


def test_names_and_anchors():
    page = """<main><div id="top"><a name="n1"></a><p>Short</p><h2 id="h">Title <a id="t"></a></h2>
      <p>A paragraph of sufficient length here</p><p id="x">Another paragraph of sufficient length</p>
      <p id="x">Another paragraph, of the same name</p><p>One that has <a name="in"></a>its name inside of it</p><p>And the last one has got none</p></div></main>"""
    found = html.parse(page)[0]
    assert [p[2] for p in found] == ["p000001", "x", "x__dup_" + found[2][2][-12:], "in", "p000002"]
    # an anchor names every element around it as well; the first passage takes what was met before it
    assert found[0][3] == ["p000001", "top", "n1", "t", "in", "h"]
    assert found[0][4] == ["Title"] and found[3][3] == ["in"]


def test_headings_are_the_last_four():
    page = "<main>" + "".join(f"<h{k}>H{k}</h{k}>" for k in (1, 2, 3, 4, 5)) + "<p>A paragraph of sufficient length here</p><h6>H6</h6><p>Another one of sufficient length here</p></main>"
    assert [p[4] for p in html.parse(page)[0]] == [["H2", "H3", "H4", "H5"], ["H3", "H4", "H5", "H6"]]


def test_links_of_nested_blocks_count_for_both():
    page = "<main><ul><li>one two three four five <a href=' /a '>see <b>a</b></a><ul><li>inner item of some length <a href='#b'></a></ul></ul><p>too short <a href='/c'>c</a></p></main>"
    assert html.parse(page)[1] == [(0, "/a", "see a"), (0, "#b", "#b"), (1, "#b", "#b")]


def test_the_content_is_found():
    words = "of some length that will do"
    best = f"<div><p>one</p></div><div id='x'><div><p>First {words}</p><p>Second {words}</p></div></div>"
    assert texts(f"<body>{best}</body>") == [f"First {words}", f"Second {words}"]
    assert texts(f"<body>{best}<div class='wide content'><p>Third {words}</p></div></body>") == [f"Third {words}"]
    assert texts(f"<body><nav><main><p>Menu {words}</p></main></nav>{best}<article><p>Fourth {words}</p></article></body>") == [f"Fourth {words}"]
    assert texts(f"<p>No body and no container, {words}") == [f"No body and no container, {words}"]
    assert texts(f"<main><div class='side-promo2'><p>Kept {words}</p></div><div id='a:promo'><p>Left out {words}</p></div></main>") == [f"Kept {words}"]


def test_broken_pages_end(spark):
    for page in ("", "<", "<p", "</p></b></main>", "<!-- ", "<script>var t='</p>';", "<main><p>one two three four five six</main></main><p>x"):
        html.parse(page)
    began = time.time()
    html.parse("<main>" + "<b>" * 20_000 + "<p>one two three four five six" * 200)
    html.parse("<div>" * 20_000 + "<p>one two three four five six" * 200)
    assert time.time() - began < 20
    pages = spark.createDataFrame([(1, None), (2, "<main><p>one two three four five six"), (None, "<main><p>one two three four five six")], "page_id long, html string")
    assert sorted((r.page_id is None, r.text) for r in html.passages(pages).collect()) == [(False, "one two three four five six"), (True, "one two three four five six")]
