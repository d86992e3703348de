import pytest

from wildloom.llm import markup


@pytest.mark.parametrize(
    "text,want",
    [
        ("<p>a</p>", ["html"]), ("it&#x27;s", ["html"]), ("a &nbsp; b", ["html"]), ("x <b y</b>", ["html"]), ("<!-- c -->", ["html"]), ("end</p", ["html"]), ("# Head\n\ntext", ["markdown"]), ("- a\n- b", ["markdown"]),
        ("a **bold** word", ["markdown"]), ("a [link](http://x.example/y)", ["markdown"]), ("```\ncode\n```", ["markdown"]), ("use `x` here", ["markdown"]), ("use ``x`` here", ["markdown"]), ("who __pays__ for it", ["markdown"]), ("after *14.19.* it", ["markdown"]), ("site.example<p>next", ["html"]), ("Head\n====\n\ntext", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]),
        ("see [[Page|label]]", ["wiki"]), ("{{stub|date=2010}}", ["wiki"]), ("a ''word'' here", ["wiki"]), ("== Head ==", ["wiki"]), ("[https://x.example/y label here]", ["wiki"]),
        ("\\section{Head}", ["latex"]), ("holds $x^2 + y^2$ here", ["latex"]), ("\\[ a + b \\]", ["latex"]), ("$$O(n)$$", ["latex"]), ("a \\emph{b} c", ["latex"]),
    ],
)
def test_kinds(text, want):
    assert markup.kinds_of(text) == want


@pytest.mark.parametrize(
    "text",
    [
        None, "", "   ", "a < b and c > d", "std::vector<int> or a Map<String, Item>", "paid $5 and then $19", "C:\\temp\\newdata", "The regex \\d+\\s was slow", "max_row_count and min_row_count", "the pattern %wire_% and %a_b%", "***-**-****",
        "3 * 4 * 5", "¯\\_(ツ)_/¯", "¯\\(ツ)/¯", "C# and R&D glue", "someone wrote [sic] there", "— dash list", "see you :-) :* ^_^", "f**k that", "x" * 50_000, "* " * 3 + "a" if False else "5 > 3", "run __init__ first",
    ],
)
def test_look_alikes(text):
    assert markup.kinds_of(text) == []
    assert markup.clean_text(text) == ([], text)


def clean(text, lost=frozenset()):
    return markup.clean_text(text, lost)[1]


def test_html_structure_is_kept():
    page = '<h2>Head</h2><p class="c1">It&#x27;s <i>new</i><ul><li>a<li>b</ul><ol><li>x</li><li>y</li></ol><pre><code>a &lt; b\n  c</code></pre><table><tr><th>r</th><th>m</th></tr><tr><td>1</td><td>2</td></tr></table><blockquote>q</blockquote><img alt="pic" src="x"><a href="u">link</a>'
    t = clean(page)
    for part in ("## Head", "It's new", "- a\n- b", "1. x", "2. y", "```\na < b\n  c\n```", "r | m", "1 | 2", "> q", "pic", "link"):
        assert part in t, (part, t)
    assert "<" not in t.replace("a < b", "")


def test_light_markup_structure_is_kept():
    assert clean("Head\n====\n\n* a\n* b\n\n**bold** [t](http://x/y) ![i](z)\n\n```py\nx = '*a*'\n```") == "# Head\n\n- a\n- b\n\nbold t i\n\n```\nx = '*a*'\n```"
    assert clean("== Head ==\n'''b''' [[P|l]] [[Category:C]] {{x}}") == "## Head\nb l"
    t = clean("\\section{Head}\n\\begin{itemize}\n\\item a\n\\end{itemize}\n\\begin{equation}\\label{e}\nx_1\n\\end{equation} \\emph{w}~\\cite{k} and $a^2$")
    assert "# Head" in t and "- a" in t and "$$x_1$$" in t and "$a^2$" in t and "w" in t and "cite" not in t


def test_broken_and_long():
    for t in ("<" * 5000, "<p " * 3000, "</p>" * 3000, "[" * 3000, "`" * 3001, "*a " * 5000, "&#x27;" * 5000, "<pre>" + "x\n" * 20_000, "{{" * 2000, "$" * 3000):
        assert isinstance(clean(t), str)


def test_clean_corpus_edges(spark):
    good = '<div class="post9">long and visible text of the page</div><script>track("x");</script>'
    rows = [(i, good, "http://a.example/p/1") for i in range(40)] + [(100, good, "https://u:p@b.example:80/"), (101, good, None), (102, None, "http://a.example"), (103, "", ""), (104, "plain", "not a url")]
    df = spark.createDataFrame([(*r, "m", "q") for r in rows], "id int, text string, url string, Markup string, clean string")
    assert markup.host_votes(df, "text", "url").isEmpty()
    got = {r.id: r for r in markup.clean_corpus(df, "text", "url").collect()}
    assert len(got) == len(rows)
    assert got[0].clean == "long and visible text of the page" and got[101].clean == got[0].clean and got[0].markup == ["html"]
    assert got[102].clean is None and got[102].markup == [] and got[103].clean == "" and got[104].clean == "plain"
    assert markup.clean_corpus(df.limit(0), "text", "url").count() == 0


def test_path_generalises_numbers():
    (a,), (b,) = (markup.path_scores(f'<p class="c{n}">text</p>') for n in (1, 77))
    assert a == b


def test_visible_boilerplate_loses(spark):
    menu = '<div class="menu"><ul><li><a href="/a">Home</a><li><a href="/b">All the news</a></ul></div>'
    rows = [(i, f'{menu}<div class="post"><p>the own text of page {"abcdefgh"[i]} <a href="x">read on</a></p></div><div>Thanks</div>', f"http://a.example/{i}") for i in range(6)]
    rows += [(10 + i, rows[0][1], "http://copies.example/") for i in range(6)] + [(20 + i, r[1], None) for i, r in enumerate(rows[:6])]
    got = {r.id: r.clean for r in markup.clean_corpus(spark.createDataFrame(rows, "id int, text string, url string"), "text", "url").collect()}
    assert got[1] == "the own text of page b read on"
    assert all("All the news" in got[i] and "Thanks" in got[i] for i in (10, 15, 20, 25))


PARTS = {"nav": '<nav class="menu"><a href="/">Home</a> <a href="/n">News of the day</a></nav>', "footer": '<footer class="legal"><p>All rights reserved by the makers</p></footer>', "aside": "<aside><ul>{links}</ul></aside>"}


def page(host, k):
    links = "".join(f'<li><a href="/{k}{j}">read about {host} thing {k} {j}</a></li>' for j in range(4))
    return PARTS["nav"] + f'<main><h1>Title {"abcdefgh"[k]} of {host}</h1><p>own words of page {"abcdefgh"[k]} at {host}, <a href="x">with a link</a></p></main>' + PARTS["aside"].replace("{links}", links) + PARTS["footer"]


def test_menus_footers_and_link_lists_lose_by_host(spark):
    rows = [(h * 10 + k, page(f"h{h}", k), f"https://h{h}.example/{k}") for h in range(3) for k in range(5)]
    # here the same containers hold the content: texts that differ and are no links
    rows += [(90 + k, f'<nav class="menu">a long story told on page {"abcdefgh"[k]}</nav><footer class="legal"><p>and its end, the {"abcdefgh"[k]}th</p></footer>', f"https://odd.example/{k}") for k in range(5)]
    # too few pages for a vote, and no host
    rows += [(70 + k, page("few", k), "https://few.example/") for k in range(2)] + [(80 + k, page("none", k), None) for k in range(5)]
    df = spark.createDataFrame(rows, "id int, text string, url string")
    lost = {r.host: set(r.lost) for r in markup.host_votes(df, "text", "url").collect()}
    assert lost == {f"h{h}.example": {"nav.menu", "aside>ul>li", "footer.legal>p"} for h in range(3)}
    got = {r.id: r.clean for r in markup.clean_corpus(df, "text", "url").collect()}
    for h in range(3):
        for k in range(5):
            assert got[h * 10 + k] == f'# Title {"abcdefgh"[k]} of h{h}\n\nown words of page {"abcdefgh"[k]} at h{h}, with a link'
    assert all("a long story" in got[90 + k] and "and its end" in got[90 + k] for k in range(5))
    assert all("News of the day" in got[i] and "All rights" in got[i] and "thing" in got[i] for i in (70, 71, 80, 84))


def test_a_page_of_only_lost_containers_is_kept():
    t = "<nav><a href='x'>Home</a></nav>"
    assert clean(t, frozenset({"nav"})) == "Home" and clean(t + "<p>text</p>", frozenset({"nav"})) == "text"


def test_private_signs_and_long_spans_stay():
    assert clean("a \ue010 `x` \ue0010\ue011 **b** \ue000") == "a \ue010 `x` \ue0010\ue011 b \ue000"
    long = "word " * 100 + "end"
    assert markup.kinds_of(f"see *{long}* now") == ["markdown"] and markup.kinds_of(f"so ${'x_1 + ' * 60}y$ holds") == ["latex"]


def test_paths_are_whole_and_hidden_tags_go():
    deep = "<noscript><div><div><div>" + "hidden words " * 20 + "</div></div></div></noscript><body><div><div><div>seen</div></div></div></body>"
    assert markup.path_scores(deep) == {"body>div>div>div": 4}
    assert clean(deep) == "seen"
