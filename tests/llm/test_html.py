import pytest

from seawake.llm import html_extract as H

PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href='/'>menu</a></nav><div class='cookie-notice'>We use cookies.</div>{}<footer>foot</footer></body></html>"


def text(body, path=None):
    return H.Page(PAGE.format(body)).extract(path)


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article><h1>Head &amp; more</h1><p>One  <b>bold</b>\n text.<br>Two.<p>Three &copy;</article>", "Head & more\nOne bold text. Two.\nThree ©"),
        ("<article><p>A long enough body of text.</p><aside>side</aside><form>f</form><script>if(a<b)x()</script><p>More.</p></article>", "A long enough body of text.\nMore."),
        ("<div class='post-12'><p>Text of the post, which is long.</p><div class='comments'><p>A reader says this at length, and more of it.</p></div></div>", "Text of the post, which is long."),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one\ntwo\na\nb"),
        ("<article><header><h1>Title</h1><p>by someone</p></header><p>Body text here.</p></article>", "Title\nBody text here."),
        ("<article><p>Unclosed <i>tags <b>here</p><p>go on</article>", "Unclosed tags here\ngo on"),
        ("<article><!-- <p>no</p> --><p title='a > b'>yes</p><p hidden>no</p><p style='display: none'>no</p></article>", "yes"),
        ("<article></article>", ""),
        ("<div><a href=x>link</a> <a href=y>link</a></div><main><p>main text</p></main>", "main text"),
    ],
)
def test_main_text(body, want):
    assert text(body) == want


@pytest.mark.parametrize("source", ["", "   ", "plain words", "<", "<p", "<p>&lt;b&gt;", "</div></div>x", "<!--", "<script>", "<a b='", "<p " * 2000, "<div>" * 3000 + "deep"])
def test_odd_sources_do_not_fail(source):
    assert isinstance(H.Page(source).extract("/html/body"), str)


def test_plain_words_are_text():
    assert H.Page("plain words").extract(None) == "plain words" and H.Page("<p>&lt;b&gt;").extract(None) == "<b>"


def test_hosts_agree_on_a_path(spark):
    good = "<div class='story s{}'><p>{}</p></div><div class='teaser'>{}</div>"
    pages = [(k, f"http://a.example/{k}", PAGE.format(good.format(k, "main words " * 20, "teaser " * 5))) for k in range(8)]
    # here the teaser outweighs the story, but the host's other pages know better
    pages.append((8, "http://a.example/8", PAGE.format(good.format(8, "main words " * 20, "teaser " * 60))))
    pages += [(9, None, PAGE.format("<article><p>alone</p></article>")), (10, "http://b.example", None), (10, "http://b.example", None), (None, "x", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS path", "3 AS text")
    paths = {r["host"]: r["path"] for r in H.host_paths(df).collect()}
    assert paths == {"a.example": "/html/body/div.s#.story"} or paths == {"a.example": "/html/body/div.s#.story".replace("/html", "")}
    got = H.main_texts(df).collect()
    assert len(got) == len(pages)
    by_id = {r["page_id"]: r for r in got}
    assert all(by_id[k]["text"] == ("main words " * 20).strip() and by_id[k]["n_chars"] == 219 for k in range(9))
    assert (by_id[9]["text"], by_id[10]["text"], by_id[None]["text"]) == ("alone", "", "")
    assert H.main_texts(df.limit(0)).count() == 0


LONG = "long body of words " * 60


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article><h1>Head</h1><p class=lead>Lead.</p><div class=txt><p>{}</p></div><div class=conclusion>End.</div></article>", "Head\nLead.\n{}\nEnd."),
        ("<main><h1>Head</h1><article><div class=txt>{}</div><section>More.</section></article></main>", "Head\n{}\nMore."),
        ("<div id=page><div class=top><a href=x>all of it a link</a></div><div class=box><h1>Head</h1><div class=txt>{}</div><div class=more>End.</div></div></div>", "Head\n{}\nEnd."),
        ("<h1>Head</h1><p>Lead.</p><p><a href=x>links</a></p><div class=txt>{}</div><div class=teaser>Other.</div>", "Head\nLead.\n{}"),
        ("<main><article class=a><h2>One</h2><div class=txt>{}</div></article><section><article class=b>Teaser.</article></section></main>", "One\n{}"),
    ],
)
def test_the_whole_article_stays(body, want):
    assert text(body.format(LONG)) == want.format(LONG.strip())
    path = next(n[2] for n in H.Page(PAGE.format(body.format(LONG))).nodes if n[2].endswith("div.txt"))
    assert text(body.format(LONG), path) == want.format(LONG.strip())


def test_whole_articles_of_a_host(spark):
    page = "<article><h1>Head {0}</h1><p class=lead>Lead {0}.</p><div class=txt><p>{1}</p></div><div class=conclusion>End {0}.</div></article>"
    df = spark.createDataFrame([(k, f"http://a.example/{k}", PAGE.format(page.format(k, LONG))) for k in range(5)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.main_texts(df).collect()} == {k: f"Head {k}\nLead {k}.\n{LONG.strip()}\nEnd {k}." for k in range(5)}


@pytest.mark.parametrize(
    "body, want",
    [
        ("<div id=content-sidebar-wrap><main><p>{}</p></main><div class=sidebar>Side.</div></div>", "{}"),
        ("<div class='layout right-sidebar'><div class=txt>{}</div><div class=related>Other.</div></div>", "{}"),
        ("<div class=elementor-widget-text-editor><p>{}</p></div>", "{}"),
        ("<div class='widget Blog'><div class=post>{}</div></div><div class='widget Profile'>About.</div>", "{}"),
        ("<div class='page social-enabled'><article>Short.</article></div><div class=comments><article class=comment>A reader.</article></div>", "Short."),
        ("<div class='widget a'>One half of it is here.</div><div class='widget a'>The other half is here.</div>", "One half of it is here.\nThe other half is here."),
        ("<article><p>Text <span class=share>share this</span>goes on.</p><div class=tags>tags</div></article>", "Text goes on."),
    ],
)
def test_class_words_do_not_drop_the_article(body, want):
    assert text(body.format(LONG)) == want.format(LONG.strip())


def test_a_part_does_not_replace_the_container_around_it():
    body = "<div class=wide>{}<div class=mid><p>Few.</p><div class=text>Boxed {}</div></div></div>"
    page = H.Page(PAGE.format(body.format("<p>Own words of the page.</p>" * 40, "words " * 50)))
    path = next(n[2] for n in page.nodes if n[2].endswith("div.text"))
    assert page.nodes[page.best()][2] == path.removesuffix("/div.mid/div.text")
    assert page.extract(path) == "\n".join(["Own words of the page."] * 40 + ["Few.", "Boxed " + ("words " * 50).strip()])
    both = H.Page(PAGE.format("<main>{}<div class=text>Boxed {}</div></main>".format("<p>Own words of the page.</p>" * 40, "words " * 50)))
    assert both.extract(next(n[2] for n in both.nodes if n[2].endswith("div.text"))).startswith("Own words")


def test_votes_add_up_over_all_containers(spark, monkeypatch):
    # 60 small parts of the story outweigh six larger boxes, whose classes differ, and half of all, which the body gets
    page = "".join(f"<div class='b{c}'>{'box ' * 20}</div>" for c in "uvwxyz") + "<div class=part>words of a part</div>" * 60
    df = spark.createDataFrame([(k, "http://a.example/x", PAGE.format(page)) for k in range(4)], "page_id long, url string, html string")
    for held in (H.HELD_VOTES if hasattr(H, "HELD_VOTES") else 1, 1):
        monkeypatch.setattr(H, "HELD_VOTES", held, raising=False)
        assert H.host_paths(df).first()["path"].endswith("/div.part")
    votes = H.Page(PAGE.format(page)).votes()
    assert sum(p.rsplit("/", 1)[-1].startswith("div.") for p in votes) == 7 and abs(sum(votes.values()) - 1_000_000) < 10
