import numpy as np

from lodestar.llm.pagelines import BODY, FURNITURE, PRIOR_LINE, PRIOR_SIDE, SAYS, Lines, Pages, content_measures, host_of, main_text, phrases_of, slug_words, split_lines

SCHEMA = "crawl_id bigint, id string, url string, title string, text string, links array<string>, host string, stats int"
MENU = "Home\nShop\nHelp centre\nNews"
FOOT = "Powered by vex engine\n© 2020 Dale Trust. All rights reserved."


def page(i, body, host="a.test", title=None, head=MENU, url=None):
    return (i, f"id{i}", url or f"https://{host}/p-{i}", title, "\n".join(x for x in (head, body, FOOT) if x), ["/x"], "clash", 1)


def rows():
    body = lambda i: "The mill of W{0}dale was built of {0}oak and tin.\nNotes on the {0} pier\n- A guide to {0}by\nzinc{0}\t41\tcrates".format("abcdefghijkl"[i] * 4)
    out = [page(i, body(i)) for i in range(12)]
    out.append(page(20, "Recent posts\nThe old pier of Brae\nBarge records of Brae\nMill of Brae\nThe town lies by the sea and has a port.", title="Mill of Brae"))
    words = ["cheap", "best", "buy", "free", "top", "sale"]
    rnd = np.random.default_rng(1)
    out += [page(30 + k, ", ".join(f"{rnd.choice(words)} {rnd.choice(words)} zork" for _ in range(60)), host=f"s{k}.test", head=None) for k in range(4)]
    out += [page(40, None), (41, None, None, None, None, None, "clash", 1), (42, "i42", "https://a.test/q", None, "", [], "clash", 1), (43, "i43", None, None, " \n\r\n", None, "clash", 1)]
    return out


def test_body_and_spam(spark):
    p = spark.createDataFrame(rows(), SCHEMA)
    pages = Pages(p)
    assert {r.crawl_id for r in pages.spam().collect()} == {30, 31, 32, 33}
    got = {}
    for r in pages.furniture().collect():
        got.setdefault(r.crawl_id, set()).add(r.line_no)
    for i in range(12):
        assert got[i] == {0, 1, 2, 3, 8, 9}
    assert got[20] == {0, 1, 2, 3, 4, 5, 6, 9, 10}
    assert got[40] == {0, 1, 2, 3, 4, 5}
    assert not got.keys() & {30, 41, 42, 43}
    body = {r.crawl_id: r.body for r in main_text(p, pages).collect()}
    assert body[40] == "" and body[41] is None and body[20] == "Mill of Brae\nThe town lies by the sea and has a port."
    assert Pages(p.limit(0)).furniture().count() == 0


def classes(lines, links=None, prior=(PRIOR_LINE, PRIOR_SIDE), **says):
    _, rows = Lines(prior).page("https://a.test/x", None, links, "\n".join(lines))
    told = {k: np.array(says.get(k, [float(k == "pages")] * len(rows)), dtype=float) for k in SAYS}
    return split_lines(rows[:, 4], rows[:, 5], told, 30).tolist()


def test_sentences_with_template_words_stay():
    assert classes(["Contact with the abbey ended in 1849.", "The biscuit tin of Brae held cookies for the crew."]) == [BODY, BODY]
    assert classes(["We use cookies so that pages load faster.", "OK, got it"]) == [FURNITURE, FURNITURE]


def test_measures_and_names():
    _, m, fresh = content_measures(["The mill stood by the old weir.", "best deal here http://x.test"])
    assert m[:, 1].tolist() == [7, 0] and m[:, 0].tolist() == [7, 6] and m[:, 3].tolist() == [0, 6] and fresh > 0.9
    assert host_of("HTTPS://WWW.A.test/x") == "www.a.test" and host_of(None) == "" and host_of("/rel") == ""
    assert "the old mill" in slug_words("https://a.test/the-old-mill.html?n=3", "a.test", "a.test")


def test_section_menu_of_a_few_pages_is_template_and_copies_are_not(spark):
    words = ["oak", "tin", "clay", "slate", "wool", "salt", "flax", "reed", "moss", "peat"]
    said = lambda i: f"The {words[i % 10]} mill of {words[i // 10]} town was built beside the weir.\nIts {words[i % 10]} wheel was sold to {words[i // 10]} farmers in the north."
    menu = "Tide tables\nHarbour fees\nMooring plans"
    rows = [page(i, (menu + "\n" if i < 6 else "") + said(i) + f"\nNotes on the {words[i % 10]} pier\n" + said(i).upper()[:40] + " stood here.") for i in range(60)]
    rows += [page(100 + i, "The abbey of Brae was closed by the crown.\nFirst stone\nSecond stone\nIts bells were sold to a town in the north.") for i in range(6)]
    got = {}
    for r in Pages(spark.createDataFrame(rows, SCHEMA)).furniture().collect():
        got.setdefault(r.crawl_id, set()).add(r.line_no)
    assert all(got[i] == {0, 1, 2, 3, 4, 5, 6, 11, 12} for i in range(6))
    assert all(got[i] == {0, 1, 2, 3, 8, 9} for i in [*range(6, 60), *range(100, 106)])


def test_links_menus_and_long_sidebars():
    menu = [f"Label {w}" for w in "abcdefghijklmnopqrstuvwxyz"]
    links = [f"https://a.test/label-{w}" for w in "abcdefghijklmnopqrstuvwxyz"]
    prose = "The mill of Brae was sold to a farmer in the north."
    assert classes([" | ".join(menu), *menu, prose], links, None) == [FURNITURE] * 27 + [BODY]
    assert classes([*menu, prose], None, None) == [BODY] * 27
    titles = [f"The old pier of {c}town" for c in "ABCDEFGHIJKLMNOP"]
    got = classes(["More stories", *titles, prose], None, None, template=[1] + [0] * 17, heads=[16] + [0] * 17)
    assert got == [FURNITURE] * 17 + [BODY]


def test_unknown_languages_are_learnt_from_the_crawl(spark):
    words = ["ulu", "ket", "mor", "pil", "sat", "ven", "dru", "gol", "hib", "jax", "kos", "lum"]
    rows = []
    for h in range(5):
        for i in range(12):
            side = "\n".join(f"{a.title()} {words[(i + k) % 12]} {words[h]}{i}" for k, a in enumerate(words[:3]))
            text = f"Vabirem kosta gurem malk\nTha {words[i]} ket {words[h]} mor lin sat a {words[h]}{words[i]} vel.\nOre {words[i]}{words[h]} sat mor dru bel kin um {words[i]}.\nZug thama\n{side}\nUm fel {words[h]}"
            rows.append((100 * h + i, f"{h}-{i}", f"https://h{h}.test/{i}", None, text, None, "", 1))
    rows.append((900, "x", "https://lone.test/1", None, "Vabirem kosta gurem malk\nTha abbo ket mor lin sat a brizo vel.\nZug thama\nUlu ket brim\nKet mor brum\nUm fel brok", None, "", 1))
    got = {}
    for r in Pages(spark.createDataFrame(rows, SCHEMA), prior=None).furniture().collect():
        got.setdefault(r.crawl_id, set()).add(r.line_no)
    assert all(got[100 * h + i] == {0, 3, 4, 5, 6, 7} for h in range(5) for i in range(12))
    assert got[900] == {0, 2, 3, 4, 5}


def soup(rnd, n, stops):
    words = ["cheap", "best", "buy", "free", "top", "sale", "offer", "deal", "bonus", "new", "fast", "price"]
    out = [str(rnd.choice(words)) for _ in range(n)]
    return ". ".join(" ".join(out[i : i + 14]).capitalize() for i in range(0, n, 14)) + "." if stops else " ".join(out)


def test_keyword_soup_with_full_stops_and_short_spam(spark):
    rnd = np.random.default_rng(2)
    said = "The mill of {0} was built of oak and stood beside the weir until the flood of {1}. Its wheel was later sold to a farmer who lived in the north."
    rows = [page(i, said.format("abcdefghij"[i % 10] * 3, 1700 + i), host=f"p{i}.test", head=None) for i in range(20)]
    rows += [page(50 + i, soup(rnd, 140, True), host=f"s{i}.test", head=None) for i in range(6)]
    rows += [page(70, soup(rnd, 12, True), host="short.test", head=None), page(71, soup(rnd, 12, False), host="short2.test", head=None)]
    rows += [page(80, said.format("brae", 1800) + "\n" + soup(rnd, 12, True), host="both.test", head=None)]
    pages = Pages(spark.createDataFrame(rows, SCHEMA))
    assert {r.crawl_id for r in pages.spam().collect()} == {50, 51, 52, 53, 54, 55, 70, 71}
    # the phrases of other hosts decide: without them the short pages are not found
    assert not {r.crawl_id for r in pages.spam(hosts=1000).collect()} & {70, 71}


def test_phrases_do_not_cross_lines():
    h = np.arange(1, 7, dtype=np.uint64)
    got, stops = phrases_of(h, np.array([3, 0, 1, 2]))
    assert stops.tolist() == [5, 5, 6, 9] and got[[0, 2, 4, 5, 6, 8]].tolist() == [1, 2, 3, 4, 5, 6]
    again, _ = phrases_of(np.array([5, 6], dtype=np.uint64), np.array([2]))
    assert again[1] == got[7] and len(set(got.tolist())) == 9
    assert len(phrases_of(np.zeros(0, dtype=np.uint64), np.array([0, 0]))[0]) == 0


def test_a_list_of_links_needs_its_links(spark):
    names = iter("ash birch cedar elm fir gorse holly ivy juniper kelp larch maple nettle oak pine quince rowan sedge thyme umber vetch willow yarrow zinnia aster basil chervil dill endive fennel garlic hyssop iris jasmine lemon mint".split())
    titles = "\n".join(f"{a.title()} {b}" for a, b in zip(names, names))
    links = [f"https://x.test/{k}" for k in range(19)]
    rows = [(1, "a", "https://l1.test/q", None, titles, links, "", 1), (2, "b", "https://l2.test/q", None, titles.upper(), links[:3] * 5, "", 1), (3, "c", "https://l3.test/q", None, titles.lower(), None, "", 1)]
    assert {r.crawl_id for r in Pages(spark.createDataFrame(rows, SCHEMA)).spam().collect()} == {1}
