"""What recurs on a host's pages and is content stays, what is a template goes."""

import re
from collections import defaultdict
from html import unescape

from tidebar.llm import html


def extracted(spark, pages):
    df = spark.createDataFrame([(i, "http://host.com/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r for r in html.extract(df).collect()}


def test_negations_headings_links_and_values_stay(spark):
    menu = "<div><a href='/a'>Home</a> <a href='/b'>Shop</a> <a href='/c'>Help</a></div>"
    cities = ["Paris", "Rome"]
    body = lambda i: f"<h2>Summary</h2><p>You should <em>not</em> press button {i} in <a href='/p'>{cities[i % 2]}</a>.</p><div class='stock'>{'In stock' if i % 4 else 'Sold out'}</div><ul><li>Blue</li><li>No {i}</li></ul>"
    got = extracted(spark, [f"<body>{menu}<div><h1>Item {i}</h1>{body(i)}</div></body>" for i in range(60)])
    for i, r in got.items():
        assert r.text == f"Item {i} Summary You should not press button {i} in {cities[i % 2]}. {'In stock' if i % 4 else 'Sold out'} Blue No {i}"
        assert r.n_template_chars == len("HomeShopHelp")


def test_tables_and_their_cells_stay(spark):
    table = "<table><tr><td>Weight</td><td>2 kg</td></tr><tr><td>Colour</td><td>red</td></tr><tr><td>Safe</td><td><b>no</b></td></tr></table>"
    for wrap in ("{}", "<div class='specs'>{}</div>", "<section><div>{}</div></section>"):
        got = extracted(spark, [f"<body><div class='top'>Our shop</div><h1>Item {i}</h1>{wrap.format(table)}<p>It is <b>not</b> safe {i}.</p><div>Imprint <p>and terms</p></div></body>" for i in range(60)])
        for i, r in got.items():
            assert r.text == f"Item {i} Weight 2 kg Colour red Safe no It is not safe {i}."


def test_menus_of_sections_go_at_any_share(spark):
    """A side menu that only some of the pages with the same place have."""
    side = lambda i: "<div>" + " ".join(f"<a href='/{i % 10}/{k}'>Part {k} of {i % 10}</a>" for k in range(4)) + "</div>"
    got = extracted(spark, [f"<body><div><p>Text {i}</p></div>{side(i)}</body>" for i in range(100)])
    assert all(r.text == f"Text {i}" for i, r in got.items())


def test_templates_as_brute_force(spark):
    """Generated pages of flat regions: what goes is what the rule says, by counting strings."""
    import random

    rng, pages = random.Random(3), []
    for i in range(80):
        parts = ["<div>always here</div>"] if i % 20 else []
        parts += [f"<p class='k{k}'>{rng.choice(['one', 'two', 'three', f'own {i}'])} {k}</p>" for k in range(4)]
        parts += [f"<section>{'fixed' if rng.random() < 0.95 else f'varies {i}'}</section>", f"<h3>{rng.choice(['A', 'B'])}</h3>", f"<p>words of page {i}</p>"]
        pages.append(parts)
    seen, places = defaultdict(set), defaultdict(set)
    for i, parts in enumerate(pages):
        for x in parts:
            seen[x].add(i)
            places[re.match("<[^>]*>", x)[0]].add(i)
    gone = {x for x, on in seen.items() if not x.startswith("<h3") and len(on) >= html.MIN_PAGES and len(on) >= html.SHARE * len(places[re.match("<[^>]*>", x)[0]])}
    assert {"<div>always here</div>", "<section>fixed</section>"} <= gone
    got = extracted(spark, ["<body>" + "".join(p) + "</body>" for p in pages])
    for i, parts in enumerate(pages):
        assert got[i].text == " ".join(unescape(re.sub("<[^>]*>", "", x)) for x in parts if x not in gone)
