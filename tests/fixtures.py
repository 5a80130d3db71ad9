"""Invented pages: a shed that lends tools (a paged list) and a guide to footpaths (a grid of cards)."""

SHED = "https://shed.example.org"
GUIDE = "https://paths.example.org"


def shed_page(tools, onward=""):
    """``tools``: (label, keeper, uses) in the order of the page."""
    rows = []
    for label, keeper, uses in tools:
        words = " or ".join(f'<a class=use href="/use/{u}">{u}</a>' for u in uses)
        rows.append(f'<tr class="tool"><td><b class="label">{label}</b><td>asked of <em class="keeper">{keeper}</em><td class=uses>{words}</tr>')
    turn = f'<p class="turn"><a class="on" href="{onward}">more of the shed</a></p>' if onward else ""
    return f"<!doctype html><title>Shed list</title><h2>What we lend</h2><table>{''.join(rows)}</table>{turn}"


SHED_1 = shed_page(
    [("Plane", "Ida", ["oak"]), ("Level", "Omar", []), ("Fret saw", "Ida", ["ply", "veneer", "horn"]), ("Rasp", "Noor", ["horn"])],
    "/shed/two",
)
SHED_2 = shed_page([("Auger", "Omar", ["oak", "ash"]), ("Adze", "Lev", []), ("Spokeshave", "Noor", ["ash"])])
SHED_URLS = [f"{SHED}/shed", f"{SHED}/shed/two"]

SHED_SPEC = """
name: shed
baseUrl: https://shed.example.org
resources:
  - name: tools
    fetch:
      path: /shed
      pagination: {type: link, selector: .turn a.on, maxPages: 4}
    list:
      selector: tr.tool
      fields:
        label: b.label
        keeper: em.keeper
        uses: {selector: a.use, many: true}
  - name: sheet
    fetch: {path: /shed}
    item:
      fields: {heading: h2}
"""

PATHS = [("Heron Ridge", "12.5", "Two"), ("Mill Loop", "3.25", "Four"), ("Salt Marsh", "7", "Three"), ("Quarry", "1,040.5", "One")]


def guide_page(before=""):
    cards = []
    for n, (name, toll, stars) in enumerate(PATHS, 1):
        cards.append(
            f'<section class="card walk"><img src="pics/w{n}.webp" alt=""><h4><a href="walk/{n}">{name}</a></h4>'
            f'<i class="star-rating {stars}"></i><span class="toll-price">{toll} kr</span></section>'
        )
    return f'<!doctype html><title>Footpaths</title>{before}<div id="cards">{"".join(cards)}</div><a rel="next" href="?from=4">on</a>'


GUIDE_1 = guide_page()
# a menu with more entries than the grid has cards
GUIDE_MENU = guide_page("<dl>" + "".join(f'<dd class="area"><a href="area/{n}">Area {n}</a></dd>' for n in range(1, 15)) + "</dl>")

GUIDE_SPEC = """
name: paths
baseUrl: https://paths.example.org
resources:
  - name: walks
    postProcess: by-toll
    fetch: {path: /}
    list:
      selector: section.walk
      fields:
        name: h4 a
        link: {selector: h4 a, attr: href, transform: url}
        toll: {selector: .toll-price, transform: [float]}
        stars: {selector: i, attr: class, transform: stars}
"""
