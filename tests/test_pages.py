from veilspark.operators.actions import validate_actions
from veilspark.operators.extract import element_keys, element_states, element_rows, extract_pages, visual_candidates
from veilspark.operators.sanitize import sanitize_scans
from veilspark.sources.html import parse_page

FORM = """<!doctype html><html><head><title>A &amp; B</title></head><body><form id="f">
<label for="n">Full
 Name</label><input id="n" name="fullName" value="Jane Doe">
<label>Mail <input type="email" name="e" value="a@b.com"></label>
<input type="password" placeholder="Pw" value="x"><input name="cc-number" value="4">
<select name="s"><option value="1">One</option><option value="2" selected>Two</select>
<textarea aria-label="Addr">12 Park</textarea><input type=submit value="Go">
<div style="display: none"><p>hidden text</p></div><p>x</p><p>One<br>two<p>three</p><dt></dt>
<canvas id=c></canvas><img src="a.png" alt="Company Logo"><img src="data:image/png;x" alt="passport scan"><img>
<button>Next</button><div role="button">Role</div><span aria-hidden=true><a href="/q">q</a></span>
</form></body></html>"""


def scan(spark, html):
    return spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")


def test_form_page(spark):
    rows = element_rows(extract_pages(scan(spark, FORM)), ["page_id"]).orderBy("ord").collect()
    assert [r.id for r in rows] == [f"el_{i:03d}" for i in range(1, len(rows) + 1)]
    assert [(r.tag, r.type, r.label, r.text, r.category, r.value) for r in rows] == [
        ("input", "text", "Full Name", None, None, "Jane Doe"),
        ("input", "email", "Mail", None, None, "a@b.com"),
        ("input", "password", "Pw", None, "password", None),
        ("input", "text", "", None, "payment", None),
        ("select", "select", "One Two", None, None, "2"),
        ("textarea", "textarea", "Addr", None, None, "12 Park"),
        ("input", "submit", None, "Go", None, None),
        ("button", "button", None, "Next", None, None),
        ("div", "button", None, "Role", None, None),
        ("p", "text block", None, "One two", None, None),
        ("p", "text block", None, "three", None, None),
        ("dt", "dt", None, "", None, None),  # an empty dt is kept, an empty p is not
        ("canvas", "canvas", None, "", None, None),
        ("img", "image", None, "", None, None),
        ("img", "image", None, "", None, None),
        ("img", "image", None, "", None, None),
    ]
    assert [r.visionTriggered for r in rows[-4:]] == [True, False, True, True]


def test_selectors_and_pixels(spark):
    keys = {r.id: r.selector for r in element_keys(scan(spark, FORM), "page_id").collect()}
    assert keys["el_001"] == "#n" and keys["el_002"] == 'input[name="e"]'
    assert keys["el_003"] == 'input[placeholder="Pw"]' and keys["el_007"] == "#f > input:nth-of-type(4)"
    pixels = {r.element_id: r.visualDataUrl for r in visual_candidates(scan(spark, FORM), "page_id").collect()}
    assert pixels == {"el_013": None, "el_015": "data:image/png;x", "el_016": None}


def test_cap_and_wide_ids(spark):
    html = "<body>" + "".join(f"<p>row {i}</p>" for i in range(250)) + "<button>b</button></body>"
    page = scan(spark, html)
    rows = element_rows(extract_pages(page, max_elements=200), ["page_id"]).orderBy("ord").collect()
    assert len(rows) == 200 and rows[0].tag == "button" and rows[-1].text == "row 198"
    assert extract_pages(page, max_elements=200).first().leftOut == 51
    assert extract_pages(page).first().totalElements == 251


def test_no_text_is_cut_unasked(spark):
    far = "x " * 2500 + "write to far.away@example.com"
    page = scan(spark, f"<body><p>{far}</p></body>")
    assert "@" not in str(sanitize_scans(extract_pages(page)).first().elements)
    assert len(extract_pages(page, max_text=140).first().elements[0].text) == 140


def test_broken_markup():
    title, nodes = parse_page("<title>t<p>x</title><p>a<p>b<!-- <p> --><script>'<p>'</script></b><li>c<li>d")
    assert title == "t<p>x"
    assert [n["tag"] for n in nodes if n["tag"] in ("p", "li")] == ["p", "p", "li", "li"]
    assert [n["text"] for n in nodes if n["tag"] == "li"] == ["c", "d"]
    assert parse_page(None) == ("", []) and parse_page("plain") == ("", [])


def test_states_from_markup(spark):
    html = """<body><button>Go</button><input type=text placeholder=a><input type=checkbox aria-label=b><select aria-label=c>
<option>1</select><fieldset disabled><input aria-label=d></fieldset><button disabled>Off</button><div role=button aria-disabled=true>x</div>
<button hidden>no</button><p>words</p></body>"""
    page = scan(spark, html)
    states = {r.id: (r.tag, r.role, r.input_type, r.disabled) for r in element_states(page, "page_id").collect()}
    assert list(states.values()) == [
        ("button", None, None, False), ("input", None, "text", False), ("input", None, "checkbox", False),
        ("select", None, None, False), ("input", None, "text", True), ("button", None, None, True),
        ("div", "button", None, True), ("p", None, None, False),
    ]
    cases = [
        ("CLICK", "el_001", None, True), ("TYPE", "el_002", "x", True), ("CHECK", "el_003", None, True),
        ("SELECT", "el_004", "1", True), ("TYPE", "el_005", "x", False), ("CLICK", "el_006", None, False),
        ("CLICK", "el_007", None, False), ("CLICK", "el_008", None, False), ("CLICK", "el_009", None, False),
        ("TYPE", "el_001", "x", False), ("SELECT", "el_002", "x", False), ("CHECK", "el_002", None, False),
    ]
    actions = spark.createDataFrame([(1, *c, None) for c in cases], "page_id int, action string, target string, value string, want boolean, current_url string")
    got = validate_actions(actions, element_states(page, "page_id"), scan="page_id")
    assert got.where("valid <> want").count() == 0 and got.count() == len(cases)


def test_a_response_that_is_no_object(spark):
    actions = spark.createDataFrame([(1, "DONE", None, None, None, False)], "scan_id int, action string, target string, value string, current_url string, is_object boolean")
    states = spark.createDataFrame([], "scan_id int, id string, tag string, role string, input_type string, disabled boolean, visible boolean")
    row = validate_actions(actions, states).first()
    assert not row.valid and "not an object" in row.reason


def hidden(css, body):
    """Ids of the nodes that do not show."""
    return {n["attrs"]["id"] for n in parse_page(f"<style>{css}</style>{body}")[1] if n["hidden"] and "id" in n["attrs"]}


def test_cascade_by_hand():
    body = "<div id=a class='x y'><p id=b>1</p><p id=c class=v>2</p></div><div id=d><span id=e data-k=ab-c>3</span></div>"
    for css, want in {
        ".x { display: none }": {"a", "b", "c"},  # a subtree goes with its root
        "#a { visibility: hidden } .v { visibility: visible }": {"a", "b"},  # inherited, and taken back below
        "#d { opacity: 0.0 }": {"d", "e"},
        "#d { opacity: .5 }": set(),
        "div > p { display: none } p { display: block }": {"b", "c"},  # specificity before order
        "p { display: none } p { display: block }": set(),  # then order
        "p { display: none !important } #b { display: block }": {"b", "c"},  # importance before both
        "div p.v, #nope { display: none }": {"c"},
        "div:not(.x) span { display: none }": {"e"},
        "[data-k|=ab] { display: none }": {"e"}, "[data-k^='ab-'] { display: none }": {"e"}, "[data-k$=b] { display: none }": set(),
        ".x.y > .v { display: none }": {"c"}, ".y > div > .v { display: none }": set(),
        "p:hover { display: none } p + p { display: none } p::before { display: none }": set(),
        "@media print { p { display: none } } @media screen { #e { display: none } }": {"e"},
        "/* p { display: none } */ #b { color: red; display : NONE }": {"b"},
        "p { display: none": {"b", "c"},  # an open rule ends with the sheet
        "} p { display: none } {": set(),
    }.items():
        assert hidden(css, body) == want, css


def test_inline_and_markup_in_the_cascade():
    assert hidden("p { display: block !important }", "<p id=a style='display:none'>x") == set()
    assert hidden("p { display: block }", "<p id=a style='display: none'>x<p id=b hidden>y") == {"a"}
    assert hidden("", "<p id=a hidden>x<p id=b aria-hidden=true><i id=c>y</i></p><input id=d type=HIDDEN>") == {"a", "b", "c", "d"}
    assert hidden("#late { display: none }", "<p id=late>x<style>#more { display: none }</style><p id=more>y") == {"late", "more"}


def test_class_hides_a_field(spark):
    html = "<style>.gone { display: none }</style><form><input name=a><div class=gone><input name=b><p>secret</p></div><p>shown</p></form>"
    rows = element_rows(extract_pages(scan(spark, html)), ["page_id"]).orderBy("ord").collect()
    assert [(r.tag, r.name, r.text) for r in rows] == [("input", "a", None), ("p", None, "shown")]


def test_states_of_a_later_snapshot(spark):
    first = "<body><button>Go</button><a href=/x>x</a><p>two words</p><fieldset><input placeholder=q></fieldset></body>"
    then = "<style>a { display: none }</style><body><button disabled>Go</button><a href=/x>x</a><fieldset disabled><input placeholder=q></fieldset></body>"
    df = spark.createDataFrame([(1, first, then)], "page_id int, html string, later string")
    states = {r.id: (r.tag, r.disabled, r.visible) for r in element_states(df, "page_id", later="later").collect()}
    assert states == {"el_001": ("button", True, True), "el_002": ("a", False, False), "el_003": ("input", True, True)}  # the paragraph is gone


def test_deep_nesting_is_linear():
    import time

    for html in ("<div>" * 100_000, "<p><button>" + "<div>" * 100_000, "</x>" * 100_000,
                 "<style>.a .b div { display: none } .a > div { opacity: 1 }</style><div class=a>" + "<div>" * 100_000):
        start = time.process_time()
        _, nodes = parse_page(html)
        assert time.process_time() - start < 8  # seconds; far more if a tag costs its depth
    assert nodes[-1]["depth"] == 100_000 and nodes[1]["last"] == len(nodes) - 1


def test_intervals_hold_what_is_below():
    _, nodes = parse_page("<ul><li><b>x</b><li>y</ul><label>m <input id=i></label><label for=j>n</label><input id=j>")
    above = {n["ord"]: n["parent"] for n in nodes}
    for n in nodes:
        line, at = set(), n["parent"]
        while at >= 0:
            line.add(at)
            at = above[at]
        assert line == {m["ord"] for m in nodes if m["ord"] < n["ord"] <= m["last"]} and len(line) == n["depth"]
    by = {n["attrs"].get("id"): n for n in nodes}
    assert nodes[by["i"]["label_in"]]["tag"] == "label" and by["j"]["label_in"] == -1 and nodes[by["j"]["label_for"]]["text"] == "n"
