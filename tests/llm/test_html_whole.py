from corpusmill.llm.html_extract import main_text

LONG = "A paragraph, of some length, with commas, and with words enough to count as prose of the page, as it is."
NAV = "<nav><a href=/>Home</a></nav><div><ul><li><a href=/x>More</a><li><a href=/y>Other</a></ul></div>"


def test_headline_and_second_article():
    page = f"<body>{NAV}<main><h1>Head</h1><article><p>{LONG} One.</p></article><article><p>{LONG} Two.</p></article></main><footer>f</footer></body>"
    assert main_text(page) == f"Head\n{LONG} One.\n{LONG} Two."
    wrapped = f"<body>{NAV}<main><section><article><p>{LONG} One.</p></article></section><section><article><p>{LONG} Two.</p></article></section></main></body>"
    assert main_text(wrapped) == f"{LONG} One.\n{LONG} Two."


def test_articles_without_main_and_teasers():
    page = f"<body>{NAV}<article><p>{LONG} One.</p></article><article><p>{LONG} Two.</p></article><article><a href=/t>{LONG}</a></article></body>"
    assert main_text(page) == f"{LONG} One.\n{LONG} Two."


def test_bibliographies_stay_and_menus_go():
    refs = "<ol><li><a href=/1>Source one, of 1990</a></li><li><a href=/2>Source two, of 1991</a></li></ol>"
    menu = "<ul><li><a href=/m>Part one of it</a></li><li><a href=/n>Part two of it</a></li></ul>"
    for tag in ("article", "main"):
        page = f"<body>{NAV}<{tag}>{menu}<h1>Head</h1><p>{LONG}</p><h2>Sources</h2>{refs}<ul class=menu><li><a href=/z>Next one</a></li></ul></{tag}></body>"
        assert main_text(page) == f"Head\n{LONG}\nSources\nSource one, of 1990\nSource two, of 1991"
