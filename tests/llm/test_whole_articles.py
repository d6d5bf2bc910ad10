"""Articles whose parts do not all stand beside each other in one element."""

from tracklake.llm import extraction

MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(8)) + "</ul>"
BODY = "".join(f"<p>Paragraph {i} of the body, with words, and more of them to read.</p>" for i in range(6))
TEXT = "\n".join(f"Paragraph {i} of the body, with words, and more of them to read." for i in range(6))
INTRO = "An intro that stands above, with some words, and ends here."


def test_title_and_intro_outside_the_body():
    for tag in ("main", "div id='content'"):
        page = f"<body><nav>{MENU}</nav><{tag}><h1>T</h1><p>{INTRO}</p><div class='body'>{BODY}</div></{tag.split()[0]}><div>{MENU}</div></body>"
        assert extraction.extract(page) == f"T\n{INTRO}\n{TEXT}"
    page = f"<body><div class='menu'>{MENU}</div><div id='content'><div><h1>T</h1></div><div class='body'>{BODY}</div></div></body>"
    assert extraction.extract(page) == f"T\n{TEXT}"


def test_sections_of_unlike_length():
    first, second = BODY + BODY[: len(BODY) // 6], "<p>Another part, with words, and more of them to read, too.</p>" * 3
    page = f"<body><div class='menu'>{MENU}</div><div id='content'><section>{first}</section><section>{second}</section></div><div><a href='/'>Home</a></div></body>"
    got = extraction.extract(page)
    assert got.startswith(TEXT) and got.endswith("\n".join(["Another part, with words, and more of them to read, too."] * 3))
    assert "Item" not in got and "Home" not in got
