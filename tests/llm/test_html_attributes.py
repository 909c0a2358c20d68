"""Elements are hidden by attributes, not by words within their values."""

import pytest

from proofline.llm import html_text

SHOWN = [
    'title="the hidden valley"', 'aria-label="Show hidden items"', 'class="a hidden b"', "alt='A hidden gem'", 'data-type="hidden-gems"', "type=hidden", 'title="style=display:none"',
    "data-x='style=\"display: none\"'", 'data-style="display:none"', 'style="--display: none"', 'style="display:none; display:block"', "data-hidden", "class=hidden", 'title="x = hidden / y"',
    'style="visibility: visible" title="visibility: hidden"', 'style="/* display:none; */ color:red"', "title='it is \"hidden\" here'", 'title = "hidden"',
]
HIDDEN = [
    "hidden", "HIDDEN", 'hidden=""', "hidden=until-found", 'id="a"hidden', "a='b' hidden", 'style="color:red;display:none"', "STYLE='Display : NONE !important'", "style=display:none",
    'style="visibility:hidden;"', 'style="display:none!important;display:block"', 'style="display&#58;none"', 'id=a hidden/',
]


@pytest.mark.parametrize("attributes", SHOWN)
def test_words_in_values_hide_nothing(attributes):
    assert html_text.render(f"<body {attributes}>seen<div {attributes}>too</div></body>") == "seen\ntoo"


@pytest.mark.parametrize("attributes", HIDDEN)
def test_hidden_by_attribute(attributes):
    assert html_text.render(f"a<div {attributes}>no</div>b") == "ab"


def test_hidden_inputs():
    assert html_text.render('<input type="hidden" value="no"><input value=yes type=text title="type=hidden"><INPUT TYPE=Hidden value=no>') == "yes"
    assert html_text.render('<img alt="A hidden gem"><img hidden alt=no><ol start="3" title="hidden"><li value=7>x</ol>') == "A hidden gem\n\n7. x"
