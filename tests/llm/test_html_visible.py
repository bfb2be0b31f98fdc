"""Visible text that stands in drawings, formulas and controls, or after a head that nothing closes."""

import pytest

from landspark.llm import html_text

CASES = {
    "<head><title>t</title>Hello <b>x</b><p>y": "Hello x\n\ny",
    "<html><head><meta charset=utf-8><title>t</title><span>only</span> inline": "only inline",
    "<head><title>t</title> \n <a href=x>k</a></head> z": "k z",
    "<head><script>a</script>&nbsp;b": "\xa0b",
    "<head><noscript><p>no</p></noscript><template><p>no</p></template><body>v": "v",
    "<head></br>v": "v",
    "a <svg viewBox='0 0 1 1'><title>no</title><desc>no</desc><defs><text>no</text></defs><path d=x /><text>one</text><text>two</text></svg>b": "a one two b",
    "<svg><title/><defs/><text>shown</text></svg>": "shown",
    "<svg><style>no</style><text><![CDATA[a < b]]></text><text display=none>no</text></svg>": "a < b",
    "<svg><defs><p>out</svg>": "out",
    "<svg/>after <svg><foreignObject><p>in</p></foreignObject></svg>": "after\n\nin",
    "<math><mi>x</mi><mo>=</mo><mn>2</mn></math> m": "x=2 m",
    "<math><semantics><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></semantics></math>": "1 2",
    "by <select><option>a<option selected>b<optgroup label=g><option label=c>no</select>now": "by a b g c now",
    "n <textarea>\nx &lt;b>\n  y</textarea>z": "n x <b>\n  y z",
    "<datalist><option>no</datalist><p>v": "v",
}


@pytest.mark.parametrize("page", CASES)
def test_shown(page):
    assert html_text.page_text(page) == CASES[page]
