from colligate.llm import extraction

PAGE = "<div class='menu'><p>a<p>b</div><form><main><ul><li>x<li>y</ul></main></form><p>d<button>e</button><aside hidden>f</aside><script><p></script>"


def test_reasons_are_looked_for_only_where_they_are_used(monkeypatch):
    whole = extraction.numbered(extraction.parse(PAGE))
    monkeypatch.setattr(extraction, "drop_reason", None)
    bare = extraction.numbered(extraction.parse(PAGE, reasons=False))
    assert [(x.tag, x.own_text(), x.shape) for x in bare] == [(x.tag, x.own_text(), x.shape) for x in whole]
    assert any(x.dropped for x in whole) and not any(x.dropped for x in bare)
    assert len(extraction.align(bare[0], whole[0])) == len(whole)


def test_equal_attributes_are_read_once(monkeypatch):
    extraction._reason_of.cache_clear()
    extraction.parse(PAGE * 50)
    assert extraction._reason_of.cache_info().misses == 1
    assert extraction.drop_reason("div", " class='" + "x " * 200 + "menu'") == extraction.NAMED
    assert extraction._reason_of.cache_info().currsize == 1
