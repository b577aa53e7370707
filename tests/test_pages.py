"""Page and model-reply features on literal pages."""

from pyspark.sql import functions as F

from bazaarflow.functions import pages
from bazaarflow.sources import places

L = F.lit


def ld(*blocks):
    return L("".join(f'<script type="application/ld+json">{b}</script>' for b in blocks))


def test_ld_object_list_and_offers(one):
    html = ld('{"@type":"Product","name":"A","offers":{"price":12,"priceCurrency":"EUR"},"address":{"addressLocality":"Rome","addressCountry":"IT"}}',
              '[{"@type":"Event","name":"B","offers":[{"price":"7","priceCurrency":"USD"}]},{"@type":"Product"},{"@type":"WebSite","name":"C"}]', "{broken")
    got = one(pages.ld_products(html, L("https://p.example")))
    assert [(p["title"], p["price_raw"], p["city"], p["url"]) for p in got] == [("A", "12 EUR", "Rome", "https://p.example"), ("B", "7", "", "https://p.example")]


def test_sitemap(one):
    xml = L('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://s.example/tours/old-town_walk/</loc></url>'
            "<url><loc>https://s.example/about</loc></url></urlset>")
    got = one(pages.sitemap_products(xml))
    assert [(p["url"], p["title"]) for p in got] == [("https://s.example/tours/old-town_walk/", "Old Town Walk")]
    assert one(pages.sitemap_products(L("<urlset><url><loc>https://s.example/x</loc></url></urlset>"))) == []


def test_reply_items(one):
    good = '{"products":[{"nom_produit":"Old town walk","prix_raw_text":"12"},{"nom_produit":"short"},{"nom_produit":"Error row here","error":true}]}'
    assert [i["nom_produit"] for i in one(pages.reply_items(L(f"<think>{{x}}</think>```json\n{good}\n```")))] == ["Old town walk"]
    assert [i["nom_produit"] for i in one(pages.reply_items(L('[{"nom_produit":"Old town walk"}]')))] == ["Old town walk"]
    assert one(pages.reply_items(L('{"products": [{'))) == []
    assert one(pages.reply_items(L("sorry"))) == []


def test_reply_place(one):
    got = one(pages.reply_place(L('Here: {"detected_city":"Null","detected_country":"Italy","confidence":"1.7"}')))
    assert (got["city"], got["country"], got["confidence"]) == (None, "Italy", 1.0)


def test_supplier_signals(one):
    got = one(pages.supplier_signals(L('<a href="/tours/1">Book Now</a> via BOKUN and swagger, from $ 5, Rome'), ["rome"]))
    assert (got["channel"], got["has_api"], got["score"]) == ("Bokun", True, 100)
    assert one(pages.supplier_signals(L("plain")))["score"] == 0


def test_urls(one):
    assert one(pages.is_product_url(L("https://x.example/tours/a"))) is True
    assert one(pages.is_product_url(L("https://x.example/tours/a.jpg?w=1"))) is False
    assert one(pages.page_type(L("https://x.example/blog/tours/"))) == "BLOG"
    assert one(pages.is_product_page(L("https://x.example/p"), L('<b class="book-now">Booking</b>'))) is True
    assert one(pages.country_of_path(L("https://x.example/en/italy/tours"))) == "Italy"


def test_links(one):
    html = L('<a href="/a">1</a><a href="https://x.example/b">2</a><a href="https://other.example/c">3</a><a href="#top">4</a><a href="/a">5</a>')
    assert one(pages.same_site_links(html, L("https://x.example/page"))) == ["https://x.example/a", "https://x.example/b"]


def test_operators(one):
    html = L('<span class="x-supplier">Acme Tours</span> Supplied by Blue Sea Travel, Reviews <i class="provider">Viator</i>')
    assert one(pages.operator_names(html)) == ["Acme Tours", "Blue Sea Travel"]


def test_headings_and_lines(one):
    html = L("<nav><h2>Private tour in nav</h2></nav><h2>Private boat tour</h2><p>Price <b>From €20</b></p><h3>About our company</h3><h2>Private boat tour</h2>")
    assert [(p["title"], p["price_raw"]) for p in one(pages.heading_products(html))] == [("Private boat tour", "From €20")]
    assert one(pages.line_products(L("Private tour of Rome\nhttp://private tour x\nhi\nPrivate tour of Rome\n"))) == ["Private tour of Rome"]


def test_places(spark):
    rows = [(1, '{"name":"Sunny","website":"https://www.Sunny.example/x","type":"Tour operator","rating":4.5,"phones":["1"]}'),
            (2, '{"name":"No site","website":""}'), (3, '{"name":"S","website":"https://facebook.com/s"}'), (4, '{"name":"App","website":"app.example","type":"Software company"}'), (5, "broken")]
    got = places.usable_places(spark.createDataFrame(rows, "id int, j string"), "j", "maps").collect()
    assert [(r["id"], r["domain"], r["phone"], r["rating"]) for r in got] == [(1, "sunny.example", "1", 4.5)]


def test_city_names(spark):
    j = '[{"address":{"city":"Rome"}},{"address":{"town":"ROME"}},{"name":"City in x"},{"name":"Y"},{"name":"Oslo"}]'
    got = places.city_names(spark.createDataFrame([(j,)], "j string"), "j")
    assert sorted(r["city"] for r in got.collect()) == ["Oslo", "ROME"]
