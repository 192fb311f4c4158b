"""Pages for the tests: a seed shop, a bus timetable, a recipe, a broken page.

Written for these tests; each page holds the cases that its tests name.
"""

SHOP = """<!DOCTYPE html>
<html lang="en">
<head>
<title>Seeds &amp; Bulbs, A < B</title>
<meta name="description" content="Forty kinds of tulip">
<meta name="description" content="Later one wins">
<meta property="og:type" content="shop">
<meta name="" property="og:locale" content="en_GB">
<meta name="empty" content="">
<style>td { padding: 2px }</style>
</head>
<body>
<div id="top" class="bar wide"><a href="/cart" rel="nofollow">Cart</a><a href="tel:+441632960000">Call</a></div>
<table>
<tr><th>Kind<th>Price
<tr><td>Queen of Night<td>$1,299.00 a sack
<tr><td>Apeldoorn<td>€5
</table>
<p>3 < 4 and 5 > 2, <b>sale</b> ends 2031-05-17<br>or ring +44 (1632) 960-001
<p>Second <a href="https://Other.example:8443/Tulips/?x=/#frag" title="Elsewhere">shop <i>next</i> door</a>
<script>if (a < b) { document.write("<p>not text</p>") }</script>
</body></html>"""

TIMETABLE = """<html><head><title></title><base href="/lines/"></head><body>
<nav><ul><li><a href="1">One</a><ul><li><a href="1/stops">Stops</a></ul><li class="on now"><a href="2">Two</a></ul></nav>
<main><h2>Line 2</h2><ol><li>Harbour<li>Mill<li>Depot</ol>
<a href="javascript:print()">Print</a><a href="mailto:desk@bus.example">Desk</a><a>Nowhere</a><a href=""></a></main>
<form><label>Stop <input name="s"></label><input type="hidden"><input id="t" name="t"><select name="d"><option>Mon<option>Tue</select></form>
<noscript>Scripts are off</noscript>
</body></html>"""

RECIPE = """<article><h1>Soup</h1><h3>For six</h3>
<blockquote>Salt late.</blockquote>
<ul><li>2 leeks</li><li>1 l stock<ul><li>or water</li></ul></li></ul>
<pre>simmer
  20 min</pre><hr>
<img src="pot.png" alt="A pot"><img src="spoon.png">
<p><code>n*m</code> bowls, see <a href="/soups">/soups</a> and <em>taste</em>_often_</p></article>"""

BLANK = "<!-- nothing --><html><body> </body></html>"

DEEP = "<div>" * 100_000 + "bottom"

PAGES = [
    (0, "https://seeds.example/shop", SHOP),
    (1, "http://bus.example/", TIMETABLE),
    (2, "https://seeds.example/soup", RECIPE),
    (3, "https://seeds.example/blank", BLANK),
]
