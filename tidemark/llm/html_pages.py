"""Pages labelled by hand, from which the page CRF learns: elements with data-main are main text.

LAYOUTS hold the markup of a page; {h} is a title, {s} a heading, {p} a paragraph, {i} a list item, all of them main text; {c} is a reader's comment,
{t} a headline of another page. Each layout is filled twice, with different texts; layouts with paragraphs are filled three times more, with <div> and <section> in place of <p>.
"""

from itertools import cycle, islice

TITLES = ["The bridge opens again", "How bees find home", "A winter soup", "Der lange Weg nach Hause", "Le marché du dimanche", "Una casa junto al mar", "Ten years of the small press", "What the tide leaves behind"]
HEADINGS = ["Before the storm", "Method", "Was danach geschah", "Les chiffres", "In short", "La noche"]
PARAGRAPHS = [
    "After two years of repairs, the old bridge over the river was opened on Monday, and hundreds of people came to walk across it.",
    "The mayor gave a short speech.",
    "Bees remember the sky; they use the sun as a compass, correct for its movement, and follow smells over the last few metres. Nobody knows how they learn it.",
    "Cut the onions, and let them fry slowly in butter until they are golden.",
    "Am Morgen gingen wir los, und am Abend waren wir noch lange nicht da, denn der Schnee lag tief und der Weg war nicht zu sehen.",
    "Il pleuvait depuis trois jours, et pourtant les gens étaient venus, comme chaque dimanche, avec leurs paniers et leurs chiens.",
    "La casa estaba vacía, pero las ventanas seguían abiertas, como si alguien fuera a volver.",
    "They printed four hundred copies of the first book; most of them were given away. The second one sold out within a week, to everyone's surprise, and paid for the press.",
    "Not so.",
    "The town has two squares, and both are older than its church.",
    "Nobody had asked her before, and so she had never told it.",
    "We walked along the beach at low water and found glass, rope, a shoe, and a letter that could no longer be read",
]
ITEMS = ["two onions", "one litre of stock", "The first chapter, which is about water", "salt", "a compass, a map and warm gloves", "Drittens: Geduld."]
COMMENTS = [
    "Great article, thanks for this. I have seen it in my own garden, and it is true.",
    "I do not agree at all. My father worked on that bridge for thirty years, and he always said that it would fall down, whatever they do to it.",
    "Danke, sehr schön geschrieben!",
    "First",
    "Does anybody know where I can buy this? I looked everywhere, but the shops here have never heard of it.",
]
ELSEWHERE = ["Ten things you did not know about rain", "Mayor resigns", "Why we sleep", "Die besten Suppen", "Five walks for autumn", "Rain expected on Friday"]

LAYOUTS = [
    "<div class=top><a href=/>Home</a> | <a href=/n>News</a> | <a href=/c>Contact</a></div><div id=x>{h}{p}{p}{p}</div><div class=low>&copy; 2020 The Paper. All rights reserved. <a href=/t>Terms</a></div>",
    "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>World</a></li></ul></nav><main>{h}{p}{s}{p}<div class=share><a href=/f>Share</a> <a href=/t>Tweet</a></div></main><aside class=sidebar><h3>Popular</h3><ul><li><a href=/1>{t}</a></li><li><a href=/2>{t}</a></li></ul></aside><section class=comments><h3>2 comments</h3><p>{c}</p><p>{c}</p></section><footer>Contact us</footer>",
    "<header><a href=/>Logo</a></header><div class=cookie-notice>We use cookies to improve this site, and to show you what you like. <a href=/ok>Accept</a></div><article><header>{h}</header>{p}<ul>{i}{i}{i}</ul><div class=ad>Buy new pans today!</div>{p}</article><form class=newsletter>Subscribe to our letter, and get a soup every week.</form><footer>Imprint</footer>",
    "<div class=menu><a href=/a>Start</a> <a href=/b>Produkte</a></div><div class=content>{h}{p}{p}</div><div class=sidebar>Mehr zum Thema</div><div class=footer>Impressum</div>",
    "<div>{p}</div>",
    "<div><div>{p}</div></div>",
    "<section data-main=1>{x}</section>",
    "<div class=menu><a href=/1>One</a> <a href=/2>Two</a></div><div>{p}</div><div>&copy; 2022</div>",
    "{p}",
    "{p}{p}",
    "{h}{p}",
    "<header class=site-header><p>The Daily Post</p><nav class=menu><a href=/1>Politics</a><a href=/2>Sport</a></nav></header><article class='post tags-news category-ads'>{h}{p}{p}<blockquote data-main=1>{x}</blockquote>{p}</article><div class=tags>Tags: <a href=/x>water</a>, <a href=/y>city</a></div><footer class=site-footer><p>The Daily Post is a paper for everyone, and has been so since 1920.</p><p>All rights reserved.</p></footer>",
    "<div class=page><div class=header><a href=/>A blog</a><p>Thoughts about this and that</p></div><div class=entry>{h}{p}{p}{s}{p}</div><div class=related><h3>Related</h3><ul><li><a href=/1>{t}</a></li><li><a href=/2>{t}</a></li><li><a href=/3>{t}</a></li></ul></div><div id=comments><h3>Comments</h3><article class=comment><p>{c}</p></article><article class=comment><p>{c}</p></article><article class=comment><p>{c}</p></article><article class=comment><p>{c}</p></article><form>Your name: <label>Write a reply</label></form></div></div>",
    "<div class=elementor-widget-container><ul><li><a href=/a>Home</a></li><li><a href=/b>Shop</a></li></ul></div><div class=elementor-widget-container>{h}</div><div class=elementor-widget-container>{p}{p}</div><div class=elementor-widget-container>{p}</div><div class=elementor-widget-container>{s}{p}</div><div class=elementor-widget-container>&copy; A shop</div>",
    "<form id=aspnet action=/><div class=topbar><a href=/>Home</a> <a href=/s>Services</a></div><div>{h}{p}{p}{p}</div><div>Call us: 555 0100</div></form>",
    "<table><tr><td><a href=/1>Index</a><br><a href=/2>Archive</a></td><td>{h}{p}{p}{p}</td></tr><tr><td colspan=2>Last changed 1999</td></tr></table>",
    "<ul class=nav><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul><div role=main>{h}<p class=byline>By A. Writer, 3 May</p>{p}{p}{p}<div class='promo box'>Our book of the month: only 9.99, while it lasts!</div>{p}<div class=newsletter-signup><p>Like what you read? Sign up, and we will send you a letter every Friday.</p></div></div><div role=complementary><p>About us: we write about the sea.</p></div>",
    "<div id=cookie-banner><p>This site uses cookies. By using it you agree to our use of them, as our privacy policy says.</p><button>OK</button></div><section>{h}{p}</section><section>{s}{p}<ol>{i}{i}</ol></section><section>{s}{p}</section><footer><p>Made with care in a small town by the sea.</p><a href=/p>Privacy</a></footer>",
    "<div class=breadcrumb><a href=/>Home</a> &gt; <a href=/r>Recipes</a></div><main><article>{h}<ul>{i}{i}{i}{i}</ul>{p}{p}</article><aside><h4>See also</h4><p><a href=/1>{t}</a></p><p>{x}</p></aside></main><div class=popup>Wait! Before you go, take ten percent off your next order.</div>",
    "<div class=wrap><div class=left><p><a href=/1>{t}</a></p><p><a href=/2>{t}</a></p><p><a href=/3>{t}</a></p></div><div class=mid>{h}<div data-main=1>{x}</div><div data-main=1>{x}</div><div class=comments><div class=comment>{c}</div><div class=comment>{c}</div></div></div></div><div class=legal>The Paper takes no responsibility for what other sites say. Read our terms.</div>",
    "<div class=alert><p>Our office is closed on Monday. We are sorry for any trouble that this may cause.</p></div><div class='content main-content'>{h}{p}<figure><img src=a.png><figcaption data-main=1>The harbour in May</figcaption></figure>{p}{p}</div><div class=follow>Follow us on <a href=/m>the network</a></div><div class=widget><h3>Newest</h3><a href=/1>{t}</a> <a href=/2>{t}</a></div><div class=copyright>&copy; 2021</div>",
    "<header><h1>The Paper</h1></header><main id=content>{h}{p}{p}<div class=sponsored><p>Advertisement: the new car is here, faster than ever, and it can be yours from today.</p></div>{p}</main><section id=disqus_thread><p>{c}</p><p>{c}</p><p>{c}</p></section><footer>{x}</footer>",    "<div id=main class=has-sidebar>{h}{p}{p}{p}</div><aside><h3>Most read</h3><p><a href=/1>{t}</a></p><p><a href=/2>{t}</a></p></aside><div class=footer><p>The Paper is printed by its readers. All rights reserved.</p></div>",
    "<div class='site no-sidebar'><div class=menu><a href=/1>One</a> <a href=/2>Two</a></div>{h}{p}{p}</div><div class=footer><p>This is a paper for everyone, and has been one since 1920.</p><p>&copy; 2020</p></div>",
    "<div class=layout-right-sidebar><div class=nav><a href=/1>Start</a></div><div>{h}{p}{p}{p}</div></div><footer><p>We answer every letter, but it may take some weeks. Write to us.</p></footer>",
    "<table width=100%><tr><td><a href=/1>Home</a><br><a href=/2>News</a><br><a href=/3>Links</a></td><td data-main=1>{x}<br><br>{x}<br><br>{x}</td></tr></table>",
    "<table><tr><td class=menu><a href=/1>Index</a> <a href=/2>Archive</a></td></tr><tr><td data-main=1>{x}<br><br>{x}</td></tr><tr><td>&copy; 1999</td></tr></table>",
    "<ul><li><a href=/1>Home</a></li><li><a href=/2>Shop</a></li></ul><div class='widget widget-text'>{h}{p}{p}{p}</div><div class=bottom>&copy; 2021 A shop</div>",
    "<nav><a href=/1>Start</a></nav><article>{h}{p}<table><tr><th data-main=1>Year</th><th data-main=1>Boats</th></tr><tr><td data-main=1>1990</td><td data-main=1>12</td></tr><tr><td data-main=1>2000</td><td data-main=1>31</td></tr></table>{p}<address data-main=1>The old mill, 3 River Street</address></article><footer>Contact</footer>",
    "<div><a href=/1>Start</a> <a href=/2>Towns</a></div><div>{h}{p}<table><tr><td data-main=1>Monday</td><td data-main=1>9 to 5</td></tr><tr><td data-main=1>Sunday</td><td data-main=1>closed</td></tr></table>{p}</div><div>&copy; 2022</div>",
    "<div class=head><a href=/>The Paper</a></div><div>{h}{p}{p}{p}</div><div><h3>Reader comments</h3><p>{c}</p><p>{c}</p><p>{c}</p></div><div>&copy; 2019</div>",
    "<main>{h}{p}{p}<h3>3 Comments</h3><ul><li>{c}</li><li>{c}</li><li>{c}</li></ul></main><footer>Imprint</footer>",
    "<article>{h}{p}{p}</article><h2>Kommentare</h2><p>{c}</p><p>{c}</p><p>Leave a reply</p>",
    "<article>{h}{p}<p>Read also: <a href=/1>{t}</a></p>{p}<p>Sign up for our newsletter, and get it every Friday.</p>{p}</article><footer>Contact</footer>",
    "<nav><a href=/1>Start</a></nav><main>{h}{p}{p}<p>See also: <a href=/1>{t}</a></p>{p}<div><p>Subscribe to our newsletter to get stories like this one.</p></div></main><footer>Imprint</footer>",
    "<nav><a href=/1>Start</a></nav><article>{h}{p}<p data-main=1>All rights reserved.</p>{p}<p data-main=1>They were given tea and cookies, and asked to log in.</p>{p}</article><footer>&copy; 2020. All rights reserved.</footer>",
    "<div class=topbar><a href=/1>One</a></div><section>{h}</section><section data-main=1>{x}</section><section data-main=1>{x}</section><section data-main=1>{x}</section><div class=copyright>&copy; 2020</div>",
]


def _filled(layout: str, texts: dict) -> str:
    out, rest = [], layout
    while "{" in rest:
        before, rest = rest.split("{", 1)
        out += [before, next(texts[rest[0]])]
        rest = rest[2:]
    return f"<body>{''.join(out)}{rest}</body>"


def pages() -> list[str]:
    def around(texts, shape, k):
        return islice(cycle(shape.format(x) for x in texts), k, None)

    out = []
    for k, tag in ((0, "p"), (3, "p"), (5, "div"), (1, "div"), (2, "section")):
        texts = {"h": around(TITLES, "<h1 data-main=1>{}</h1>", k), "s": around(HEADINGS, "<h2 data-main=1>{}</h2>", k), "p": around(PARAGRAPHS, f"<{tag} data-main=1>{{}}</{tag}>", k), "i": around(ITEMS, "<li data-main=1>{}</li>", k), "x": around(PARAGRAPHS, "{}", k + 2), "c": around(COMMENTS, "{}", k), "t": around(ELSEWHERE, "{}", k)}
        out += [_filled(layout, texts) for layout in LAYOUTS if tag == "p" or "{p}" in layout]
    return out


PAGES = pages()
