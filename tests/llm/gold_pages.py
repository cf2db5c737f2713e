"""Pages written by hand and their main texts."""

NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 The Daily Example. All rights reserved.</p></footer>"

GOLD = [
    # 1 a plain article
    (f"<html><body>{NAV}<article><h1>Rain floods the valley</h1><p>Heavy rain fell for three days.</p><p>Two bridges were closed on Monday.</p></article>{FOOT}</body></html>", "Rain floods the valley\nHeavy rain fell for three days.\nTwo bridges were closed on Monday."),
    # 2 main instead of article
    (f"<body>{NAV}<main><h1>How to prune roses</h1><p>Cut above an outward bud in early spring.</p><ul><li>Use sharp shears for every cut you make.</li><li>Remove the dead wood first of all.</li></ul></main>{FOOT}</body>", "How to prune roses\nCut above an outward bud in early spring.\nUse sharp shears for every cut you make.\nRemove the dead wood first of all."),
    # 3 a div with a content class and an advert inside
    (f'<body>{NAV}<div class="entry-content"><h1>A week by the lake</h1><p>We arrived on a misty morning.</p><div class="advertisement"><p>Buy new boots today!</p></div><p>The water was cold but clear.</p></div>{FOOT}</body>', "A week by the lake\nWe arrived on a misty morning.\nThe water was cold but clear."),
    # 4 a sidebar with related links
    (f'<body><article><h1>Local team wins</h1><p>The match ended three to one.</p></article><aside class="sidebar"><h3>Related stories</h3><ul><li><a href="/1">Older match report</a></li><li><a href="/2">Ticket prices rise</a></li></ul></aside>{FOOT}</body>', "Local team wins\nThe match ended three to one."),
    # 5 comments of readers
    ('<body><article><h1>Should we ban cars?</h1><p>The council will vote next week on the plan.</p></article><section class="comments"><h3>Comments</h3><div class="comment"><p>I think this is a great idea.</p></div><div class="comment"><p>Never, I need my car.</p></div></section></body>', "Should we ban cars?\nThe council will vote next week on the plan."),
    # 6 a cookie notice first
    ('<body><div class="cookie"><p>We use cookies to improve your experience.</p></div><article><h1>Bread in an hour</h1><p>Mix flour, water, salt and yeast in a large bowl.</p></article></body>', "Bread in an hour\nMix flour, water, salt and yeast in a large bowl."),
    # 7 a form in the middle
    ('<body><article><h1>Join our walk</h1><p>We meet at nine in front of the old mill.</p><form action="/s"><label>Email address</label><input name="e"><button>Sign up</button></form><p>Bring water and a hat.</p></article></body>', "Join our walk\nWe meet at nine in front of the old mill.\nBring water and a hat."),
    # 8 character references and white space
    ("<body><article><h1>Caf&eacute; &amp; bar</h1><p>Open&nbsp;until \n\t ten   o&#39;clock.</p></article></body>", "Café & bar\nOpen until ten o'clock."),
    # 9 inline markup
    ("<body><article><h1>On <em>style</em></h1><p>Use <b>bold</b> and <i>italic</i> <a href=/x>sparingly</a>, always.</p></article></body>", "On style\nUse bold and italic sparingly, always."),
    # 10 scripts and styles
    ('<html><head><title>T</title><style>p{color:red}</style><script>var a="<p>no</p>";</script></head><body><article><h1>Clean text</h1><script>track("x")</script><p>Only this counts as text here.</p></article></body></html>', "Clean text\nOnly this counts as text here."),
    # 11 html comments
    ("<body><article><h1>Seen</h1><!-- <p>not seen</p> --><p>This paragraph is visible to all.</p></article></body>", "Seen\nThis paragraph is visible to all."),
    # 12 unclosed paragraphs
    (f"<body>{NAV}<article><h1>Old pages</h1><p>The first has no end tag.<p>Nor has the second one.<p>And the third ends here.</article>{FOOT}</body>", "Old pages\nThe first has no end tag.\nNor has the second one.\nAnd the third ends here."),
    # 13 a table of results
    ("<body><article><h1>Results</h1><p>These are the final times.</p><table><tr><td>Anna</td><td>3:20</td></tr><tr><td>Ben</td><td>3:45</td></tr></table></article></body>", "Results\nThese are the final times.\nAnna\n3:20\nBen\n3:45"),
    # 14 a quotation
    ("<body><article><h1>What she said</h1><p>The mayor was clear about it.</p><blockquote><p>We will build the school.</p></blockquote><p>Work begins in May.</p></article></body>", "What she said\nThe mayor was clear about it.\nWe will build the school.\nWork begins in May."),
    # 15 a caption
    ("<body><article><h1>The tower</h1><figure><img src=t.jpg><figcaption>The tower at dusk in winter.</figcaption></figure><p>It was built in 1884 by two brothers.</p></article></body>", "The tower\nThe tower at dusk in winter.\nIt was built in 1884 by two brothers."),
    # 16 a header with the site's name
    (f'<body><header class="site-header"><div>The Daily Example</div>{NAV}</header><article><h1>Snow expected</h1><p>Up to ten centimetres may fall tonight.</p></article>{FOOT}</body>', "Snow expected\nUp to ten centimetres may fall tonight."),
    # 17 German
    (f'<body>{NAV}<article><h1>Über die Brücke</h1><p>Die alte Brücke wird im Sommer gesperrt.</p><p>Eine Umleitung führt über Mühldorf.</p></article><footer><p>Impressum und Datenschutz</p></footer></body>', "Über die Brücke\nDie alte Brücke wird im Sommer gesperrt.\nEine Umleitung führt über Mühldorf."),
    # 18 French, with a newsletter box
    ('<body><article><h1>Le marché rouvre</h1><p>Le marché couvert rouvre ses portes samedi.</p></article><div class="newsletter"><p>Abonnez-vous à notre lettre.</p></div></body>', "Le marché rouvre\nLe marché couvert rouvre ses portes samedi."),
    # 19 Spanish, section with a post class
    (f'<body>{NAV}<section class="post"><h1>La feria del libro</h1><p>La feria abre el viernes con doscientos puestos.</p></section>{FOOT}</body>', "La feria del libro\nLa feria abre el viernes con doscientos puestos."),
    # 20 sub-headings
    ("<body><article><h1>Bees</h1><h2>In spring</h2><p>Colonies grow quickly when flowers open.</p><h2>In winter</h2><p>They keep warm in a tight cluster.</p></article></body>", "Bees\nIn spring\nColonies grow quickly when flowers open.\nIn winter\nThey keep warm in a tight cluster."),
    # 21 share buttons
    ('<body><article><h1>New library</h1><p>It opens with forty thousand books.</p><div class="share"><ul><li><a href="#">Share</a></li><li><a href="#">Tweet</a></li></ul></div></article></body>', "New library\nIt opens with forty thousand books."),
    # 22 breadcrumbs and pagination
    ('<body><div class="breadcrumbs"><ul><li><a href="/">Start</a></li><li><a href="/g">Garden</a></li></ul></div><article><h1>Compost</h1><p>Turn the heap once a month for air.</p></article><div class="pagination"><ul><li><a href="?2">Next page</a></li></ul></div></body>', "Compost\nTurn the heap once a month for air."),
    # 23 nothing but menus
    (f"<body>{NAV}{FOOT}</body>", ""),
    # 24 an empty article
    (f"<body>{NAV}<article></article>{FOOT}</body>", ""),
    # 25 upper-case tags and unquoted attributes
    ("<BODY><ARTICLE ID=story><H1>Loud markup</H1><P CLASS=lead>It is still the same document.</P></ARTICLE></BODY>", "Loud markup\nIt is still the same document."),
    # 26 angle brackets in the text
    ("<body><article><h1>Orders</h1><p>If a < b and b < c then a < c as well.</p></article></body>", "Orders\nIf a < b and b < c then a < c as well."),
    # 27 a > within a quoted attribute
    ('<body><article><h1>Quoting</h1><p title="a > b">The title is not part of the text.</p></article></body>', "Quoting\nThe title is not part of the text."),
    # 28 a promotion between sections
    ('<body><main><h1>City guide</h1><p>Start at the harbour and walk uphill.</p><section class="promo"><p>Book a hotel now and save.</p></section><p>End the day at the castle.</p></main></body>', "City guide\nStart at the harbour and walk uphill.\nEnd the day at the castle."),
    # 29 a widget of popular links in a div
    (f'<body><div class="post-body"><h1>Night trains</h1><p>The service returns after ten years.</p><p>Tickets go on sale in March.</p></div><div class="widget popular"><h3>Most read</h3><ul><li><a href="/a">Strike ends</a></li></ul></div>{FOOT}</body>', "Night trains\nThe service returns after ten years.\nTickets go on sale in March."),
    # 30 an alert and a login form before the text
    (f'<body><div class="alert"><p>Scheduled maintenance on Sunday.</p></div><form action="/in"><label>User name</label><input name=u><button>Log in</button></form><article><h1>Solar roofs</h1><p>Half of new houses have panels.</p></article>{FOOT}</body>', "Solar roofs\nHalf of new houses have panels."),
]
