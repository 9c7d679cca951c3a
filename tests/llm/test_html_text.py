import html
import random
import re

import pytest

from blocklog.llm.html_text import extract_text, kept_lines, main_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article><h1>T</h1><p>a<b>b</b>  c\n d</p><p>e &amp; f&nbsp;g &am</p></article><footer>no</footer>", "T ab c d e & f g &am"),
        ("<nav>x</nav><article><p>one<div class='ad'>buy</div><p>two<form><p>in</form><aside>s</aside></article><div>outside</div>", "one two"),
        ("<body><div class=sidebar><p>s</p></div><article>a<script>if (a<b) </script><style>p</style><!-- <p>c</p> --><p>b</article>", "a b"),
        ("<article>t<section class='comments'><p>reader</p></section></article>", "t"),
        ("<main><p>m</main><article class=comment><p>no</article>", "m"),
        ("<article><p>unclosed <b>bold<p>next", "unclosed bold next"),
        ("<article>x</article><article>y</article>", "x y"),
        ("a < b and c > d " * 5, " ".join(["a < b and c > d"] * 5)),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("marked", ["<p class=ad>buy", "<p class=ad>buy<p id=promo>now", "<p role=menu>buy <b>now"])
def test_an_unclosed_marked_paragraph_ends_at_the_next(marked):
    assert main_text(f"<article><p>one{marked}<p>two</p><p>three</p></article><p>outside") == "one two three"


def test_line_blocks_without_an_article():
    body = "".join(f"<p>{'word ' * 12}{i}</p>" for i in range(5))
    page = f"<body><ul>{''.join(f'<li><a href=/{i}>l{i}</a></li>' for i in range(8))}</ul><p></p><div id=content>{body}<p>short</p></div><div class='cookie-notice'>We use</div><footer>c</footer></body>"
    assert main_text(page).endswith(" ".join(f"{'word ' * 12}{i}" for i in range(5)) + " short")


def test_random_articles_are_whole():
    r = random.Random(1)
    for _ in range(50):
        parts = [" ".join(r.choice(["a&b", "<x>", "é", "word", '"q"']) for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(1, 9))]
        page = "<html><head><title>t</title></head><body><nav><a>m</a></nav><article>" + "".join(f"<p>{html.escape(p)}" + r.choice(["</p>", ""]) for p in parts) + "</article><footer>f</footer></body></html>"
        assert main_text(page) == re.sub(r"\s+", " ", " ".join(parts))


def test_operator(spark):
    rows = [(1, "u", "<article>a</article>", "old"), (1, "u", "<article>a</article>", "old"), (2, None, None, "old")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_sums_decide_where_no_list_helps():
    body = "".join(f"<div>{'word ' * 30}{i}</div>" for i in range(4))
    links = "".join(f"<div><a href=/{i}>a long link text to another page {i}</a></div>" for i in range(5))
    page = f"<body><div>Site</div>{links}{body}<div>The end.</div>{links}<div>All rights reserved, 2020</div></body>"
    assert main_text(page) == " ".join(f"{'word ' * 30}{i}" for i in range(4)) + " The end."
    assert main_text(f"<article>{body}{links}</article>") == " ".join(f"{'word ' * 30}{i}" for i in range(4))


def test_nothing_is_lost_to_length_or_to_a_name():
    assert main_text("<div><p>Short.</p><p>Tiny text.</p></div>") == "Short. Tiny text."
    assert main_text('<article><p class="share-price">a</p><p id="related-work">b</p><h1 class="header">c</h1></article>') == "a b c"
    assert main_text('<article><div class="ad-box-2">no</div><ul class="social-links"><li>no</ul>yes</article>') == "yes"
    assert main_text('<article><a title="5" tall">link</a><p>x</article>') == "link x"


@pytest.mark.parametrize("piece", ['<p "', "<", "<a b=\"", "<article>", "<b></i>", "<div>", "<main></article>", "<p>x", "</b>"])
def test_malformed_markup_takes_linear_time(piece):
    import time

    spent = []
    for n in (20_000, 160_000):
        began = time.process_time()
        main_text(piece * n)
        spent.append(time.process_time() - began)
    assert spent[1] < 30 * spent[0] + 0.5


@pytest.mark.parametrize("seed", range(200))
def test_blocks_against_brute_force(seed):
    r = random.Random(seed)
    n, window, surge = r.randrange(0, 25), r.randrange(1, 5), r.choice([0.0, 0.2, 0.6])
    weights = [r.choice([0, 0, 0, 1, 5, 40]) for _ in range(n)]
    gap = [any(all(0 <= k < n and not weights[k] for k in range(a, a + window)) for a in range(i - window + 1, i + 1)) for i in range(n)]
    block = {i: next((k for k in range(i, n) if gap[k]), n) for i in range(n) if not gap[i]}
    first = {end: min(i for i in block if block[i] == end) for end in block.values()}
    tops = {end: max(sum(weights[i : min(i + window, end)]) for i in range(a, end)) for end, a in first.items()}
    most = max(tops.values(), default=0)
    assert kept_lines(weights, window, surge) == [i in block and tops[block[i]] > 0 and tops[block[i]] >= surge * most for i in range(n)]
