"""Pages: a plain tree scorer on generated trees, pages of known text, and time on hostile input."""

import random
import time

import pytest

from chronograft.llm.html import extract

P = "This is a long sentence, with commas, and words that go on for quite a while. " * 4
TEXT = P.strip()


class Tree:
    def __init__(self, tag, cls="", text="", kids=()):
        self.tag, self.cls, self.text, self.kids, self.up = tag, cls, text, list(kids), None
        for k in self.kids:
            k.up = self

    def html(self):
        return f'<{self.tag} class="{self.cls}">{self.text}{"".join(k.html() for k in self.kids)}</{self.tag}>'

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()

    def above(self):
        return [self, *self.up.above()] if self.up else [self]


def points(text):
    return 1 + text.count(",") + min(len(text) / 100, 3)


FLAG = {"ad": 1, "left-sidebar": 1, "comment-list": 2, "has-sidebar": 0, "": 0, "story": 0}
BONUS = {"article": 10, "main": 8, "section": 2, "div": 1}


def plain(root):
    """The rules stated over whole subtrees, each asked anew."""
    every = list(root.walk())
    hard = lambda n: any(a.tag in ("nav", "footer", "aside") for a in n.above())
    held = [n for n in every if n.text and not hard(n)]
    total = sum(points(n.text) for n in held)
    share = lambda n: sum(points(m.text) for m in held if n in m.above())
    gone = lambda n: any(FLAG[a.cls] == 2 or (FLAG[a.cls] == 1 and share(a) <= 0.8 * total) for a in n.above())
    held = [n for n in held if not gone(n)]
    if not held:
        return ""
    own = lambda n: n if n.tag in ("div", "section", "article", "main", "body") else n.up

    def score(n):
        s = sum(points(m.text) / 2 ** own(m).above().index(n) for m in held if n in own(m).above())
        return s + BONUS.get(n.tag, 0) if s else 0

    best = max(every, key=score)
    named = [a for a in best.above() if a.tag in ("article", "main")]
    size = lambda n: sum(len(m.text) for m in held if n in m.above())
    if named:
        best = named[0]
    else:
        while best.up and best.up.up and size(best.up) == size(best):
            best = best.up
    out = []
    for m in held:
        chain = m.above()
        side = [a for a in chain if a.up is best.up and a is not best] if best.up else []
        keep = best in chain
        if side and not keep:
            s = side[0]
            if named and best.up.tag == "body":
                keep = s.tag[0] != "h" and s.tag not in ("ul", "ol", "table") and score(s) >= max(10, 0.2 * score(best))
            else:
                keep = s.tag in ("p", "h2", "ul") or (s.tag in ("div", "section", "article", "main") and score(s) >= 2)
        if m is best.up:
            keep = keep or len(m.text) > 80 or m.text[-1] in ".!?"
        if keep:
            out.append(m.text)
    return "\n".join(out)


def test_generated_trees():
    rnd = random.Random(8)
    words = ["alpha", "beta,", "gamma", "delta.", "epsilon", "zeta,"]

    def make(depth):
        tag = rnd.choice(["div", "div", "section", "p", "p", "p", "h2", "ul", "nav", "aside", *(["article"] if rnd.random() < 0.2 else [])])
        if tag in ("p", "h2") or depth > 4:
            return Tree("p" if depth > 4 else tag, text=" ".join(rnd.choice(words) for _ in range(rnd.choice([2, 8, 30, 80]))))
        if tag == "ul":
            return Tree("ul", kids=[Tree("li", text=rnd.choice(words) + " item") for _ in range(3)])
        return Tree(tag, rnd.choice(["", "", "", *FLAG]), text=rnd.choice(["", "", "own text, of it."]), kids=[make(depth + 1) for _ in range(rnd.randint(0, 4))])

    several = 0
    for _ in range(400):
        body = Tree("body", kids=[make(0) for _ in range(rnd.randint(1, 5))])
        root = Tree("html", kids=[body])
        want = plain(root)
        assert extract(f"<html>{body.html()}</html>") == want, body.html()
        several += want.count("\n") > 2
    assert several > 100


@pytest.mark.parametrize("name", ["content has-sidebar", "social-science", "notice-of-meeting", "sidebar", "post related-open"])
def test_names_do_not_take_the_article(name):
    for tag in ("div", "article"):
        assert extract(f'<body><nav>x</nav><{tag} class="{name}"><p>{P}</p><p>{P}</p></{tag}><footer>f</footer></body>') == f"{TEXT}\n{TEXT}"


def test_parts_of_the_article_stay():
    page = (f"<body><header>Site</header><div><h1>Title</h1><div><p>{P}</p><p>{P}</p></div><h2>Two</h2><ul><li>a<li>b</ul><ol><li>c</ol>"
            f"<table><tr><td>d<td>e</table><div><p>{P}</p></div></div><div class='comments'><p>{P * 3}</p></div><div id=cookie-banner>We bake</div></body>")  # fmt: skip
    assert extract(page) == "\n".join(["Title", TEXT, TEXT, "Two", "a", "b", "c", "d", "e", TEXT])
    assert extract(f"<body><header>Site</header><article><header><h1>My title</h1></header><p>{P}</p></article></body>") == f"My title\n{TEXT}"


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), (" \n", ""), ("plain  text", "plain text"), ("a &lt; b &amp;&nbsp;c", "a < b & c"), ("1 < 2", "1 < 2"),
    ("<p>one<p>two", "one\ntwo"), ("<p>x<br>y</p>", "x y"), ("<nav>menu</nav>", ""), ("<p>a</p><!-- never closed <p>b", "a"),
    ('<p title="a>b">t</p>', "t"), ("<p>é中🙂</p>", "é中🙂"), ("<script>var t='</p>';</script><p>ok</p>", "ok")])
def test_small_pages(page, want):
    assert extract(page) == want


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<div>x ", "<b>", '<a "', '<a x="', "<p>a, ", "<!--", "<script>", "</", "<li>", "<td><table>", "<", "&"])
def test_time_is_linear(piece):
    def took(n):
        began = time.process_time()
        extract(piece * (n // len(piece)))
        return time.process_time() - began

    took(1000)
    assert took(400_000) < 3
