"""Labelled pages for the weights of main text: generated layouts in which [[ and ]] enclose what is to be kept.

Each page draws a frame (landmarks, named boxes, bare boxes, tables, line breaks), furniture around and
inside it, and the blocks of its article: paragraphs, headings, nested boxes, lists, lists of links,
tables, quotes, code, figures. The number of pages and the seed are parameters.
"""

from __future__ import annotations

import random

PAGES, SEED = 240, 7
SYLLABLES = "ba ce di fo gu ha le mi no pu ra se ti vo wu ya zen kar lom".split()

FRAMES = [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"),
    ('<section class="story">', "</section>"), ('<div class="wrapper"><div class="inner"><main>', "</main></div></div>"), ('<div class="page-content"><div><div>', "</div></div></div>"),
    ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("<table><tr><td>", "</td></tr></table>"), ("<center>", "</center>"), ("", ""),
]
#: The frames from here on say nothing about what they hold.
BARE = 8


class _Draw(random.Random):
    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.choices(SYLLABLES, k=self.randint(1, 3))) for _ in range(self.randint(low, high)))

    def links(self, low: int, high: int, most: int, mark: str = "li") -> str:
        return "".join(f'<{mark}><a href="/{i}">{self.words(1, most)}</a></{mark}>' for i in range(self.randint(low, high)))

    def block(self, named: bool) -> str:
        """One block of an article; link lists and boxes of short texts only where the frame tells the article."""
        kind = self.randint(0, 11 if named else 7)
        if kind <= 3:
            return f"<p>{self.words(15, 70)}</p>"
        if kind == 4:
            return f'<p>{self.words(8, 20)} <a href="/x">{self.words(1, 3)}</a> {self.words(5, 20)} <b>{self.words(1, 2)}</b> {self.words(3, 9)}</p>'
        if kind == 5:
            return f"<h2>{self.words(2, 6)}</h2><p>{self.words(10, 40)}</p>"
        if kind == 6:
            return f"<blockquote><p>{self.words(8, 30)}</p></blockquote><p>{self.words(8, 30)}</p>"
        if kind == 7:
            return f"<ul>{''.join(f'<li>{self.words(4, 14)}</li>' for _ in range(self.randint(2, 6)))}</ul>"
        if kind == 8:
            return f"<ul>{self.links(3, 40, 5)}</ul>"
        if kind == 9:
            return "".join(f"<div><div>{self.words(1, 8)}</div></div>" for _ in range(self.randint(1, 6)))
        if kind == 10:
            rows = "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(self.randint(2, 6)))
            return f"<table><thead><tr><th>{self.words(1, 2)}</th></tr></thead><tbody>{rows}</tbody></table>"
        return f'<figure><img src="a.png"><figcaption>{self.words(3, 10)}</figcaption></figure><pre><code>{self.words(3, 12)}</code></pre>'

    def menu(self, named: bool) -> str:
        if named:
            return self.choice([f"<nav><ul>{self.links(3, 9, 2)}</ul></nav>", f'<div class="menu">{self.links(3, 9, 2, "span")}</div>', f"<header><h3>{self.words(2, 4)}</h3></header>"])
        return self.choice([f"<ul>{self.links(3, 12, 3)}</ul>", f"<div>{self.links(3, 9, 2, 'span')}</div>", f"<table><tr>{self.links(3, 9, 2, 'td')}</tr></table>", f"<p>{self.links(2, 5, 2, 'small')}</p>"])

    def foot(self, named: bool) -> str:
        if named:
            return self.choice([f"<footer>{self.words(4, 12)}</footer>", f'<div class="comments"><div class="comment"><p>{self.words(8, 30)}</p></div></div>', f"<aside><p>{self.words(6, 20)}</p></aside>"])
        return self.choice([f"<hr><center><font>{self.words(2, 6)}</font></center>", f"<div>{self.links(2, 8, 4, 'span')}</div>", f"<section><h4>{self.words(1, 3)}</h4>{self.links(3, 9, 6, 'div')}</section>"])

    def page(self) -> str:
        at = self.randrange(len(FRAMES))
        opened, closed = FRAMES[at]
        named = at < BARE
        body = [f"<h1>{self.words(2, 9)}</h1>"] if self.random() < 0.7 else []
        body += [self.block(named) for _ in range(self.randint(2, 9))]
        if not named and self.random() < 0.3:
            body = ["<br>".join(self.words(8, 25) for _ in range(self.randint(3, 8)))]
        inside = "".join(body)
        if self.random() < 0.3:
            advert = f'<div class="ad">{self.words(5, 30)}</div>'
            inside = f"{''.join(body[:1])}]]{advert}[[{''.join(body[1:])}"
        before, after = (self.menu(self.random() < 0.6), self.foot(self.random() < 0.6))
        return f"<html><body>{before}{opened}[[{inside}]]{closed}{after}</body></html>"


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> list[str]:
    draw = _Draw(seed)
    return [draw.page() for _ in range(pages)]
