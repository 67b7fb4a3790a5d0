"""Made-up page layouts with known main text, to train the page extractor on.

Every layout puts an article among menus, banners, notices, forms, adverts, sidebars, comments
and footers, in a random choice of elements, names and order. Words are random letters.
"""

from __future__ import annotations

import random

ARTICLE_NAMES = "article content post entry story body main text article-body post-content entry-content story-body articleBody main-content blog-post page-content".split()
BOILERPLATE_NAMES = {
    "menu": "nav menu navbar main-nav navigation topbar site-nav breadcrumbs breadcrumb tabs toc pagination pager".split(),
    "header": "header site-header masthead branding banner logo top page-header".split(),
    "footer": "footer site-footer bottom copyright legal colophon page-footer".split(),
    "sidebar": "sidebar aside widget rail right-column secondary related related-posts recommended trending tags".split(),
    "notice": "cookie cookie-notice consent gdpr alert notice popup modal message disclaimer".split(),
    "advert": "ad ads advert advertisement sponsored promo sponsor ad-slot banner-ad adsbygoogle".split(),
    "form": "form newsletter subscribe signup login search search-box contact".split(),
    "comments": "comments comment comment-list discussion replies responses disqus reader-comments reply".split(),
    "share": "share social sharing byline meta author-box post-meta share-buttons".split(),
}
TAGS = {
    "menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "aside", "section", "p"],
    "advert": ["div", "aside", "p", "section"], "form": ["form", "div"], "comments": ["section", "div", "ol", "ul", "aside"], "share": ["div", "ul", "p", "aside"],
}


class Layout:
    """One random page: ``html`` and ``main``, the texts of its main blocks."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: list[str] = []
        self.plain = self.r.random() < 0.12  # names that tell nothing
        self.html = self._page()

    def _words(self, low: int, high: int) -> str:
        r = self.r
        out = []
        for i in range(r.randint(low, high)):
            word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 9)))
            out.append(word.capitalize() if not out or out[-1][-1] == "." else word)
            if i and r.random() < 0.12:
                out[-1] += r.choice(".,.")
        return " ".join(out)

    def _name(self, names: list[str]) -> str:
        r = self.r
        if self.plain or r.random() < 0.1:
            return r.choice(["", ' class="c%d"' % r.randint(1, 99), ' id="x%d"' % r.randint(1, 99)])
        return ' %s="%s"' % (r.choice(["class", "class", "class", "id"]), r.choice(names))

    def _block(self, kind: str, inner: str) -> str:
        tag = self.r.choice([t for t in TAGS[kind] if t != "p" or "<" not in inner.replace("<a ", "").replace("</a>", "")])
        if tag in ("ul", "ol") and "<li" not in inner:
            inner = f"<li>{inner}</li>"
        return f"<{tag}{self._name(BOILERPLATE_NAMES[kind])}>{inner}</{tag}>"

    def _links(self, low: int, high: int) -> str:
        r = self.r
        links = [f'<a href="/{i}">{self._words(1, 4)}</a>' for i in range(r.randint(low, high))]
        how = r.random()
        if how < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"
        return (" | " if how < 0.8 else " ").join(links)

    def _part(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            return self._block(kind, self._links(2, 10))
        if kind == "header":
            motto = f"<p>{self._words(2, 8)}</p>" if r.random() < 0.5 else ""
            return self._block(kind, f'<a href="/">{self._words(1, 3)}</a>' + motto + (self._part("menu") if r.random() < 0.5 else ""))
        if kind == "footer":
            return self._block(kind, r.choice([f"&copy; {self._words(2, 30)}", f"<p>&copy; {self._words(2, 12)}</p>", self._links(2, 8) + f"<p>{self._words(3, 20)}</p>"]))
        if kind == "sidebar":
            heading = f"<h3>{self._words(1, 4)}</h3>" if r.random() < 0.5 else ""
            teasers = "".join(f'<p><a href="/">{self._words(3, 10)}</a> {self._words(0, 12)}</p>' for _ in range(r.randint(1, 4)))
            return self._block(kind, heading + r.choice([self._links(2, 8), f"<p>{self._words(5, 60)}</p>", teasers]))
        if kind == "notice":
            boxed = f"<p>{self._words(5, 40)}</p><button>{self._words(1, 2)}</button>"
            return self._block(kind, r.choice([self._words(5, 40), boxed, f'{self._words(5, 30)} <a href="/">{self._words(1, 3)}</a>']))
        if kind == "advert":
            return self._block(kind, r.choice([self._words(2, 25), f'<a href="/">{self._words(2, 12)}</a>', f"<p>{self._words(3, 40)}</p>"]))
        if kind == "form":
            hint = f"<p>{self._words(3, 20)}</p>" if r.random() < 0.6 else self._words(0, 12)
            return self._block(kind, f'<label>{self._words(1, 3)}</label><input name="q">{hint}<button>{self._words(1, 2)}</button>')
        if kind == "share":
            return self._block(kind, r.choice([self._links(2, 5), self._words(2, 8), f"<span>{self._words(2, 5)}</span> <span>{self._words(1, 4)}</span>"]))
        item = r.choice(["div", "article", "li"])
        comments = "".join(
            f'<{item}{self._name(["comment", "comment-body", "reply", "comment-item"])}>'
            + r.choice([f"<b>{self._words(1, 2)}</b>", f"<span>{self._words(1, 3)}</span>", ""]) + f"<p>{self._words(2, 70)}</p></{item}>"
            for _ in range(r.randint(1, 8))
        )
        return self._block("comments", (f"<h3>{self._words(1, 3)}</h3>" if r.random() < 0.6 else "") + comments)

    def _main_block(self, tag: str, text: str) -> str:
        self.main.append(text)
        r = self.r
        if tag == "p" and r.random() < 0.2:
            words = text.split(" ")
            i = r.randrange(len(words))
            words[i] = r.choice(['<a href="/x">%s</a>', "<b>%s</b>", "<em>%s</em>", "<span>%s</span>"]) % words[i]
            text = " ".join(words)
        how = r.random()
        return f"<{tag}><b>{text}<br>" if tag == "p" and how < 0.06 else f"<{tag}>{text}" if tag == "p" and how < 0.12 else f"<{tag}>{text}</{tag}>"

    def _article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.75:
            heading = self._main_block("h1", self._words(1, 14))
            out.append(f"<header>{heading}</header>" if r.random() < 0.1 else heading)
        if r.random() < 0.25:
            out.append(self._part("share"))
        plain = "div" if r.random() < 0.1 else "p"
        longest = r.choice([4, 15, 60, 150])
        for _ in range(r.choice([1, 1, 2, 4, 7, 15, 25])):
            out.append(self._main_block(plain, self._words(1, longest)))
            how = r.random()
            if how < 0.06:
                out.append(self._main_block(f"h{r.randint(2, 4)}", self._words(1, 8)))
            elif how < 0.10:
                out.append("<ul>" + "".join(self._main_block("li", self._words(1, 25)) for _ in range(r.randint(2, 6))) + "</ul>")
            elif how < 0.13:
                out.append("<blockquote>" + self._main_block("p", self._words(3, 40)) + "</blockquote>")
            elif how < 0.15:
                out.append("<table>" + "".join("<tr>" + "".join(self._main_block("td", self._words(1, 4)) for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif how < 0.22:
                out.append(self._part(r.choice(["advert", "advert", "form", "sidebar", "notice", "share"])))
        inner = "".join(out)
        for _ in range(r.choice([0, 0, 1, 2])):
            inner = f"<div{self._name(ARTICLE_NAMES)}>{inner}</div>"
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        if r.random() < 0.15:
            inner += self._part("comments")
        if r.random() < 0.1:
            inner += self._part("share")
        if tag == "td":
            return f"<table><tr><td{self._name(ARTICLE_NAMES)}>{inner}</td></tr></table>"
        named = "" if tag in ("article", "main") and r.random() < 0.7 else self._name(ARTICLE_NAMES)
        return f"<{tag}{named}>{inner}</{tag}>"

    def _page(self) -> str:
        r = self.r
        before = [k for k, p in (("notice", 0.25), ("header", 0.5), ("menu", 0.7), ("advert", 0.4), ("form", 0.15), ("sidebar", 0.2)) if r.random() < p]
        after = [k for k, p in (("share", 0.15), ("advert", 0.2), ("form", 0.2), ("sidebar", 0.35), ("comments", 0.35), ("menu", 0.1), ("footer", 0.8), ("notice", 0.15)) if r.random() < p]
        body = "".join(self._part(k) for k in before) + self._article() + "".join(self._part(k) for k in after)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            body = f'<div{r.choice(["", " id=page", " class=wrapper", " class=container", " class=site"])}>{body}</div>'
        end = "" if r.random() < 0.1 else "</body></html>"
        return f"<!DOCTYPE html><html><head><title>{self._words(1, 6)}</title><style>p{{}}</style><script>x('</p>')</script></head><body>{body}{end}"
