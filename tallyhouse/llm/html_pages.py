"""Labelled pages to learn from: layouts put together from common parts of web pages.

Whatever carries data-y="1" is main text and what carries data-y="0" is not; parts
within inherit the mark.  The pages are a fixed series, made from their numbers.
"""

import random

_SYLLABLES = "an be co de el fi ga he in jo ka la mo ne or pa qui re su ta un ve wo zi the th ing er".split()


class _Writer:
    def __init__(self, number: int):
        self.rng = random.Random(number)

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 3))) for _ in range(rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 18).capitalize() + self.rng.choice([".", ".", ".", ",", "!", "?"]) for _ in range(self.rng.randint(low, high)))

    def maybe(self, chance: float, part: str) -> str:
        return part if self.rng.random() < chance else ""

    def links(self, low: int, high: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/x">{self.words(1, 4)}</a></{tag}>' for _ in range(self.rng.randint(low, high)))

    def named(self, *names: str) -> str:
        """An attribute with one of the names, as class or id, sometimes with more."""
        name = self.rng.choice(names)
        return f' {self.rng.choice(["class", "class", "id"])}="{self.maybe(0.2, "box ")}{name}{self.maybe(0.2, " wide")}"'

    def inline(self, text: str) -> str:
        """Text with some of its words in inline elements."""
        words = text.split(" ")
        for _ in range(self.rng.randint(0, 2)):
            i = self.rng.randrange(len(words))
            words[i] = self.rng.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/y">{}</a>', "<span>{}</span>"]).format(words[i])
        return " ".join(words)

    # parts that are not main text

    def nav(self) -> str:
        tag = self.rng.choice(["nav", "nav", f'div{self.named("nav", "menu", "navbar", "main-menu", "topnav")}', "ul" + self.named("menu", "nav", "navigation")])
        inner = self.links(2, 9) if tag.startswith("ul") else self.rng.choice([f"<ul>{self.links(2, 9)}</ul>", self.links(2, 9, "span"), self.links(3, 6, "div")])
        return f'<{tag} data-y="0">{inner}</{tag.split()[0]}>'

    def header(self) -> str:
        tag = self.rng.choice(["header", "div" + self.named("header", "masthead", "site-header", "top")])
        return f'<{tag} data-y="0"><div>{self.words(1, 4)}</div>{self.maybe(0.4, self.nav())}</{tag.split()[0]}>'

    def footer(self) -> str:
        tag = self.rng.choice(["footer", "footer", "div" + self.named("footer", "site-footer", "bottom", "copyright")])
        inner = self.rng.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", f"<p>{self.sentences(1, 2)}</p>", f"<ul>{self.links(2, 5)}</ul>"])
        return f'<{tag} data-y="0">{inner}</{tag.split()[0]}>'

    def advert(self) -> str:
        tag = self.rng.choice(["div" + self.named("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot"), "aside" + self.named("ad", "promo"), "section" + self.named("sponsor", "ad")])
        inner = self.rng.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 4)}</p>", f'<a href="/ad">{self.words(2, 9)}</a>', f"<h3>{self.words(1, 5)}</h3><p>{self.sentences(1, 2)}</p>"])
        return f'<{tag} data-y="0">{inner}</{tag.split()[0]}>'

    def sidebar(self) -> str:
        tag = self.rng.choice(["aside", "aside", "div" + self.named("sidebar", "side", "right-column", "widget", "widgets", "rail")])
        inner = self.rng.choice([f"<h3>{self.words(1, 3)}</h3><ul>{self.links(2, 6)}</ul>", f"<h4>{self.words(1, 4)}</h4><p>{self.sentences(1, 5)}</p>", f"<p>{self.sentences(1, 3)}</p>"])
        return f'<{tag} data-y="0">{inner}</{tag.split()[0]}>'

    def notice(self) -> str:
        attribute = self.rng.choice([self.named("cookie", "cookie-notice", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal", "subscribe", "paywall", "disclaimer"), ' role="alert"', ' role="dialog"'])
        tag = self.rng.choice(["div", "section", "p", "dialog"])
        inner = self.sentences(1, 3) + self.maybe(0.5, " <button>OK</button>")
        return f'<{tag}{attribute} data-y="0">{inner if tag == "p" else self.rng.choice([inner, f"<p>{inner}</p>"])}</{tag}>'

    def form(self) -> str:
        return f'<form data-y="0"{self.maybe(0.5, self.named("search", "newsletter", "login", "signup"))}><label>{self.words(1, 4)}</label> <input type="text"> <select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button>{self.maybe(0.3, f"<p>{self.sentences(1, 2)}</p>")}</form>'

    def comments(self) -> str:
        tag = self.rng.choice(["section", "div", "div", "ol"])
        one = lambda: f'<{("li" if tag == "ol" else self.rng.choice(["div", "article", "p"]))}{self.maybe(0.7, self.named("comment", "comment-body", "reply"))}>{self.rng.choice([self.sentences(1, 6), self.words(1, 2) + ": " + self.sentences(1, 4)])}'
        close = {"li": "</li>", "div": "</div>", "article": "</article>", "p": "</p>"}
        body = ""
        for _ in range(self.rng.randint(1, 5)):
            made = one()
            name = made[1:].split(">")[0].split()[0]
            if name != "p" and self.rng.random() < 0.5:
                head, _, text = made.partition(">")
                made = f"{head}><p>{text}</p>"
            body += made + close[name]
        heading = self.maybe(0.6, f"<h3>{self.words(1, 3)}</h3>") if tag != "ol" else ""
        return f'<{tag}{self.named("comments", "comment-list", "discussion", "responses", "disqus_thread", "replies", "reader-comments")} data-y="0">{heading}{body}</{tag}>'

    def related(self) -> str:
        tag = self.rng.choice(["div", "section", "aside", "nav"])
        return f'<{tag}{self.named("related", "related-posts", "recommended", "more-stories", "share", "social", "tags", "breadcrumb", "breadcrumbs", "pagination", "pager")} data-y="0">{self.maybe(0.5, f"<h3>{self.words(1, 3)}</h3>")}<ul>{self.links(2, 6)}</ul></{tag}>'

    def boilerplate(self) -> str:
        return self.rng.choice([self.nav, self.header, self.footer, self.advert, self.advert, self.sidebar, self.notice, self.form, self.comments, self.related])()

    # main text

    def block(self) -> str:
        rng, text = self.rng, self.inline(self.sentences(1, 8))
        kind = rng.random()
        if kind < 0.62:
            return rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f'<p class="{rng.choice(["lead", "intro", "text", "p1"])}">{text}</p>'])
        if kind < 0.72:
            return f"<h{rng.randint(2, 4)}>{self.words(1, 6)}</h2>"
        if kind < 0.79:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.inline(self.sentences(1, 2))}</li>" for _ in range(rng.randint(1, 5))) + f"</{tag}>"
        if kind < 0.84:
            return f"<blockquote>{rng.choice([text, f'<p>{text}</p>'])}</blockquote>"
        if kind < 0.88:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.92:
            return f"<figure><img src=x><figcaption>{self.sentences(1, 1)}</figcaption></figure>"
        if kind < 0.95:
            return f"<pre><code>{self.words(2, 12)}</code></pre>"
        return rng.choice([f"<div>{text}</div>", f"<section><h2>{self.words(1, 5)}</h2><p>{text}</p></section>", text])

    def article(self) -> str:
        rng = self.rng
        body = self.maybe(0.8, rng.choice([f"<h1>{self.words(1, 12)}</h1>", f"<header><h1>{self.words(1, 12)}</h1></header>"]))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9, 15])):
            body += self.block()
            if rng.random() < 0.08:
                body += rng.choice([self.advert, self.related, self.sidebar, self.notice, self.form])()
        if not body:
            body = self.block()
        if rng.random() < 0.15:
            body += rng.choice([self.comments, self.related, self.form])()
        style = rng.random()
        names = ("content", "post", "post-content", "entry", "entry-content", "article", "article-body", "story", "main", "main-content", "page-content", "text", "body")
        if style < 0.45:
            return f'<article{self.maybe(0.3, self.named(*names))} data-y="1">{body}</article>'
        if style < 0.6:
            return f'<main data-y="1">{self.maybe(0.5, "<article>")}{body}</main>'
        if style < 0.92:
            return f'<{rng.choice(["div", "div", "section"])}{self.named(*names)} data-y="1">{body}</div>'
        return f'<div data-y="1">{body}</div>'

    def page(self) -> str:
        rng = self.rng
        before = "".join(self.boilerplate() for _ in range(rng.randint(0, 4)))
        after = "".join(self.boilerplate() for _ in range(rng.randint(0, 4)))
        middle = self.article()
        if rng.random() < 0.3:
            middle = f'<div{self.named("wrapper", "container", "page", "layout", "row")}>{middle}{self.maybe(0.5, self.sidebar())}</div>'
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{before}{middle}{after}</body></html>"


def labelled_pages(count: int = 500) -> list[str]:
    return [_Writer(number).page() for number in range(count)]
