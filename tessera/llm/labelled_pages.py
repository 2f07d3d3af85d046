"""Labelled pages to fit the block labeller on: made from templates by a seed, with the texts of their main blocks."""

from __future__ import annotations

import random

# Names that pages commonly give to their parts.
ADS = "ad ads advert advertisement banner promo sponsor sponsored".split()
MENUS = "menu nav navbar navigation breadcrumb breadcrumbs topnav tabs".split()
NOTICES = "cookie cookies notice consent alert popup newsletter subscribe gdpr".split()
SIDES = "sidebar side widget related recommended popular trending more-links".split()
COMMENTS = "comments comment-list commentlist discussion replies disqus respond responses thread feedback".split()
SHARES = "share social sharing share-buttons follow".split()
MAINS = "content main-content post post-content article article-body entry entry-content story body-text text".split()
#: The share of pages that have nothing but their article.
BARE = 0.2
SYLLABLES = "an ba ber ca con da de el en er fi ga ha in ka la le ma mi na no or pa ra re sa ta ti to un va wo ü é ó ß".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: set[str] = set()

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def prose(self, lo: int = 1, hi: int = 6) -> str:
        return " ".join(self.words(4, 18).capitalize() + self.r.choice("....!?") for _ in range(self.r.randint(lo, hi)))

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def named(self, names: list[str], tag: str = "div") -> tuple[str, str]:
        how = self.r.choice(["class", "class", "id"])
        return f'<{tag} {how}="{self.r.choice(names)}">', f"</{tag}>"

    def menu(self) -> str:
        items = "".join(f"<li>{self.link(self.words(1, 2))}</li>" for _ in range(self.r.randint(3, 9)))
        a, z = self.r.choice([("<nav>", "</nav>"), self.named(MENUS), ("<header>", "</header>"), self.named(MENUS, "nav")])
        return f"{a}<ul>{items}</ul>{z}"

    def header(self) -> str:
        return f"<header>{self.r.choice(['<h1>%s</h1>', '<p>%s</p>', '<div>%s</div>', '<h2>%s</h2>']) % self.words(1, 6)}{self.menu() if self.r.random() < 0.4 else ''}</header>"

    def ad(self) -> str:
        a, z = self.named(ADS, self.r.choice(["div", "div", "aside", "section"]))
        body = self.r.choice([self.words(2, 8), self.prose(1, 2), f"<p>{self.prose(1, 3)}</p>", self.link(self.words(2, 8))])
        return f"{a}{body}{z}"

    def notice(self) -> str:
        a, z = self.named(NOTICES)
        return f"{a}<p>{self.prose(1, 2)}</p>{'<button>' + self.words(1, 2) + '</button>' if self.r.random() < 0.5 else ''}{z}"

    def side(self) -> str:
        a, z = self.r.choice([("<aside>", "</aside>"), self.named(SIDES), self.named(SIDES, "aside"), self.named(SIDES, "section")])
        rows = "".join(self.r.choice([f"<li>{self.link(self.words(3, 9))}</li>", f"<p>{self.prose(1, 3)}</p>", f"<h3>{self.words(1, 4)}</h3>"]) for _ in range(self.r.randint(1, 6)))
        return f"{a}<h2>{self.words(1, 3)}</h2>{rows}{z}"

    def form(self) -> str:
        return f"<form action=/><label>{self.words(1, 3)}</label><input name=q><select><option>{self.word()}<option>{self.word()}</select><p>{self.words(2, 9)}</p><button>{self.word()}</button></form>"

    def comments(self) -> str:
        a, z = self.named(COMMENTS, self.r.choice(["div", "section", "ol"]))
        item = "li" if a.startswith("<ol") else "div"
        rows = "".join(f"<{item}><b>{self.word()}</b><p>{self.prose(1, 5)}</p></{item}>" for _ in range(self.r.randint(1, 6)))
        return f"{a}<h3>{self.words(1, 3)}</h3>{rows}{z}"

    def footer(self) -> str:
        a, z = self.r.choice([("<footer>", "</footer>"), ("<footer>", "</footer>"), self.named(["footer", "site-footer", "copyright", "bottom"])])
        body = self.r.choice([f"&copy; {self.word()} &middot; {self.prose(1, 3)}", self.prose(1, 2), f"<p>&copy; 2020 {self.words(1, 4)}</p><ul><li>{self.link(self.word())}</li></ul>", f"<p>{self.prose(1, 2)}</p>"])
        return a + body + z

    def kept(self, text: str) -> str:
        self.main.add(" ".join(text.split()))
        return text

    def article(self) -> str:
        r = self.r
        rows = [f"<h1>{self.kept(self.words(2, 9))}</h1>"] if r.random() < 0.8 else []
        if rows and r.random() < 0.15:
            rows = [f"<header>{rows[0]}</header>"]
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.6:
                text, close = self.kept(self.prose(1, 7)), r.choice(["</p>", "</p>", "</p>", ""])
                if r.random() < 0.15:
                    text = text.replace(" ", "<br>", 1) if r.random() < 0.5 else f"<b>{text}</b>"
                elif r.random() < 0.2:
                    first, _, rest = text.partition(" ")
                    text = f"{self.link(first)} {rest}" if rest else text
                rows.append(f"<p>{text}{close}")
            elif kind < 0.68:
                level = r.randint(2, 4)
                rows.append(f"<h{level}>{self.kept(self.words(1, 6))}</h{level}>")
            elif kind < 0.75:
                rows.append("<ul>" + "".join(f"<li>{self.kept(self.words(3, 14))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.8:
                rows.append(f"<blockquote>{self.kept(self.prose(1, 3))}</blockquote>")
            elif kind < 0.84:
                rows.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.kept(self.words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.88:
                rows.append(f"<pre>{self.kept(self.words(3, 15))}</pre>")
            elif kind < 0.92:
                rows.append(self.ad())
            elif kind < 0.96:
                a, z = self.named(SHARES)
                rows.append(a + " ".join(self.link(self.word()) for _ in range(3)) + z)
            else:
                rows.append(f"<p>{self.kept(self.words(1, 5))}</p>")
        if r.random() < 0.06:
            rows.insert(r.randrange(1, len(rows) + 1), f"<button>{self.words(1, 3)}</button>")
        if r.random() < 0.12:
            rows.append(self.comments())
        body = "".join(rows)
        wrap = r.random()
        if wrap < 0.45:
            return f"<article>{body}</article>"
        if wrap < 0.55:
            return f"<main>{body}</main>"
        if wrap < 0.65:
            a, z = self.named(MAINS)
            return f"<main><article>{a}{body}{z}</article></main>"
        if wrap < 0.9:
            a, z = self.named(MAINS, r.choice(["div", "div", "section"]))
            return a + body + z
        return f"<div>{body}</div>"

    def bare(self) -> str:
        """A page that is its article: few blocks, often one, with hardly a wrapper and nothing around it."""
        r = self.r
        text = lambda: self.kept(r.choice([self.prose(1, 3), self.prose(2, 9), self.words(1, 6), self.words(6, 40)]))
        rows = [f"<h{r.randint(1, 3)}>{self.kept(self.words(1, 8))}</h1>"] if r.random() < 0.35 else []
        for _ in range(r.choice([1, 1, 1, 2, 3, 5])):
            lines = text()
            kind = r.random()
            if kind < 0.15:
                lines = lines.replace(" ", "<br>", 1)
            rows.append(f"<div>{lines}</div>" if 0.15 < kind < 0.3 else lines + r.choice(["<hr>", "<h2></h2>"]) if kind > 0.85 else f"<p>{lines}</p>")
        body = "".join(rows)
        a, z = r.choice([("", ""), ("", ""), ("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<section>", "</section>"), (f'<div id="{self.word()}">', "</div>"), ("<main><article>", "</article></main>"), self.named(MAINS)])
        head = f"<head><title>{self.words(2, 9)}</title></head>" if r.random() < 0.4 else ""
        return r.choice([f"<!DOCTYPE html><html>{head}<body>{a}{body}{z}</body></html>", f"<html>{head}<body>{a}{body}{z}</body></html>", f"<body>{a}{body}{z}", a + body + z])

    def page(self) -> str:
        r = self.r
        if r.random() < BARE:
            return self.bare()
        some = lambda p, make: make() if r.random() < p else ""
        head = f"<head><meta charset=utf-8><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        before = [some(0.35, self.header), some(0.8, self.menu), some(0.15, self.notice), some(0.35, self.ad), some(0.1, self.form), some(0.2, self.side)]
        after = [some(0.3, self.comments), some(0.3, self.side), some(0.25, self.ad), some(0.1, self.notice), some(0.15, self.form), some(0.85, self.footer)]
        if r.random() < 0.2:
            r.shuffle(before)
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- {self.word()} -->{self.article()}{''.join(after)}" + r.choice(["</body></html>", "</body></html>", ""])


def labelled(n: int, seed: int = 5) -> list[tuple[str, set[str]]]:
    """`n` pages, each with the texts of its main blocks."""
    made = []
    for i in range(n):
        m = Maker(seed * 1_000_003 + i)
        made.append((m.page(), m.main))
    return made
