"""Labelled pages to train the page model on: layouts drawn at random, every block marked as content or not.

Each part of a page is a snippet of markup with its label. A snippet's text runs carry their label through a marker
character, which is taken off again once the page has been read.
"""

from __future__ import annotations

import random

from tonearm.llm.html import Node, tree

#: Marks text that is content; a private-use character that pages don't hold.
MARK = "\ue000"


def words(r: random.Random, low: int, high: int) -> str:
    made = ["".join(r.choice(("ka", "lo", "min", "ter", "sa", "vi", "no", "dre", "ul", "pes")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    return " ".join(made)


def sentence(r: random.Random, low: int = 4, high: int = 16) -> str:
    return words(r, low, high).capitalize() + r.choice((".", ".", ".", "!", "?", ""))


def prose(r: random.Random, low: int = 1, high: int = 6) -> str:
    return " ".join(sentence(r) for _ in range(r.randint(low, high)))


def attrs(r: random.Random, names: str, plain: float = 0.15) -> str:
    """A class or id out of ``names``, at times with an unrelated word or none at all."""
    if r.random() < plain:
        return ""
    name = r.choice(names.split())
    if r.random() < 0.3:
        name = r.choice((f"{name}-{r.choice(('box', 'wrap', 'inner', 'list', 'item', 'x1'))}", f"site-{name}", f"{name} c{r.randint(1, 9)}"))
    return f' {r.choice(("class", "class", "id"))}="{name}"'


def links(r: random.Random, low: int = 3, high: int = 9) -> str:
    n = r.randint(low, high)
    item = lambda: f'<a href="/{r.randint(1, 99)}">{words(r, 1, 3)}</a>'
    return r.choice((f"<ul>{''.join(f'<li>{item()}</li>' for _ in range(n))}</ul>", " ".join(item() for _ in range(n)), f"<p>{' | '.join(item() for _ in range(n))}</p>"))


def some(r: random.Random) -> str:
    """Text as it stands in boxes: bare, in paragraphs, or with a heading."""
    return r.choice((sentence(r), f"<p>{prose(r, 1, 3)}</p>", f"<h3>{words(r, 1, 4)}</h3><p>{prose(r, 1, 2)}</p>", f"<span>{sentence(r)}</span>", f"<h4>{words(r, 1, 3)}</h4>{links(r)}"))


def aside_parts(r: random.Random) -> list[str]:
    """Parts that are not content, each as one snippet."""
    div = lambda names, body, tags="div div section aside": f"<{(t := r.choice(tags.split()))}{attrs(r, names, 0.0)}>{body}</{t}>"
    comment = lambda: f"<{(t := r.choice(('div', 'li', 'article', 'section')))}{attrs(r, 'comment comment-body reply review', 0.0 if t == 'article' else 0.15)}><b>{words(r, 1, 2)}</b><p>{prose(r, 1, 4)}</p></{t}>"
    return [
        f"<nav{attrs(r, 'nav menu main-nav', 0.5)}>{links(r)}</nav>",
        f"<header{attrs(r, 'header masthead', 0.5)}>{r.choice((sentence(r, 1, 4), links(r), f'<h1>{words(r, 1, 3)}</h1><p>{sentence(r)}</p>'))}</header>",
        f"<footer{attrs(r, 'footer', 0.6)}>{r.choice(('&copy; ', '© 2024 ', ''))}{words(r, 1, 3)} {r.choice(('&middot; ', '- ', ''))}{prose(r, 1, 2)}{r.choice(('', links(r)))}</footer>",
        f"<aside{attrs(r, 'sidebar related', 0.5)}>{some(r)}</aside>",
        div("ad ads advert advertisement sponsored promo banner-ad", some(r)),
        div("cookie-notice cookie-banner consent notice alert gdpr popup", some(r)),
        div("sidebar widget related recommended popular side", some(r) + some(r)),
        div("menu navbar breadcrumb breadcrumbs pagination toolbar", links(r)),
        div("footer copyright legal bottom", some(r)),
        div("header topbar masthead", some(r)),
        div("share social tags byline meta", links(r, 2, 4)),
        div("newsletter subscribe signup login", some(r)),
        div("comments comment-list discussion responses reviews", f"<h3>{words(r, 1, 2)}</h3>" + "".join(comment() for _ in range(r.randint(1, 5)))),
        "".join(comment().replace("<div>", '<div class="comment">').replace("<li>", '<li class="comment">').replace("<article>", '<article class="comment">').replace("<section>", '<section class="comment">') for _ in range(r.randint(1, 3))),
        f"<ul>{''.join(f'<li><a href=#>{words(r, 1, 4)}</a></li>' for _ in range(r.randint(3, 9)))}</ul>",
        f'<div role="{r.choice(("navigation", "banner", "contentinfo", "complementary", "search", "alert"))}">{some(r)}</div>',
        f"<div hidden>{prose(r)}</div>",
        comment_list(r),
        form(r),
        f"<div{attrs(r, 'top bar links', 0.5)}>{r.choice(('', words(r, 1, 1) + ' '))}{' '.join(f'<a href=/{i}>{words(r, 1, 2)}</a>' for i in range(r.randint(1, 5)))}</div>",
        f'<p class="{r.choice(("notice", "copyright", "disclaimer", "advert", "share"))}">{sentence(r)}</p>',
    ]


def comment_list(r: random.Random) -> str:
    """Readers' comments as a list, at times under a heading and in a box that tells nothing."""
    item = lambda: f"<li{r.choice(('', attrs(r, 'comment reply')))}>{r.choice((f'<p>{prose(r, 1, 3)}</p>', prose(r, 1, 2), f'<b>{words(r, 1, 2)}</b><p>{prose(r, 1, 3)}</p>'))}</li>"
    name = r.choice(("commentlist", "comments", "comment-list", "comments-list", "replies", "discussion", "reviews"))
    made = f"{r.choice(('', f'<h3>{words(r, 1, 2)}</h3>'))}<{(t := r.choice(('ol', 'ul')))} class={name}>{''.join(item() for _ in range(r.randint(1, 5)))}</{t}>"
    return r.choice((made, made, f"<div>{made}</div>"))


def form(r: random.Random) -> str:
    """A form with fields, labels and at times a word of explanation."""
    field = lambda: r.choice((f"<label>{words(r, 1, 2).capitalize()}</label><input name=x>", f"<p>{words(r, 1, 3)} <input type=text></p>", f"<select><option>{words(r, 1, 1)}</select>", f"<label>{words(r, 1, 2)} <textarea></textarea></label>"))
    lead = r.choice(("", "", f"<h3>{words(r, 1, 4)}</h3>", f"<p>{sentence(r)}</p>", sentence(r)))
    return f"<form{attrs(r, 'search contact newsletter login form', 0.5)}>{lead}{''.join(field() for _ in range(r.randint(1, 4)))}{r.choice(('<button>Go</button>', '<input type=submit>', ''))}{r.choice(('', '', sentence(r)))}</form>"


def content_parts(r: random.Random) -> list[str]:
    """Paragraphs and other blocks of an article; their text carries the mark."""
    m = lambda text: MARK + text
    linked = f'{sentence(r)} <a href="/x">{words(r, 1, 4)}</a> {sentence(r)} <b>{words(r, 1, 2)}</b> <i>{words(r, 1, 3)}</i>'
    item = lambda: m(r.choice((sentence(r), linked, words(r, 1, 4))))
    return [
        f"<p>{m(prose(r))}</p>",
        f"<p>{m(prose(r, 1, 2))}</p>",
        f"<p>{m(linked)}</p>",
        f"<p>{m(words(r, 1, 3))}</p>",
        f"<p>{m(sentence(r))} <button>{words(r, 1, 1)}</button> {sentence(r)}</p>",
        f"<p><b>{m(sentence(r))}<br>",
        f"<{(h := r.choice(('h1', 'h2', 'h3', 'h4')))}>{m(words(r, 1, 9))}</{h}>",
        f"<blockquote>{r.choice((m(prose(r, 1, 2)), f'<p>{m(prose(r, 1, 2))}</p>'))}</blockquote>",
        f"<{(t := r.choice(('ul', 'ol')))}>{''.join(f'<li>{item()}</li>' for _ in range(r.randint(2, 6)))}</{t}>",
        f"<table><tr><th>{m(words(r, 1, 2))}</th><th>{m(words(r, 1, 2))}</th></tr><tr><td>{item()}</td><td>{item()}</td></tr></table>",
        f"<pre>{m(words(r, 3, 20))}</pre>",
        f"<figure><img src=x><figcaption>{m(sentence(r))}</figcaption></figure>",
        f"<div>{m(prose(r))}</div>",
        f'<p class="{r.choice(("lead", "intro", "text", "body"))}">{m(prose(r))}</p>',
        f"<dl><dt>{m(words(r, 1, 3))}</dt><dd>{m(prose(r, 1, 2))}</dd></dl>",
        f"<p><a href=/x>{m(words(r, 1, 8))}</a></p>",
        sources(r),
    ]


def sources(r: random.Random) -> str:
    """What an article was made of: links under a heading of its own."""
    n, t = r.randint(2, 4), r.choice(("ul", "ol"))
    return f"<h{n}>{MARK}{words(r, 1, 3)}</h{n}><{t}>{''.join(f'<li><a href=/{i}>{MARK}{words(r, 1, 6)}</a></li>' for i in range(r.randint(1, 5)))}</{t}>"


def page(r: random.Random) -> str:
    body = [r.choice(content_parts(r)) if r.random() < 0.5 else r.choice((f"<p>{MARK}{prose(r)}</p>",)) for _ in range(r.choice((1, 1, 2, 3, r.randint(1, 14), r.randint(1, 14), r.randint(1, 14), r.randint(1, 14))))]
    if r.random() < 0.8:
        body.insert(0, f"<h1>{MARK}{words(r, 1, 12)}</h1>")
    for _ in range(r.choice((0, 0, 0, 1, 2))):
        # Within an article something tells what isn't part of it; a bare list of links may be one of sources.
        body.insert(r.randint(0, len(body)), r.choice([x for x in aside_parts(r) if not x.startswith(("<ul>", "<div>"))]))
    inner = "".join(body)
    wrap = r.choice(("<article>%s</article>", "<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", "<div class='content'>%s</div>", "<div id=main><div class='post entry-content'>%s</div></div>", "<section class='story'>%s</section>", "<div>%s</div>", "<div><div>%s</div></div>", "%s"))
    if ("article" in wrap or "main" in wrap) and r.random() < 0.3:
        inner += sources(r)
    if "article" in wrap and r.random() < 0.5:
        # An article with a header and a footer of its own.
        head = r.choice(("", f"<header>{r.choice((f'<h1>{words(r, 1, 6)}</h1>', f'<h1>{words(r, 1, 6)}</h1><p>{words(r, 1, 4)}</p>', f'<p>{sentence(r)}</p>'))}</header>"))
        inner = f"{head}{inner}{r.choice(('', f'<footer>{r.choice((words(r, 1, 4), sentence(r), links(r, 2, 4)))}</footer>'))}"
    parts = aside_parts(r)
    before = "".join(r.choice(parts[:12]) for _ in range(r.randint(0, 4)))
    after = "".join(r.choice(parts) for _ in range(r.randint(0, 4)))
    if r.random() < 0.15:
        # Nothing but the article.
        before, after = "", ""
    core = wrap % inner
    if r.random() < 0.3:
        core = f"<div class='{r.choice(('wrapper', 'container', 'row', 'page', 'layout'))}'>{core}{r.choice(('', r.choice(parts)))}</div>"
    if r.random() < 0.1:
        # A table as layout: links in one cell, the article in another.
        cells = [f"<td>{' '.join(f'<a href=/{i}>{words(r, 1, 2)}</a>' for i in range(r.randint(2, 8)))}</td>", f"<td>{core}</td>", f"<td>{r.choice(parts)}</td>"]
        core = f"<table><tr>{''.join(cells[: r.randint(2, 3)])}</tr></table>"
    end = r.choice(("</body></html>", ""))
    whole = r.random()
    if whole < 0.08:
        core = f"<form method=post><input type=hidden name=s value=1>{core}</form>"
    elif whole < 0.16:
        before, after = f"<form id=f1 method=post><input type=hidden name=s value=1>{before}", f"{after}</form>"
    return f"<!DOCTYPE html><html><head><title>{words(r, 1, 6)}</title><style>p{{}}</style></head><body>{before}{core}{after}{end}"


def labelled(html: str) -> tuple[list[Node], list[int]]:
    """The page's nodes and labels: marked runs are content, and so is a block if any run in it is."""
    nodes = tree(html)
    y = [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].text is not None:
            y[i] = int(MARK in nodes[i].text)
            nodes[i].text = nodes[i].text.replace(MARK, "").strip() or "x"
        y[nodes[i].parent] |= y[i]
    return nodes, y


def labelled_pages(n: int, seed: int) -> list[tuple[list[Node], list[int]]]:
    r = random.Random(seed)
    return [labelled(page(r)) for _ in range(n)]
