"""Pages of templates that the labeller's own generator does not make, with their main text."""

import random

WORDS = "the river house under morning light walked many people city small garden question answer bread winter story long old road letter music paper school train water green field summer window table doctor market silent engine color night bridge coffee village winter mountain picture number season friend silver corner northern engine teacher".split()


def page(r: random.Random):
    """html, main text, template."""
    name = r.choice(sorted(TEMPLATES))
    said = lambda lo, hi: " ".join(r.choice(WORDS) for _ in range(r.randint(lo, hi))).capitalize()
    title = said(3, 8)
    paragraphs = [" ".join(said(6, 18) + "." for _ in range(r.randint(1, 5))) for _ in range(r.randint(2, 8))]
    link = lambda: f'<a href="/{r.randrange(999)}">{said(1, 2)}</a>'
    html = TEMPLATES[name](r, title, paragraphs, link, said)
    return html, "\n\n".join([title, *paragraphs]), name


def _p(paragraphs, tag="p"):
    return "".join(f"<{tag}>{x}</{tag}>" for x in paragraphs)


def bare(r, title, ps, link, said):
    return f"<html><head><title>{title} - {said(1, 2)}</title></head><body><h1>{title}</h1>{_p(ps)}</body></html>"


def bare_with_nav(r, title, ps, link, said):
    menu = "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 7)))
    return f"<body><nav><ul>{menu}</ul></nav><h1>{title}</h1>{_p(ps)}<footer><p>© 2021 {said(1, 3)}</p></footer></body>"


def layout_table(r, title, ps, link, said):
    menu = "<br>".join(link() for _ in range(r.randint(3, 8)))
    return f"<html><body><table width='100%' cellpadding='4'><tr><td bgcolor='#eee' width='150'>{menu}</td><td><h2>{title}</h2>{_p(ps)}</td></tr></table></body></html>"


def cells(r, title, ps, link, said):
    return f"<table><tr><td>{title}</td></tr>{''.join(f'<tr><td>{x}</td></tr>' for x in ps)}</table>"


def grid(r, title, ps, link, said):
    side = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 6)))
    return f"<body><div class='wrap'><div class='g-row'><div class='col-8'><h1>{title}</h1>{_p(ps)}</div><div class='col-4'><ul>{side}</ul></div></div></div></body>"


def hashed_names(r, title, ps, link, said):
    n = lambda: f"css-{r.randrange(16**6):06x}"
    menu = "".join(f"<div class='{n()}'>{link()}</div>" for _ in range(r.randint(3, 7)))
    return f"<div id='root'><div class='{n()}'>{menu}</div><div class='{n()}'><div class='{n()}'><h1 class='{n()}'>{title}</h1>{''.join(f'<p class={n()}>{x}</p>' for x in ps)}</div></div></div>"


def divs(r, title, ps, link, said):
    return f"<body><div><div><div>{title}</div>{_p(ps, 'div')}</div></div></body>"


def header_footer(r, title, ps, link, said):
    return f"<body><header>{said(1, 3)} {link()}</header><div class='outer'><section><h1>{title}</h1>{_p(ps)}</section></div><aside><h3>{said(1, 2)}</h3><p>{link()}</p></aside><footer>© {said(2, 4)} · {link()}</footer></body>"


def advert_between(r, title, ps, link, said):
    at = r.randrange(1, len(ps))
    return f"<body><div class='shell'><h1>{title}</h1>{_p(ps[:at])}<div class='advertisement'><p>{said(4, 12)}</p></div>{_p(ps[at:])}</div><div class='cookie-bar'>{said(4, 9)} <button>OK</button></div></body>"


def comments_below(r, title, ps, link, said):
    below = "".join(f"<div class='comment'><p>{said(4, 20)}.</p></div>" for _ in range(r.randint(1, 4)))
    return f"<body><div class='lhs'><h1>{title}</h1>{_p(ps)}</div><div id='comments'><h3>{said(1, 2)}</h3>{below}</div></body>"


TEMPLATES = {f.__name__: f for f in (bare, bare_with_nav, layout_table, cells, grid, hashed_names, divs, header_footer, advert_between, comments_below)}
