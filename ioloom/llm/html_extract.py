"""HTML main-text extraction by a linear-chain conditional random field over leaf blocks.

A block's features are its ancestors' tags, the groups of words in their classes, ids and roles, and
its text: length, share of links, ending, marks. Labels are main text or not. The model has a weight for each feature
and for each pair of neighbouring labels, is fitted to the likelihood of labelled pages, and is
decoded by Viterbi.

Labelled pages are a bounded sample of the pages themselves (TRAIN_PAGES at most, those first by a
hash of the id), a block being main text if it is in an article element; and, as pages use one or two layouts,
the same texts set again in other layouts with known labels. Pages are labelled where they lie; a step of the fit
sums gradients over tasks, so the driver holds vectors of the fixed features only.

Defined results: null and empty html give an empty text; very long pages are read, labelled and decoded whole, in linear
time (in training, one of more than CHAIN blocks is several chains); with no labelled page to learn from, blocks in an
article or main element are main text; repeated rows get equal texts; an empty table gives no rows; columns other than
those named are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ioloom.llm.base import discarded, written
from ioloom.llm.dom_blocks import Block, Node, blocks

TRAIN_PAGES, LAYOUTS, STEPS = 240, 4, 120
#: Blocks of a training chain, chains summed at once, files of the training set.
CHAIN, CHAINS, PARTS = 512, 64, 8

# Words in classes, ids and roles, by what they say of an element.
GROUPS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager skip tabs links",
    "header": "header masthead topbar logo branding banner hero",
    "footer": "footer foot copyright colophon contentinfo legal bottom",
    "sidebar": "sidebar aside side widget widgets rail related recommended popular trending complementary more",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay dialog subscribe newsletter signup paywall message",
    "advert": "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion promoted",
    "form": "form search login contact input poll survey",
    "comments": "comment comments commentlist reply replies respond disqus discussion feedback reader readers responses",
    "share": "share sharing social follow like tags byline meta",
    "hidden": "hidden",
    "main": "content article post entry story main body text prose",
}
_GROUP_OF = {w: g for g, ws in GROUPS.items() for w in ws.split()}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that say what they hold.
TELLING = frozenset("nav header footer aside form article main section ul ol li dl table figure figcaption button label select option textarea fieldset dialog details summary blockquote pre menu address h1 h2 h3 h4 h5 h6 p td body".split())


def groups_of(words: str) -> dict[str, None]:
    """The groups of the words, in their order."""
    return dict.fromkeys(g for w in _WORD.findall(words) if (g := _GROUP_OF.get(w.lower())))


#: Elements that say what part of a page they hold.
REGIONS = ("nav", "header", "footer", "aside", "form", "article", "main")
#: Groups of elements that aren't main text.
APART = frozenset(GROUPS) - {"share", "main"}
FEATURES = ["bias", "ends", "marks", *(f"in:{t}" for t in sorted(TELLING)), *(f"group:{g}" for g in GROUPS), *(f"own:{t}" for t in (*sorted(TELLING), "none", "other")), *(f"inner:{x}" for x in ("", *REGIONS, *(g for g in GROUPS if g not in REGIONS))), *(f"words:{i}" for i in range(7)), *(f"linked:{i}" for i in range(4))]
_PLACE = {x: i for i, x in enumerate(FEATURES)}


@dataclass(frozen=True)
class _Said:
    """What an element and its ancestors say: features, the innermost region or group, groups of their tags and words."""

    features: frozenset[str] = frozenset()
    inner: str = ""
    groups: frozenset[str] = frozenset()


def said(node: Node | None) -> _Said:
    """Derived once an element, from its parent's."""
    way = []
    while node is not None and node.said is None:
        way.append(node)
        node = node.parent
    now = _Said() if node is None else node.said
    for n in reversed(way):
        groups = groups_of(n.words)
        new = {f"group:{g}" for g in groups} | ({f"in:{n.tag}"} if n.tag in TELLING else set())
        inner = next(reversed(groups), n.tag if n.tag in REGIONS else now.inner)
        now = n.said = _Said(now.features | new, inner, now.groups | groups.keys() | groups_of(n.tag).keys())
    return now


def features(block: Block) -> list[int]:
    """The block's features, as places in FEATURES."""
    about, n = said(block.node), len(block.text.split())
    own = "none" if block.node is None else block.node.tag if block.node.tag in TELLING else "other"
    out = {"bias", *about.features, f"own:{own}", f"inner:{about.inner}", f"words:{min(6, n.bit_length())}", f"linked:{min(3, 4 * block.link_chars // max(1, len(block.text)))}"}
    if block.text[-1:] in ".!?…\"'»”":
        out.add("ends")
    if "©" in block.text or "|" in block.text:
        out.add("marks")
    return sorted(_PLACE[x] for x in out)


@dataclass
class Crf:
    state: np.ndarray  # score of main text minus that of other text, by feature
    step: np.ndarray  # 2 x 2, by label and next label

    def decode(self, of_blocks: list[list[int]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        state, ((stay0, to1), (to0, stay1)) = self.state.tolist(), self.step.tolist()
        s0, s1, back = 0.0, 0.0, []
        for i, f in enumerate(of_blocks):
            if i:
                a0, a1, b0, b1 = s0 + stay0, s1 + to0, s0 + to1, s1 + stay1
                back.append((int(a1 > a0), int(b1 >= b0)))
                s0, s1 = max(a0, a1), max(b0, b1)
            s1 += sum(state[x] for x in f)
        y = [int(s1 > s0)] if of_blocks else []
        for pointer in reversed(back):
            y.append(pointer[y[-1]])
        return y[::-1]


def packed(chains: list[tuple[list[list[int]], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labelled chains as arrays: each feature's place in the table of chains by blocks, the feature, the labels, the lengths."""
    size = np.array([len(ys) for _, ys in chains], "<i4")
    longest = int(size.max())
    row = np.concatenate([np.full(len(f), i * longest + t, "<i4") for i, (fs, _) in enumerate(chains) for t, f in enumerate(fs)])
    col = np.array([x for fs, _ in chains for f in fs for x in f], "<i2")
    return row, col, np.array([k for _, ys in chains for k in ys], "<i1"), size


def chain_sums(row: np.ndarray, col: np.ndarray, labels: np.ndarray, size: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """(log-likelihood, its gradient) of packed chains: forward-backward over all at once."""
    n, longest = len(size), int(size.max())
    real = np.arange(longest) < size[:, None]
    y = np.zeros((n, longest), int)
    y[real] = labels
    pair = real[:, 1:]
    w, step = theta[:-4], theta[-4:].reshape(2, 2)
    e = np.zeros((n, longest, 2))
    e[..., 1] = np.bincount(row, w[col], minlength=n * longest).reshape(n, longest)
    forward, backward = e.copy(), np.zeros_like(e)
    for k in range(1, longest):
        forward[:, k] += np.logaddexp.reduce(forward[:, k - 1, :, None] + step, axis=1)
    for k in range(longest - 2, -1, -1):
        inside = np.logaddexp.reduce(step + (e[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
        backward[:, k] = np.where(real[:, k + 1, None], inside, 0)
    total = np.logaddexp.reduce(forward[np.arange(n), size - 1], axis=1)
    p1 = np.exp(forward[..., 1] + backward[..., 1] - total[:, None]) * real
    pairs = np.exp(forward[:, :-1, :, None] + step + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pair[..., None, None]
    seen = np.array([[(pair & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    likelihood = (e[..., 1] * y * real).sum() + (seen * step).sum() - total.sum()
    gap = ((y - p1) * real).ravel()
    return float(likelihood), np.concatenate([np.bincount(col, gap[row], minlength=len(w)), (seen - pairs.sum(axis=(0, 1))).ravel()])


_PACKED = {"row_": "<i4", "col_": "<i2", "labels": "<i1", "size_": "<i4"}
_PACKED_SCHEMA = ", ".join(f"{c} binary" for c in _PACKED)


def _step_sums(batches, theta: np.ndarray):
    """One row a task: its chains' number and gradient."""
    n, g = 0, np.zeros_like(theta)
    for batch in batches:
        for r in batch.to_pylist():
            arrays = [np.frombuffer(r[c], kind) for c, kind in _PACKED.items()]
            n, g = n + len(arrays[-1]), g + chain_sums(*arrays, theta)[1]
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([g.tobytes()], pa.binary())], names=["n", "g"])


def fit_crf(chains: DataFrame, steps: int = STEPS, decay: float = 0.02) -> Crf:
    """Maximum likelihood with a Gaussian prior by Adam steps over packed chains."""
    context = chains.sparkSession.sparkContext
    theta = np.zeros(len(FEATURES) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        shared = context.broadcast(theta)
        sums = chains.mapInArrow(lambda batches, shared=shared: _step_sums(batches, shared.value), "n bigint, g binary").toArrow().to_pylist()
        shared.destroy()
        g = (decay * theta - sum(np.frombuffer(r["g"]) for r in sums)) / sum(r["n"] for r in sums)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.15 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Crf(theta[:-4], theta[-4:].reshape(2, 2))


def _relaid(main: list[str], rest: list[str], rng: random.Random) -> str:
    """A page that sets main texts and others in some other layout, with data-main labels."""
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    both = rest + main
    some = lambda k: [esc(rng.choice(both)) for _ in range(rng.randint(1, k))]
    short = lambda: " ".join(esc(rng.choice(both)).split()[: rng.randint(1, 4)])
    paras = lambda k: "".join(f"<p>{t}</p>" for t in some(k))
    name = lambda g: rng.choice([w for w in GROUPS[g].split() if w != "body"])
    wrap = lambda tag, group, inside: f'<{tag}{rng.choice([f""" class="{name(group)}\"""", f""" id="{name(group)}\"""", f""" class="x-{name(group)} y\""""])} data-main="0">{inside}</{tag}>'
    plain = lambda tag, inside: f'<{tag} data-main="0">{inside}</{tag}>'
    items = lambda: "<ul>" + "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"
    extra = {
        "menu": lambda: rng.choice([plain("nav", items()), wrap("div", "menu", items()), wrap("ul", "menu", f"<li>{short()}</li>")]),
        "header": lambda: rng.choice([plain("header", rng.choice([f"<h1>{short()}</h1>", f"<p>{short()}</p>", items()])), wrap("div", "header", short())]),
        "footer": lambda: rng.choice([plain("footer", rng.choice([paras(2), f"© {short()}"])), wrap("div", "footer", paras(2))]),
        "sidebar": lambda: rng.choice([plain("aside", rng.choice([items(), paras(3)])), wrap("div", "sidebar", rng.choice([items(), paras(3), f"<h3>{short()}</h3>{paras(2)}"]))]),
        "notice": lambda: wrap(rng.choice(["div", "section", "p"]), "notice", rng.choice(some(2))),
        "advert": lambda: wrap(rng.choice(["div", "section", "p", "aside"]), "advert", rng.choice(some(2))),
        "form": lambda: rng.choice([plain("form", f"<label>{short()}</label><button>{short()}</button><p>{short()}</p>"), wrap("div", "form", f"<form><p>{short()}</p><button>{short()}</button></form>")]),
        "comments": lambda: wrap(rng.choice(["div", "section", "ol", "ul"]), "comments", rng.choice([paras(5), f"<h2>{short()}</h2>{paras(4)}", "".join(f"<li><p>{t}</p></li>" for t in some(4)), "".join(f'<div class="{name("comments")}">{t}</div>' for t in some(4)), f"<article><p>{short()}</p>{paras(3)}</article>"])),
        "share": lambda: wrap("div", "share", short()),
        "hidden": lambda: wrap("div", "hidden", paras(2)),
    }
    body = [f"<h1>{esc(main[0])}</h1>", *[f"<{t}>{esc(x)}</{t}>" for x in main[1:] for t in [rng.choice(["p"] * 12 + ["h2", "blockquote", "li", "div", "h3", "td", "pre"])]]]
    for kind in rng.sample(["advert", "sidebar", "notice", "share", "form", "menu", "comments", "hidden"], rng.randint(0, 3)):
        body.insert(rng.randint(1, len(body)), extra[kind]())
    tag, word = rng.choice([("article", ""), ("article", name("main")), ("main", ""), ("div", name("main")), ("section", name("main")), ("div", "x")])
    inside = f'<{tag}{f""" class="{word}\"""" if word else ""} data-main="1">{"".join(body)}</{tag}>'
    before = [extra[k]() for k in rng.sample(["menu", "header", "notice", "advert", "form", "sidebar"], rng.randint(0, 4))]
    after = [extra[k]() for k in rng.sample(["comments", "sidebar", "footer", "advert", "notice", "share", "form", "menu"], rng.randint(0, 5))]
    page = "".join([*before, inside, *after])
    return "<html><body>" + (f"<div>{page}</div>" if rng.random() < 0.3 else page) + "</body></html>"


def _labelled(batches):
    """Each sampled page, and LAYOUTS new layouts of its texts, as packed chains, CHAINS a row, the like in length together."""
    held: list[tuple[list[list[int]], list[int]]] = []

    def flush():
        held.sort(key=lambda c: len(c[1]))
        arrays = packed(held[:CHAINS])
        del held[:CHAINS]
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=list(_PACKED))

    for batch in batches:
        for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = blocks(page)
            y = [int("in:article" in said(b.node).features and not said(b.node).groups & APART) for b in found]
            main, rest = [b.text for b, k in zip(found, y, strict=True) if k], [b.text for b, k in zip(found, y, strict=True) if not k]
            if not main:
                continue
            rng = random.Random(key)
            again = [blocks(_relaid(main, rest or main[:1], rng)) for _ in range(LAYOUTS)]
            for bs, labels in [(found, y), *((bs, [b.label or 0 for b in bs]) for bs in again)]:
                held += [([features(b) for b in bs[i : i + CHAIN]], labels[i : i + CHAIN]) for i in range(0, len(bs), CHAIN)]
            while len(held) >= 4 * CHAINS:
                yield flush()
    while held:
        yield flush()


def fit(pages: DataFrame, size: int = TRAIN_PAGES, id_col: str = "page_id", html_col: str = "html") -> Crf | None:
    """The model of a bounded sample of pages; None without any labelled page.

    The hashes of the sample, size at most, are ordered and broadcast; pages themselves aren't. Equal pages are one.
    """
    hashed = pages.filter(F.col(html_col).isNotNull()).select(F.xxhash64(id_col, html_col).alias("h"), F.col(html_col).alias("page"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(size)
    sampled = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("page").alias("page")).repartition(PARTS, "h").sortWithinPartitions("h")
    chains = written(sampled.mapInArrow(_labelled, _PACKED_SCHEMA), "pages-labelled")
    model = fit_crf(chains) if chains.limit(1).count() else None
    discarded(chains)
    return model


def main_text(page: str | None, model: Crf | None) -> str:
    found = blocks(page)
    y = model.decode([features(b) for b in found]) if model else [int(not said(b.node).features.isdisjoint({"in:article", "in:main"})) for b in found]
    return "\n".join(b.text for b, k in zip(found, y, strict=True) if k)


def _extracted(batches, model: Crf | None):
    for batch in batches:
        texts = [main_text(p, model) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:2], "text", "n_chars"])


def extract(pages: DataFrame, model: Crf | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(lambda batches: _extracted(batches, shared.value), f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")
