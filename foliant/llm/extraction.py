"""Main text of web pages with a suffix array over each host.

A small scanner cuts a page into blocks. Paragraphs and headings inside the article element are its prose. What elements and roles name as menu, header, footer, sidebar, notice,
advert, form or comment is out, and so is, where a page has an article, what stands outside it. What only a word in a class or id names so is named: the host's
array judges it, and what it doesn't find repeated (comments, say) goes by its name, unless `names` is off. All else is open: blocks of
pages without an article, and loose blocks inside one. Open blocks are judged by the host: substrings of LENGTH tokens or more that stand on LEAST distinct
pages of it or more are boilerplate; covered tokens go, unique runs stay.

The array reads all blocks that aren't prose, also those that are out: a menu that an out block shows is then known where it stands open on another page.
Of prose it reads what may be a template inside articles: paragraphs (each as a run of its own) that stand on LEAST distinct pages and on more than half of
the host's, but for the longest of a page.

A host's distinct pages are dealt into parts of about SHARD, so that the largest host is many groups. In each part a suffix array orders all suffixes
by their first LENGTH tokens and counts the pages of each run; the counts of equal runs (by a 64-bit hash) are summed over the host's parts, so SHARD
changes no result.

Pages with the same blocks count once, and copies of an article aren't boilerplate: a run goes only if it stands beside LEAST different texts. The text that a
page has beside a run is its longest paragraph, or without prose its stretch of LENGTH tokens that the fewest pages share (the first of these), if fewer share it
than share the run. So a template goes however short the page's own text is; an article on several pages without markup stays where they differ from each other by
less than LENGTH tokens in a row, or in less than LEAST ways.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import divided, drop_table, map_texts, ship, table

LENGTH, LEAST, SHARD = 8, 3, 400

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|textarea|iframe|select|title)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9]*+)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^<>]*>",  # a tag ends at the next <, so broken ones cost no more
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
#: Elements that never hold main text.
_DROPPED = frozenset("nav footer aside form head button menu dialog object embed canvas map audio video".split())
#: Roles that say the same.
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
#: Words in classes and ids that say the same: of them, those in the second line may be a part of an article when they stand inside it.
_NAMES = frozenset("ad ads advert adverts advertisement advertisements advertising comment comments footer menu nav navbar navigation sidebar".split())
_OUTSIDE = frozenset("banner consent cookie cookies header masthead notice notices".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby rt rp s samp small span strike "
    "strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Inside an article these are its text.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())


PROSE, OPEN, OUT, NAMED = 0, 1, 2, 3


def _out(attrs: str, inside: bool) -> int:
    """OUT if an element's role says that it holds no main text, NAMED if a word in its class or id does, else 0."""
    names, found = _NAMES if inside else _NAMES | _OUTSIDE, 0
    for m in _ATTRIBUTE.finditer(attrs):
        words = re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())
        if m[1].lower() == "role" and not _ROLES.isdisjoint(words):
            return OUT
        if m[1].lower() != "role" and not names.isdisjoint(words):
            found = NAMED
    return found


def blocks_of(page: str) -> list[tuple[str, int]]:
    """The blocks of a page in order: text, and whether it is prose, open, out by its element, role or place, or named by a class or id (what is out inside it, too)."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    skip, depth, inside, prose, why = "", 0, 0, "", OUT

    def flush():
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append((text, why if skip else PROSE if inside and prose else OPEN, inside > 0 and not skip))

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if not (tag := (m["tag"] or "").lower()) or tag in _INLINE:
            continue
        close = bool(m["close"])
        if skip:
            flush()
            if tag in ("article", "main") and not close and not _out(m["attrs"], False):
                skip = ""  # whatever was open before it is over
            else:
                if tag == skip:
                    depth += -1 if close else 1
                    if not depth:
                        skip = ""
                continue
        flush()
        if tag in ("article", "main"):
            if not close and (said := _out(m["attrs"], inside > 0)):
                skip, depth, why = tag, 1, said
            else:
                inside, prose = max(0, inside + (-1 if close else 1)), ""
        elif tag in _PROSE:
            prose = "" if close else tag
        elif tag == "br":
            pass
        elif not close and tag not in _VOID and tag not in ("html", "body"):
            if said := OUT if tag in _DROPPED or tag == "header" and not inside else _out(m["attrs"], inside > 0):
                skip, depth, why = tag, 1, said
            else:
                prose = ""
        if tag in _PROSE and not close and (said := _out(m["attrs"], inside > 0)):
            skip, depth, why = tag, 1, said
    parts.append(page[at:])
    flush()
    article = any(b[2] for b in out)  # an article with text: what stands outside isn't it
    return [(text, OUT if article and not within and state != NAMED else state) for text, state, within in out]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def ordered_runs(tokens: np.ndarray, page: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of at least `length` tokens in the order of their first `length`, the number of each one's run, and the distinct pages of each run.

    The suffix array is built by prefix doubling: ranks of the first 1, 2, 4 ... tokens, until `length` tokens order the suffixes. Suffixes that reach over
    the end of their page are left out.
    """
    n = len(tokens)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    rank, span = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while span < length:
        step = min(span, length - span)
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + later + 1, return_inverse=True)[1].astype(np.int64)
        span += step
    ends = np.searchsorted(page, page, "right")
    ok = np.arange(n) + length <= ends
    suffixes = np.lexsort((page, rank))
    suffixes = suffixes[ok[suffixes]]
    r, p = rank[suffixes], page[suffixes]
    if not len(r):
        return none, none, none
    new_rank = np.concatenate([[True], r[1:] != r[:-1]])
    new_page = new_rank | np.concatenate([[True], p[1:] != p[:-1]])
    group = np.cumsum(new_rank) - 1
    return suffixes, group, np.bincount(group, weights=new_page).astype(np.int64)


def _covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n tokens are in a run that begins at one of the starts."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + length, -1)
    return np.cumsum(cover[:-1]) > 0


def repeated(tokens: np.ndarray, page: np.ndarray, length: int = LENGTH, least: int = LEAST) -> np.ndarray:
    """Which tokens are in a substring of `length` tokens or more that stands on `least` pages or more."""
    suffixes, group, pages = ordered_runs(tokens, page, length)
    return _covered(suffixes[pages[group] >= least], len(tokens), length)


def _tokens(streams: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed tokens of some streams, one stream after another, the row of each, and the state of its block."""
    words = [p.split(" ") for pieces in streams["pieces"] for p in pieces]
    size = np.array([len(w) for w in words], np.int64)
    flat = np.array([w for ws in words for w in ws], object)
    tokens = pd.util.hash_array(flat, categorize=True) if len(flat) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(streams)), [len(x) for x in streams["pieces"]])
    state = np.array([x for states in streams["states"] for x in states], np.int64)
    return tokens, np.repeat(row, size), np.repeat(state, size)


def _run_names(host: int, tokens: np.ndarray, length: int) -> np.ndarray:
    """The name of the run of `length` tokens at each place that has one: a hash of host and tokens, the same in every part."""
    n = max(0, len(tokens) - length + 1)
    h = np.full(n, np.uint64(int(host) % 2**64), np.uint64)
    for j in range(length):
        h = (h ^ tokens[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _counts(key: tuple, streams: pd.DataFrame, length: int) -> pd.DataFrame:
    """The runs of a part of a host and on how many of its streams each stands."""
    tokens, page, _ = _tokens(streams)
    suffixes, group, pages = ordered_runs(tokens, page, length)
    first = np.searchsorted(group, np.arange(len(pages)))
    return pd.DataFrame({"host": key[0], "part": key[1], "run": _run_names(key[0], tokens, length)[suffixes[first]], "pages": pages})


def _starts(host: int, tokens: np.ndarray, page: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin, and their names."""
    names = _run_names(host, tokens, length)
    starts = np.flatnonzero(page[: len(names)] == page[length - 1 :]) if len(names) else np.zeros(0, np.int64)
    return starts, names[starts]


def _beside(key: tuple, streams: pd.DataFrame, runs: pd.DataFrame, length: int, least: int) -> pd.DataFrame:
    """For each repeated run of a part the texts (hashes) that it stands beside, `least` at most: more tell no more."""
    tokens, page, _ = _tokens(streams)
    starts, names = _starts(key[0], tokens, page, length)
    if not len(starts):
        return pd.DataFrame({"run": np.zeros(0, np.int64), "text": np.zeros(0, np.int64)})
    n = np.zeros(len(tokens) + length, np.int64)  # pages of the run that begins at a token
    n[starts] = pd.Series(runs["n"].to_numpy(), runs["run"].to_numpy(np.int64)).reindex(names, fill_value=0)
    shared = np.max([np.concatenate([np.zeros(j, np.int64), n[: len(tokens) - j]]) for j in range(length)], axis=0)
    stretch = np.max([shared[starts + j] for j in range(length)], axis=0)
    order = np.lexsort((starts, stretch, page[starts]))
    own = order[np.searchsorted(page[starts], np.arange(len(streams)))[page[starts]]]  # of each run, its page's stretch that the fewest share
    pages, text = stretch[own], names[own]
    prose = streams["own_pages"].to_numpy(np.int64)[page[starts]]  # 0: the page has no prose
    pages, text = np.where(prose > 0, prose, pages), np.where(prose > 0, streams["own"].to_numpy(np.int64)[page[starts]], text)
    lesser = n[starts] > pages
    found = pd.DataFrame({"run": names[lesser], "text": text[lesser]}).drop_duplicates()
    return found.groupby("run").head(least)


def _cuts(key: tuple, streams: pd.DataFrame, runs: pd.DataFrame, length: int) -> pd.DataFrame:
    """Of each stream of a part of which tokens go that aren't out anyway: numbers of the first one and of the one behind the last, for each stretch."""
    tokens, page, state = _tokens(streams)
    starts, names = _starts(key[0], tokens, page, length)
    gone = _covered(starts[np.isin(names, runs["run"].to_numpy(np.int64))], len(tokens), length)
    at, cuts = np.searchsorted(page, np.arange(len(streams) + 1)), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        some = (gone[a:b] & (state[a:b] != OUT) & (state[a:b] != NAMED)).any()
        cuts.append(np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8))).tolist() if some else [])
    out = pd.DataFrame({"host": key[0], "page": streams["page"], "prose": streams["prose"], "cut": cuts})
    return out[out["cut"].map(len) > 0]


def _remaining(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Texts of pages without the tokens that go."""
        for pages in batches:
            texts = []
            for text, pieces, cut, prose in zip(pages["text"], pages["pieces"], pages["cut"], pages["prose"], strict=True):
                cut = [] if cut is None else list(cut)
                stays = lambda k: bisect_right(cut, k) % 2 == 0  # noqa: B023, E731
                judged = {p["at"]: p for p in pieces} | dict.fromkeys([] if prose is None else prose)
                kept, lines, i, at = [], iter(text.split("\n") if text else ()), 0, 0
                left = text.count("\n") + 1 if text else 0
                while left or judged:
                    if at not in judged:
                        kept.append(next(lines))
                        left -= 1
                    elif (p := judged.pop(at)) is None:
                        line = next(lines)
                        left -= 1
                        kept += [line] * stays(i)
                        i += length
                    else:
                        words = p["piece"].split(" ")
                        if p["state"] == OPEN:
                            next(lines)
                            left -= 1
                            kept.append(" ".join(w for k, w in enumerate(words, i) if stays(k)))
                        i += len(words)
                    at += 1
                texts.append("\n".join(x for x in kept if x))
            yield pages.assign(text=texts)[["page_id", "url", "text"]]

    return run


def main_text(pages: DataFrame, length: int = LENGTH, least: int = LEAST, shard: int = SHARD, names: bool = True) -> DataFrame:
    """page_id, url and the text of each row of pages. names: whether classes and ids say what goes; else the host judges those blocks like other open ones.

    A null or empty html has an empty text; a null url is a host of its own (""). Repeated rows get the same text. An empty table gives an empty one. Other
    columns aren't read. Pages are shuffled as hashes of their blocks and with their words outside articles; whole texts only of pages from which the host takes words.
    """
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.xxhash64(host_of(F.col("url"))).alias("host"))
    kind = "`text` string, `page` long, `paragraphs` array<struct<at:int,hash:long,size:int>>, `pieces` array<struct<at:int,piece:string,state:int>>"
    rows = table(map_texts(source, "html", ["page_id", "url", "host"], kind, lambda texts: _parsed(texts, names)), "blocks")
    cuts = _judged(_streams(rows, length, least, shard), length, least)
    whole = F.xxhash64("host", "page")
    stay, maybe = divided(rows, whole, cuts.select(whole.alias("k1")))
    schema = rows.select("page_id", "url", "text").schema
    judged = maybe.join(cuts, ["host", "page"], "left").select("page_id", "url", "text", "pieces", "cut", "prose").mapInPandas(_remaining(length), schema)
    return stay.select("page_id", "url", "text").unionByName(judged).withColumn("n_chars", F.length("text").cast("long"))


def _streams(rows: DataFrame, length: int, least: int, shard: int) -> DataFrame:
    """What the array reads of each distinct page of a host: its `part` of the host, `pieces` (words of blocks) and their `states`, `prose` (places of the paragraphs among them), own (hash of its longest paragraph, which isn't) and own_pages (0 without prose)."""
    prose = rows.select("host", "page", F.explode("paragraphs").alias("b")).select("host", "page", "b.at", "b.hash", "b.size")
    sizes = table(rows.groupBy("host").agg(F.count_distinct("page").alias("all")), "sizes")
    counts = prose.groupBy("host", "hash").agg(F.count_distinct("page").alias("pages"))
    counts = counts.join(sizes, "host").withColumn("often", (F.col("pages") >= least) & (2 * F.col("pages") > F.col("all"))).drop("all")
    marked = prose.join(counts, ["host", "hash"])
    runs = F.concat_ws(" ", *[F.concat(F.lit(f"\u0002{j}:"), "hash") for j in range(length)])  # such a paragraph is a run of tokens of its own
    longest = table(marked.groupBy("host", "page").agg(F.max_by(F.struct("hash", "pages"), F.struct("size", "at")).alias("own")), "longest")
    others = marked.where("often").join(longest, ["host", "page"]).where(F.col("hash") != F.col("own.hash"))
    templates = others.select("host", "page", "at", runs.alias("piece"), F.lit(PROSE).alias("state"))
    words = rows.select("host", "page", F.explode("pieces").alias("b")).select("host", "page", "b.at", "b.piece", "b.state")
    listed = words.unionByName(templates).groupBy("host", "page").agg(F.array_sort(F.collect_set(F.struct("at", "piece", "state"))).alias(
        "p"))  # no more than a page has
    out = listed.join(longest, ["host", "page"], "left").join(sizes, "host")
    return out.select(
        "host", F.pmod(F.xxhash64("page"), F.ceil(F.col("all") / shard)).alias("part"), "page", F.col("p.piece").alias("pieces"),
            F.col("p.state").alias("states"),
        F.transform(F.filter("p", lambda x: x["state"] == PROSE), lambda x: x["at"]).alias("prose"),
            F.coalesce("own.hash", F.lit(0).cast("long")).alias("own"), F.coalesce("own.pages", F.lit(0).cast("long")).alias("own_pages"),
    )


def _runs(streams: DataFrame, length: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The streams, and for each part of a host the runs that go and stand in it, as tables."""
    ship(streams.sparkSession)
    parts = table(streams, "streams")
    by = lambda df: df.groupBy("host", "part")
    counted = table(by(parts).applyInPandas(lambda key, p: _counts(key, p, length), "host long, part long, run long, pages long"), "counts")
    total = counted.groupBy("run").agg(F.sum("pages").alias("n")).where(F.col("n") >= least)
    often = table(counted.drop("pages").join(total, "run"), "runs")
    drop_table(counted)
    beside = by(parts).cogroup(by(often)).applyInPandas(lambda key, p, r: _beside(key, p, r, length, least), "run long, text long")
    goes = table(beside.groupBy("run").agg(F.count_distinct("text").alias("texts")).where(F.col("texts") >= least).select("run"), "goes")
    going = table(often.join(goes, "run", "left_semi"), "going")
    drop_table(often)
    drop_table(goes)
    return parts, going


def _judged(streams: DataFrame, length: int, least: int) -> DataFrame:
    """host, page, prose and `cut` of each distinct page of a host from which tokens go."""
    parts, going = _runs(streams, length, least)
    by = lambda df: df.groupBy("host", "part")
    found = by(parts).cogroup(by(going)).applyInPandas(lambda key, p, r: _cuts(key, p, r, length), "host long, page long, prose array<int>, cut array<int>")
    cuts = table(found, "cuts")
    drop_table(parts)
    drop_table(going)
    return cuts


def _tally(key: tuple, streams: pd.DataFrame, runs: pd.DataFrame, length: int) -> pd.DataFrame:
    tokens, page, state = _tokens(streams)
    starts, names = _starts(key[0], tokens, page, length)
    gone = _covered(starts[np.isin(names, runs["run"].to_numpy(np.int64))], len(tokens), length)
    return pd.DataFrame({"state": np.arange(4), "tokens": np.bincount(state, minlength=4), "repeated": np.bincount(state[gone], minlength=4)})


def array_report(pages: DataFrame, length: int = LENGTH, least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """What the hosts' arrays find, whatever the markup says: state (prose, open, out, named), tokens that the arrays read, and how many stand in runs that go."""
    source = pages.select(F.col("html").cast("string").alias("html"), F.xxhash64(host_of(F.col("url"))).alias("host"))
    kind = "`text` string, `page` long, `paragraphs` array<struct<at:int,hash:long,size:int>>, `pieces` array<struct<at:int,piece:string,state:int>>"
    rows = table(map_texts(source, "html", ["host"], kind, lambda texts: _parsed(texts, True)), "blocks")
    parts, going = _runs(_streams(rows, length, least, shard), length, least)
    by = lambda df: df.groupBy("host", "part")
    found = by(parts).cogroup(by(going)).applyInPandas(lambda key, p, r: _tally(key, p, r, length), "state int, tokens long, repeated long")
    name = F.element_at(F.array(*[F.lit(x) for x in ("prose", "open", "out", "named")]), F.col("state") + 1)
    return found.groupBy(name.alias("state")).agg(F.sum("tokens").alias("tokens"), F.sum("repeated").alias("repeated"))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parsed(texts: pa.Array, names: bool) -> dict:
    """Of each page: its text as the markup tells it, a hash of all blocks, its paragraphs (prose) and its other blocks. Without `names`, blocks named by classes are open."""
    out: dict[str, list] = {"text": [], "page": [], "paragraphs": [], "pieces": []}
    for html in texts.to_pylist():
        blocks = blocks_of(html or "")
        if not names:
            blocks = [(t, OPEN if state == NAMED else state) for t, state in blocks]
        out["text"].append("\n".join(t for t, state in blocks if state in (PROSE, OPEN)))
        out["page"].append(_hash("\n".join(f"{state}{t}" for t, state in blocks)))
        out["paragraphs"].append([{"at": i, "hash": _hash(t), "size": len(t)} for i, (t, state) in enumerate(blocks) if state == PROSE])
        out["pieces"].append([{"at": i, "piece": t, "state": state} for i, (t, state) in enumerate(blocks) if state != PROSE])
    return out
