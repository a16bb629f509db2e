"""Data of web pages, by deducing the template that the pages of a host share.

A page is a sequence of tokens: tags, comments and words, each told apart by the path of block elements that it stands in. Tokens
of a host that occur equally often on every page, whose occurrence vectors over the pages are the same, form an equivalence class. Classes of
enough tokens on enough pages are valid if their tokens stand in one order on all pages and the repetitions of any two classes are
apart or nested in one gap. The valid ones, nested, are the template; the text in the gaps between their tokens is the data.

Enough pages are PAGES for a class that holds a tag, so that a layout is found however small a part of its host it is. A class
without one must be on a share of the host's pages, too: fewer pages that have words in common are as well copies of a passage, which is data.

Occurrence vectors are never gathered: a vector is known by its number of pages and the sum of a hash of each page and count. Tags are
counted exactly. Of the other tokens only those are that are frequent in some batch, for what is frequent among all pages is frequent
in a batch at least, or that have the vector of a tag, for what has it over all pages has it in each batch.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import Workspace, if_small
from quarry.llm.tokens import release, slices

#: Tokens of a class, pages that it is on, and the part of its host's pages that a class without a tag is on, at least.
SIZE, PAGES, SUPPORT = 3, 4, 0.3
#: Pages of a host that are brought to one place.
TOGETHER = 500
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<[/!?]?[a-zA-Z][^<>]*>", re.S | re.I)
_TAG = re.compile(r"<([/!?]?)([a-zA-Z][^\s/>]*)")
_NAMED = re.compile(r"\b(class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "big", "cite", "code", "em", "font", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "tt", "u"}
_ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_MASK = (1 << 64) - 1
_known: dict[str, tuple[str, str, str]] = {}


def _tag(raw: str) -> tuple[str, str, str]:
    """Kind (/, ! or ? or nothing), name, and token of a tag: its name with class and id."""
    if raw not in _known:
        if len(_known) > 50_000:
            _known.clear()
        kind, name = _TAG.match(raw).groups()
        name = name.lower()
        more = "" if kind else "".join(f" {k.lower()}={v.strip('\"\'')}" for k, v in sorted(_NAMED.findall(raw)))
        _known[raw] = kind, name, f"<{kind}{name}{more}>"
    return _known[raw]


def events(page: str) -> Iterator[tuple[int, str, bool]]:
    """(path, token or text, whether it is a token) of a page, in order. The path is a hash of the open block elements."""
    stack: list[tuple[str, int]] = []
    path, at = 0, 0

    def down(name: str) -> int:
        return (path * 0x9E3779B97F4A7C15 + zlib.crc32(name.encode("utf-8", "replace")) + 1) & _MASK

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield path, page[at : m.start()], False
        at = m.end()
        raw = m.group()
        if raw.startswith("<!--"):
            yield path, raw, True
            continue
        raw_text = m.group(1)
        if raw_text:
            end = raw.index(">") + 1
            close = raw.rfind("</")
            name = raw_text.lower()
            yield path, f"<{name}>", True
            body = raw[end : close if close >= end else len(raw)]
            if body:
                yield down(name), body, True
            if close >= end:
                yield path, f"</{name}>", True
            continue
        kind, name, token = _tag(raw)
        if kind == "/":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    path = stack[k][1]
                    del stack[k:]
                    break
            yield path, token, True
            continue
        if not kind and name in _ENDS and stack and stack[-1][0] in _ENDS[name]:
            path = stack.pop()[1]
        yield path, token, True
        if not kind and name not in _VOID and name not in _INLINE and not raw.endswith("/>"):
            stack.append((name, path))
            path = down(name)
    if at < len(page):
        yield path, page[at:], False


def words_of(page: str) -> tuple[Counter, dict[int, list[str]]]:
    """Tags and comments of a page, as (path, token) with their number, and the words that stand in each path."""
    whole: list[tuple[int, str]] = []
    words: dict[int, list[str]] = {}
    for path, token, one in events(page):
        if one:
            whole.append((path, token))
        elif path in words:
            words[path] += token.split()
        else:
            words[path] = token.split()
    return Counter(whole), words


def _scramble(x: int) -> int:
    x &= _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def _signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def _is_tag(token: str) -> bool:
    """Whether a token that is no word is a tag, not a comment or the body of a script."""
    return token.startswith("<") and not token.startswith("<!--")


def _candidates(pages: DataFrame) -> DataFrame:
    """(host, path, token) that can be in a class. Pages of a host are brought together, those of a host with many in several places."""
    counts = pages.groupBy("host").agg(F.count("*").alias("of")).where(F.col("of") >= PAGES)
    placed = pages.join(if_small(counts), "host").withColumn("part", F.pmod("uid", F.ceil(F.col("of") / TOGETHER)))
    together = placed.select("host", "part", "of", "uid", "html").hint("rebalance", F.col("host"), F.col("part")).sortWithinPartitions("host", "part")
    half = (1 << 48) - 1

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html", 8 << 20):
                # of each role the number of pages and the two sums of its vector here, in one number
                tags: dict[str, dict[tuple[int, str], int]] = {}
                words: dict[str, dict[int, dict[str, int]]] = {}
                pages_: Counter = Counter()
                of: dict[str, int] = {}
                for host, page, uid, n in zip(*(part.column(c).to_pylist() for c in ("host", "html", "uid", "of"))):
                    whole, texts = words_of(page)
                    own, rest, marks = tags.setdefault(host, {}), words.setdefault(host, {}), {}

                    def mark(k: int) -> int:
                        if k not in marks:
                            h = _scramble(uid + k * 0x9E3779B97F4A7C15)
                            marks[k] = 1 << 96 | h >> 33 << 48 | h & 0x7FFFFFFF
                        return marks[k]

                    for (path, token), k in whole.items():
                        if _is_tag(token):
                            own[(path, token)] = own.get((path, token), 0) + mark(k)
                        else:
                            some = rest.setdefault(path, {})
                            some[token] = some.get(token, 0) + mark(k)
                    for path, found in texts.items():
                        some = rest.setdefault(path, {})
                        for token, k in Counter(found).items():
                            some[token] = some.get(token, 0) + mark(k)
                    pages_[host] += 1
                    of[host] = n
                rows = []
                for host, n in pages_.items():
                    # a host that is here as a whole needs no other batch to tell which tags are on enough pages
                    here = {role: x for role, x in tags[host].items() if n < of[host] or x >> 96 >= PAGES}
                    vectors, least = set(here.values()), SUPPORT * n
                    rows += [(host, _signed(path), token, True, x >> 96 >= least, x) for (path, token), x in here.items()]
                    for path, some in words[host].items():
                        rows += [(host, _signed(path), token, False, x >> 96 >= least, x) for token, x in some.items() if x >> 96 >= least or x in vectors]
                hosts, paths, tokens, tag, often, x = zip(*rows) if rows else [()] * 6
                sums = (pa.array([y >> shift & half for y in x], pa.int64()) for shift in (96, 48, 0))
                columns = [pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(tokens, pa.string()), pa.array(tag, pa.bool_()), pa.array(often, pa.bool_()), *sums]
                yield pa.RecordBatch.from_arrays(columns, ["host", "path", "token", "tag", "often", "pages", "high", "low"])

    rows = together.select("host", "html", "uid", "of").mapInArrow(run, "host string, path long, token string, tag boolean, often boolean, pages long, high long, low long")
    roles = rows.groupBy("host", "path", "token").agg(F.max("tag").alias("tag"), F.max("often").alias("often"), *(F.sum(c).alias(c) for c in ("pages", "high", "low")))
    # sums are whole for tags and for what has the vector of a tag; others, partly summed, can only make a group seem larger here
    alike = Window.partitionBy("host", "pages", "high", "low")
    seen = roles.withColumn("tags", F.max("tag").over(alike)).withColumn("size", F.count("*").over(alike))
    return seen.where(F.expr(f"often or tags and size >= {SIZE} and pages >= {PAGES}")).select("host", "path", "token")


def _with(pages: DataFrame, packed: DataFrame) -> DataFrame:
    """Pages with what is known of their host; hosts of which nothing is known drop out."""
    return pages.join(if_small(packed), "host")


def _vectors(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(host, path, token, tag, pages, vector): whether a role is a tag, on how many pages it is, and the sums that stand for its occurrence vector."""
    packed = candidates.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "token"))).alias("roles"))

    def run(batches):
        for batch in batches:
            totals: dict[str, dict[int, dict[str, list[int]]]] = {}
            marked: dict[str, set[tuple[int, str]]] = {}
            column = batch.column("roles")
            for k, (host, page, uid) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("uid").to_pylist())):
                if host not in totals:
                    known: dict[int, dict[str, list[int]]] = {}
                    for r in column[k].as_py():
                        known.setdefault(r["path"] & _MASK, {})[r["token"]] = [0, 0, 0]
                    totals[host], marked[host] = known, set()
                own = totals[host]
                tags, texts = words_of(page)
                counts: dict[int, Counter] = {path: Counter(words) for path, words in texts.items() if path in own}
                for (path, token), n in tags.items():
                    if path in own:
                        counts.setdefault(path, Counter())[token] += n
                        if _is_tag(token):
                            marked[host].add((path, token))
                for path, found in counts.items():
                    wanted = own[path]
                    for token in wanted.keys() & found.keys():
                        h = _scramble(uid + found[token] * 0x9E3779B97F4A7C15)
                        total = wanted[token]
                        total[0] += 1
                        total[1] += h >> 33
                        total[2] += h & 0x7FFFFFFF
            rows = [(host, _signed(path), token, (path, token) in marked[host], *sums) for host, own in totals.items() for path, wanted in own.items() for token, sums in wanted.items() if sums[0]]
            columns = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()))], ["host", "path", "token", "tag", "pages", "high", "low"])
            release()

    rows = _with(pages.select("host", "html", "uid"), packed).mapInArrow(run, "host string, path long, token string, tag boolean, pages long, high long, low long")
    # each part has 31 bits, so that the sums of two thousand million pages fit
    return rows.groupBy("host", "path", "token").agg(F.max("tag").alias("tag"), F.sum("pages").alias("pages"), F.struct(F.sum("high"), F.sum("low")).alias("vector"))


def _classes(pages: DataFrame, vectors: DataFrame) -> DataFrame:
    """(host, class, path, token): tokens of the classes that are large and frequent enough, numbered in a host by falling number of pages."""
    count = pages.groupBy("host").agg(F.count("*").alias("of")).where(F.col("of") >= PAGES)
    frequent = vectors.join(if_small(count), "host").where(F.col("pages") >= PAGES)
    own = Window.partitionBy("host", "pages", "vector")
    large = frequent.withColumn("size", F.count("*").over(own)).withColumn("tags", F.max("tag").over(own)).where((F.col("size") >= SIZE) & (F.col("tags") | (F.col("pages") >= SUPPORT * F.col("of"))))
    number = F.dense_rank().over(Window.partitionBy("host").orderBy(F.desc("pages"), F.desc("size"), "vector"))
    return large.select("host", number.alias("class"), "path", "token")


def occurrences(page: str, known: dict[tuple[int, str], int]) -> Iterator[tuple[int | None, str | None, int, str]]:
    """(class, text, path, token) in order: tokens of classes, for which text is None, and what stands between them, without a class."""
    paths = {path for path, _ in known}
    for path, token, whole in events(page):
        if whole:
            c = known.get((path, token))
            if c is not None:
                yield c, None, path, token
        elif path not in paths:
            yield None, token, path, ""
        else:
            rest: list[str] = []
            for word in token.split():
                c = known.get((path, word))
                if c is None:
                    rest.append(word)
                    continue
                if rest:
                    yield None, " ".join(rest), path, ""
                    rest = []
                yield c, None, path, word
            if rest:
                yield None, " ".join(rest), path, ""


def layout(page: str, known: dict[tuple[int, str], int]) -> tuple[dict[int, tuple | None], dict[tuple[int, int], int | None]]:
    """Of each class on a page the order of its tokens, None if they have none; of pairs of classes the gap of the first in which
    the second lies, -1 if they are apart, None if they cross or it lies now here, now there."""
    sequence: dict[int, list] = {}
    for at, (c, _, path, token) in enumerate(x for x in occurrences(page, known) if x[0] is not None):
        sequence.setdefault(c, []).append((at, (path, token)))
    size = Counter(known.values())
    orders: dict[int, tuple | None] = {}
    spans: dict[int, list[list[int]]] = {}
    for c, own in sequence.items():
        k = size[c]
        first = tuple(role for _, role in own[:k])
        fine = len(set(first)) == k and len(own) % k == 0 and all(own[i][1] == first[i % k] for i in range(len(own)))
        orders[c] = first if fine else None
        if fine:
            spans[c] = [[at for at, _ in own[i : i + k]] for i in range(0, len(own), k)]
    relations: dict[tuple[int, int], int | None] = {}
    for a, outer in spans.items():
        for b, inner in spans.items():
            if a == b:
                continue
            found, i = set(), 0
            for span in inner:
                while i < len(outer) and outer[i][-1] < span[0]:
                    i += 1
                if i == len(outer) or outer[i][0] > span[-1]:
                    found.add(-1)
                elif outer[i][0] < span[0] and outer[i][-1] > span[-1]:
                    gap = sum(x < span[0] for x in outer[i]) - 1
                    found.add(gap if gap == sum(x < span[-1] for x in outer[i]) - 1 else -2)
                elif span[0] < outer[i][0] and span[-1] > outer[i][-1]:
                    found.add(-1)  # seen from the other side
                else:
                    found.add(-2)
            relations[(a, b)] = found.pop() if len(found) == 1 and -2 not in found else None
    return orders, relations


def _known_of(rows: list[dict]) -> dict[tuple[int, str], int]:
    return {(r["path"] & _MASK, r["token"]): r["class"] for r in rows}


def _layouts(pages: DataFrame, packed: DataFrame) -> DataFrame:
    """(host, class, other, what): for a class the orders of its tokens that were seen, for two classes how the other lies in it."""

    def run(batches):
        for batch in batches:
            known: dict[str, dict] = {}
            found: set[tuple] = set()
            column = batch.column("roles")
            for k, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())):
                if host not in known:
                    known[host] = _known_of(column[k].as_py())
                orders, relations = layout(page, known[host])
                for c, order in orders.items():
                    found.add((host, c, None, "" if order is None else "\x00".join(f"{_signed(p)} {t}" for p, t in order)))
                for (a, b), gap in relations.items():
                    found.add((host, a, b, "" if gap is None else str(gap)))
            columns = zip(*sorted(found, key=str)) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()))], ["host", "class", "other", "what"])

    return _with(pages.select("host", "html"), packed).mapInArrow(run, "host string, class int, other int, what string").distinct()


def valid(rows: list[tuple[int, int | None, str]]) -> list[tuple[int, str]]:
    """The valid classes of a host with their order, taken one after another: each must be apart from or nested in every one taken before."""
    orders: dict[int, set[str]] = {}
    relations: dict[tuple[int, int], set[str]] = {}
    for c, other, what in rows:
        if other is None:
            orders.setdefault(c, set()).add(what)
        else:
            relations.setdefault((c, other), set()).add(what)
    taken: list[int] = []
    for c in sorted(orders):
        if len(orders[c]) == 1 and "" not in orders[c] and all(len(relations.get(p, ())) <= 1 and "" not in relations.get(p, ()) for d in taken for p in ((c, d), (d, c))):
            taken.append(c)
    return [(c, next(iter(orders[c]))) for c in taken]


def template(pages: DataFrame, work: Workspace) -> DataFrame:
    """(host, roles): for each host with a template its tokens: path, token, class, and place in the class."""
    candidates = work.store(_candidates(pages), "candidates")
    vectors = work.store(_vectors(pages, candidates), "vectors")
    classes = work.store(_classes(pages, vectors), "classes")
    packed = classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("class", "path", "token"))).alias("roles"))
    layouts = work.store(_layouts(pages, packed), "layouts")

    def run(batches):
        for batch in batches:
            out = []
            for rows in batch.column("rows").to_pylist():
                found = []
                for c, order in valid([(r["class"], r["other"], r["what"]) for r in rows]):
                    for place, role in enumerate(order.split("\x00")):
                        path, _, token = role.partition(" ")
                        found.append({"path": int(path), "token": token, "class": c, "place": place})
                out.append(found)
            kind = pa.list_(pa.struct([("path", pa.int64()), ("token", pa.string()), ("class", pa.int32()), ("place", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, kind)], ["host", "roles"])

    gathered = layouts.groupBy("host").agg(F.collect_list(F.struct("class", "other", "what")).alias("rows"))
    return work.store(gathered.mapInArrow(run, "host string, roles array<struct<path: long, token: string, class: int, place: int>>"), "template")


def fill(page: str, known: dict[tuple[int, str], tuple[int, int]], size: dict[int, int]) -> list[tuple[int | None, int | None, int | None, str]]:
    """(class, repeat, slot, text) of a page, in order; text outside of all classes has none of the three."""
    texts: dict[tuple, list[str]] = {}
    open_: list[tuple[int, int, int]] = []
    repeats: Counter = Counter()
    for c, text, path, token in occurrences(page, {r: c for r, (c, _) in known.items()}):
        if c is None:
            text = " ".join(entities.unescape(text).split())
            if text:
                texts.setdefault(open_[-1] if open_ else (None, None, None), []).append(text)
            continue
        place = known[(path, token)][1]
        while open_ and open_[-1][0] != c and any(x[0] == c for x in open_):
            open_.pop()
        if place == 0:
            open_.append((c, repeats[c], 0))
            repeats[c] += 1
        elif open_ and open_[-1][0] == c:
            open_[-1] = (*open_[-1][:2], place)
        if place == size[c] - 1 and open_ and open_[-1][0] == c:
            open_.pop()
    return [(*slot, " ".join(own)) for slot, own in texts.items()]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, class, repeat, slot, text): the text of every slot of every page; slot is the token of the class after which it stands.

    Text outside of the template has no class, repeat and slot; so has all text of pages whose host has fewer than PAGES pages or no valid
    class, and of pages with a null url or one without a host. Null and empty pages, and pages without text, have no row. Rows that
    repeat a page are pages of their own; a null id stays null. An empty table gives no row. Other columns aren't looked at.
    """
    work = Workspace(pages.sparkSession, "template")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), F.xxhash64(url_col, html_col).alias("uid"), F.col(html_col).alias("html")).where("html is not null")
    known = template(rows.where("host <> ''"), work)

    def run(batches):
        for batch in batches:
            cache: dict[str, tuple] = {}
            for part in slices(batch, "html", 4 << 20):
                column, out = part.column("roles"), []
                for k, (id_, host, page) in enumerate(zip(part.column("id").to_pylist(), part.column("host").to_pylist(), part.column("html").to_pylist())):
                    if host not in cache:
                        found = column[k].as_py() or []
                        cache[host] = {(r["path"] & _MASK, r["token"]): (r["class"], r["place"]) for r in found}, Counter(r["class"] for r in found)
                    out += [(id_, host, *slot) for slot in fill(page, *cache[host])]
                columns = zip(*out) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], [id_col, "host", "class", "repeat", "slot", "text"])

    joined = rows.select("id", "host", "html").join(if_small(known), "host", "left")
    return joined.select("id", "host", "html", "roles").mapInArrow(run, f"`{id_col}` long, host string, class int, repeat int, slot int, text string")
