"""Pseudonyms, main text, line dedup, decontamination: round trips, brute force, odd rows."""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peoplelens.llm import decontaminate, html_text, line_dedup, pseudonyms, queries

SF = "/root/testdata/sf0.01"
KEY = b"0123456789abcdef"


# Pseudonyms

@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_one_to_one_and_turns_back(size):
    image = [pseudonyms.permute(i, size, KEY, "t") for i in range(size)]
    assert sorted(image) == list(range(size))
    assert [pseudonyms.permute(v, size, KEY, "t", back=True) for v in image] == list(range(size))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10 ** 15 - 1), st.integers(0, 73048), st.integers(0, 2 ** 32 - 1), st.integers(0, 898 * 99 * 9999 - 1))
def test_values_keep_format_and_turn_back(number, day, address, rank):
    from datetime import date

    body = f"{number:015d}"
    when = date.fromordinal(pseudonyms.FIRST_DAY + day)
    rest, serial = divmod(rank, 9999)
    area, group = divmod(rest, 99)
    values = [("card", body + str(pseudonyms.luhn(body))), ("date", when.isoformat()), ("date", f"{when.month}/{when.day}/{when.year}"),
              ("date", f"{when.day:02d}.{when.month:02d}.{when.year}"), ("ipv4", ".".join(map(str, address.to_bytes(4, "big")))),
              ("ssn", f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"), ("phone", f"+1 ({body[:3]}) {body[3:6]}-{body[6:10]}")]
    for kind, value in values:
        new = pseudonyms.pseudonym(kind, value, KEY)
        assert re.fullmatch(pseudonyms.PATTERNS[kind], new), (kind, value, new)
        assert pseudonyms.pseudonym(kind, new, KEY, back=True) == value


def test_texts_turn_back_and_equal_values_stay_linked():
    text = ("call +1 (736) 555-2678 or 4035 0659 4308 8454, 4035065943088454; 43.105.121.42 orlpo.98@mail6.example.com on 2024-02-29 "
            "3/14/2021 3.4.1999 078-05-1120 GB82 WEST 1234 5698 7654 32 (030) 901-8200")
    new, counts = pseudonyms.pseudonymise(text, KEY)
    assert counts == {"email": 1, "iban": 1, "ipv4": 1, "date": 3, "ssn": 1, "phone": 2, "card": 2}
    assert set(re.findall(r"\S*\d\S*", text)) & set(re.findall(r"\S*\d\S*", new)) == {"+1"}
    assert pseudonyms.pseudonymise(new, KEY, back=True) == (text, counts)
    again, _ = pseudonyms.pseudonymise("x 43.105.121.42", KEY)
    assert again.split()[1] in new
    assert pseudonyms.pseudonymise("x 43.105.121.42", b"another key 1234")[0] != again


def slow_pseudonymise(text):
    """All kinds by one pattern, tried at every place."""
    every, single = re.compile("|".join(f"(?P<{k}>{pseudonyms.PATTERNS[k]})" for k in pseudonyms.KINDS)), pseudonyms.PATTERNS
    counts, out, at, done = dict.fromkeys(pseudonyms.KINDS, 0), "", 0, 0
    while m := every.search(text, at):
        at = m.start() + 1
        for kind in pseudonyms.KINDS[pseudonyms.KINDS.index(m.lastgroup):]:
            found = re.compile(single[kind]).match(text, m.start())
            new = pseudonyms.pseudonym(kind, found[0], KEY) if found else None
            if new is not None:
                out, done, at = out + text[done:m.start()] + new, found.end(), found.end()
                counts[kind] += 1
                break
    return out + text[done:], counts


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "%", "@", "@x.com", ".", "-", "+", "_", " ", "1.2.3.4", "2024-02-29", "9", "555-12", "\u00e9", "x.org", "078-05-1120"]), max_size=14))
def test_finding_values_equals_one_pattern_at_every_place(parts):
    text = "".join(parts)
    assert pseudonyms.pseudonymise(text, KEY) == slow_pseudonymise(text)


def test_a_megabyte_of_one_token():
    for token in ("%20ab", "a@b", "a%@", "@", "1.", "12-", "a.b+"):
        text = token * (1_000_000 // len(token))
        assert pseudonyms.pseudonymise(text, KEY)[0] and pseudonyms.pseudonymise(text + " x%y@mail.example.com", KEY)[1]["email"] >= 1


def test_what_is_no_value_stays():
    text = "version 4.0. 300.1.1.1 1.2.3.4.5 4035065943088455 2023-02-30 000-12-3456 GB00 WEST 1234 5698 7654 32 a@b 12 345 3.14 1999"
    assert pseudonyms.pseudonymise(text, KEY) == (text, dict.fromkeys(pseudonyms.KINDS, 0))


def test_op2_leaves_the_rest_alone_and_turns_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    there = {r.doc_id: r for r in queries.op2_pseudonyms(spark, SF).collect()}
    back = pseudonyms.pseudonymise_documents(spark.createDataFrame(list(there.values())), queries.EXAMPLE_KEY, back=True)
    original = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in back.collect()} == original
    changed = [d for d, r in there.items() if r.text != original[d]]
    assert changed and all(there[d].n_values > 0 for d in changed)
    phones = re.compile(r"\+1 \(\d{3}\) 555-\d{4}")
    assert not {p for d in changed for p in phones.findall(original[d])} & {p for d in changed for p in phones.findall(there[d].text)}


def test_pseudonyms_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", None), (2, "", None), (None, "1.2.3.4", 1), (3, "a " * 200_000 + "9.9.9.9", 2)],
                                 "doc_id long, text string, n_values int")
    got = pseudonyms.pseudonymise_documents(docs, KEY).collect()
    assert Counter((r.doc_id, r.n_values) for r in got) == Counter([(1, 0), (2, 0), (2, 0), (None, 1), (3, 1)])
    assert {r.doc_id: r.text for r in got}[1] is None
    assert pseudonyms.pseudonymise_documents(docs.limit(0), KEY).isEmpty()
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise_documents(docs, b"short")


# Main text

def test_op4_against_the_article_element(spark):
    got = {r.page_id: r for r in queries.op4_main_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", p.html, re.DOTALL)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def texts(page):
    found = html_text.read_page(page)
    return [t for t, kind in zip(found[0], found[2]) if kind != html_text.NOISE]


def test_reading_a_page():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>if (a<b) "</p>";</script></head><body class="has-sidebar">
    <header><h1>site</h1></header><nav><ul><li>menu<li>two</ul></nav><div id="cookie-notice">we use</div><aside>side</aside>
    <form><label>mail</label><input name=q><button>go</button></form>
    <article class="post"><header><h1>A &amp; B</h1><p>by me</p></header><p>one<b> bold<i>x</i> <br>two</p>
    <p>three&nbsp;&lt;4&gt;<p>&#233;t&eacute; <span class="ad">buy</span> end<div class="ads"><p>advert</p></div><ul><li>i<li>ii</ul>
    <!-- <p>hidden</p> --><section class="comments"><p>first!</p></section><footer>tags</footer></article>
    <footer>&copy; x</footer><div class="comment">hm</div><p>cut <b"""
    assert texts(page) == ["A & B", "one boldx two", "three <4>", "été end", "i", "ii", "cut"]
    assert html_text.read_page(None)[0] == html_text.read_page("")[0] == html_text.read_page("<p></p><!-- x")[0] == []
    assert texts("a < b <p>c<3</p></x>") == ["a < b", "c<3"]
    assert texts("plain") == ["plain"]


def test_style_tree_removes_what_a_host_repeats(spark):
    rng = random.Random(4)
    def words(n):
        return " ".join(str(rng.randrange(10 ** 6)) for _ in range(n))
    pages = [(i, f"http://a.example/{i}", f"<div class=x1>Subscribe now</div><div class=x2><p>{words(9)}</p><p>{words(9)}</p></div>"
              f"<div class=x3>{('red', 'blue')[i % 2]}</div>") for i in range(30)]
    pages += [(100, "http://b.example/1", "<div class=x1>Subscribe now</div><p>own</p>"), (101, None, None), (102, "odd", "")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit(1), "low": F.lit(2), "text": F.lit("")})
    got = {r.page_id: r for r in html_text.main_text(table).collect()}
    for i, _, page in pages[:30]:
        assert got[i].text == " ".join(re.findall(r"<p>(.*?)</p>", page)) and got[i].n_removed == 2
    assert got[100].text == "Subscribe now own"
    assert got[101].text == got[102].text == "" and got[101].n_chars == 0
    assert html_text.main_text(table.limit(0)).isEmpty()


def test_importance_is_the_entropy_of_styles_and_texts(spark):
    from math import log

    rows = [("<ul><li>a</li></ul>" if i < 3 else "<ul><li>b</li><p>c</p></ul>") for i in range(4)]
    table = spark.createDataFrame([(i, "http://h/x", r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.path: r for r in html_text.importance(html_text.different(html_text.read_pages(table))).collect()}
    item = got[html_text.node("/ul/li")]
    assert item.pages == 2 and item.content == pytest.approx(1 - (log(1, 2) + 0) / 2) and item.importance == pytest.approx(item.content)
    assert got[html_text.node("/ul/p")].importance == 1.0


def slow_main_text(pages):
    """The tree by plain dictionaries: statistics over the different pages of a host, then verdicts text by text."""
    from math import log, log2
    from urllib.parse import urlsplit

    read, hosts = [], defaultdict(dict)
    for i, url, page in pages:
        found = html_text.read_page(page)
        host = (urlsplit(url or "").hostname or "") if "://" in (url or "") else ""
        read.append((i, host, found))
        own = tuple((t, p) for t, p, kind in zip(*found[:3]) if kind != html_text.NOISE)
        hosts[host].setdefault(own, found)
    verdict = {}
    for host, different in hosts.items():
        stands, has, styles = defaultdict(set), defaultdict(set), defaultdict(set)
        for own, (texts, paths, _, nodes, shapes) in different.items():
            for text, path in zip(texts, paths):
                stands[path, text].add(own)
                has[path].add(own)
            for path, shape in zip(nodes, shapes):
                styles[path, shape].add(own)
        for path, with_it in has.items():
            m, k = len(with_it), [len(v) for (p, _), v in stands.items() if p == path]
            n = [len(v) for (p, _), v in styles.items() if p == path]
            if m < html_text.MIN_PAGES:
                verdict.update({(host, p, t): "rare" for p, t in stands if p == path})
                continue
            content = 1 - sum(log(x) for x in k) / len(k) / log(m)
            presentation = min(1.0, -sum(x / sum(n) * log(x / sum(n)) for x in n) / log(m)) if n else 0.0
            share = html_text.DECAY ** len(n)
            node_low = (1 - share) * presentation + share * content < html_text.THRESHOLD
            verdict.update({(host, p, t): "low" for (p, t), v in stands.items() if p == path and (node_low or log2(m / len(v)) < html_text.MIN_BITS)})
    out = Counter()
    for i, host, (texts, paths, kinds, *_) in read:
        left = [(t, kind, verdict.get((host, p, t))) for t, p, kind in zip(texts, paths, kinds) if kind != html_text.NOISE]
        left = [x for x in left if x[2] != "low"]
        inside = sum(len(t) for t, kind, _ in left if kind > html_text.ARTICLE)
        beside = [t for t, kind, v in left if v == "rare" and kind == html_text.NORMAL]
        drop = inside > 0 and inside >= sum(map(len, beside))
        out[i, " ".join(t for t, kind, v in left if not (drop and v == "rare" and kind == html_text.NORMAL))] += 1
    return out


def planted_pages():
    """A large host whose articles repeat a notice, with text beside a teaser; copies of one article; hosts of one page."""
    rng = random.Random(12)
    def words(n):
        return " ".join(str(rng.randrange(10 ** 6)) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        body, more = words(12), words(9)
        rows.append((i, f"http://big.example/{i}", f"<p>Big news</p><article><h1>{body}</h1><p>Join our club</p><p>{more}</p></article>"
                     f"<div class=story><p>{body}</p><p>{more}</p></div><div class=ad>{words(5)}</div><p class=fine>{('a', 'b')[i % 2]}</p>"))
        want[i] = f"{body} {more} {body} {more}"
    page = f"<h2>Copied</h2><article><p>{words(9)}</p><p>{words(9)}</p></article>"
    for i in range(100, 130):
        rows.append((i, f"https://copies.example/{i}", f"{page}<nav>{words(3)}</nav>"))
        want[i] = re.sub(r"<[^>]*>", " ", page.removeprefix("<h2>Copied</h2>"))
    story = words(20)
    rows.append((200, "http://one.example", f"<article class=teaser><p>Teaser card</p></article><div class=story><p>{story}</p></div>"))
    want[200] = "Teaser card " + story
    rows.append((201, "http://two.example", f"<p>skip</p><article><p>{story}</p></article>"))
    want[201] = story
    return rows, {i: " ".join(t.split()) for i, t in want.items()}


def test_tree_judges_texts_in_and_outside_articles(spark):
    rows, want = planted_pages()
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.main_text(table).collect()
    assert {r.page_id: r.text for r in got} == want
    assert Counter((r.page_id, r.text) for r in got) == slow_main_text(rows)
    twice = html_text.main_text(table.union(table)).collect()
    assert Counter((r.page_id, r.text) for r in twice) == Counter({k: 2 for k in slow_main_text(rows)})


def test_op4_against_the_tree_by_dictionaries(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert Counter((r.page_id, r.text) for r in queries.op4_main_text(spark, SF).collect()) == slow_main_text(pages)


@pytest.mark.parametrize("tag", ["div", "span", "p", "li", "x-y"])
def test_a_megabyte_of_nested_elements(tag):
    deep = 1_000_000 // (len(tag) + 2)
    found = html_text.read_page(f"<{tag}>" * deep + "deep" + f"</{tag}>" * deep + "</b>" * 1000 + "end")
    assert " ".join(found[0]).split() in (["deep", "end"], ["deepend"])
    assert html_text.read_page(f"<{tag}>a" * 20_000 + "</i>" * 20_000)[0]


# Line dedup

def slow_dedup(rows, ratio=line_dedup.RATIO, least=line_dedup.MIN_PAGES):
    pages, held = Counter(), Counter()
    for _, text, host in rows:
        pages[host or ""] += 1
        held.update({(host or "", x.strip(" ")) for x in (text or "").split("\n") if x.strip(" ")})
    out = []
    for i, text, host in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        bad = {x for h, x in held if h == (host or "") and held[h, x] >= least and held[h, x] > ratio * pages[h]}
        lines = text.split("\n")
        kept = [x for x in lines if x.strip(" ") not in bad]
        total = sum(bool(x.strip(" ")) for x in lines)
        if len(kept) < len(lines) and any(x.strip(" ") for x in kept):
            out.append((i, "\n".join(kept), total, len(lines) - len(kept)))
        else:
            out.append((i, text, total, 0))
    return out


def dedup(table, **options):
    return [(r.row.doc_id, r.text, r.lines_total, r.lines_dropped) for r in line_dedup.drop_lines(table, **options).collect()]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join([*(["Menu "] if rng.random() < 0.4 else []), f"own {i}", *(["rare"] if i % 40 == 0 else []), "", "own too" * (i % 3)]),
             rng.choice(["hot"] * 3 + ["b", None])) for i in range(400)]
    rows += [(1000 + i, "Menu\nFooter", "hot") for i in range(60)] + [(2000, None, "hot"), (2001, "", "hot"), (2002, "x", None), (2002, "x", None)]
    rows += [(3000, "long " * 100_000 + "\nMenu", "hot")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {"host": F.lit(1), "keys": F.lit(2), "kept": F.lit(3), "total": F.lit(4), "lines_total": F.lit(5)})
    assert Counter(dedup(table)) == Counter(slow_dedup(rows))
    assert dedup(table.limit(0)) == []


# Decontamination

def slow_overlaps(docs, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    width = decontaminate.STRETCH
    classes = {}
    for i, t in items:
        classes.setdefault(tuple(words(t)), []).append(i)
    out = {}
    for d, text in docs:
        a = words(text)
        for b, ids in classes.items():
            found = []
            for shift in range(-len(b), len(a)):
                start, at = max(shift, 0), max(-shift, 0)
                n = min(len(a) - start, len(b) - at)
                w = min(width, len(b))
                same = [a[start + k] == b[at + k] for k in range(n)]
                if n >= w > 0 and sum(same) and any(sum(same[k:k + w]) >= decontaminate.SHARE * w for k in range(n - w + 1)):
                    found.append((sum(same), -start, -at, n))
            if found:
                e, s, t, n = max(found)
                out[d, min(ids)] = (len(ids), -s, -t, n, e)
    return out


def test_overlaps_against_all_diagonals(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(50)]
    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text([6, 8, 12, 14, 20, 40][i % 6]))) for i in range(12)] + [(50, None), (51, ""), (60, "A-b c"), (61, "w1 w2")]
    items += [(70, items[3][1].upper() + "!"), (71, items[3][1])]
    docs = []
    for d in range(60):
        body = text(rng.randrange(0, 90))
        if d % 2:
            part = items[rng.randrange(12)][1].split()
            for _ in range(rng.randrange(2 + len(part) // 5)):
                part[rng.randrange(len(part))] = "edit"
            cut = rng.randrange(len(body) + 1)
            body[cut:cut] = part[rng.randrange(3):]
        docs.append((d, ", ".join(body)))
    docs += [(100, None), (101, ""), (102, "x " * 20_000 + items[3][1]), (103, "a, b. C")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"words": F.lit(1), "pos": F.lit(2), "seed": F.lit(3), "key": F.lit(4)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    want = slow_overlaps(docs, items)
    assert len(want) > 15 and {(103, 60)} <= want.keys()
    for rounds in (decontaminate.ROUND_SEEDS, 40):
        got = {(r.doc_id, r.item_id): (r["items"], r.doc_start, r.item_start, r.aligned, r.equal)
               for r in decontaminate.overlaps(table, bench, round_seeds=rounds).collect()}
        assert got == want
    clean = decontaminate.clean(table, bench)
    assert clean.columns == table.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, i in want if i not in (60, 61)}
    assert decontaminate.overlaps(table, bench.limit(0)).isEmpty() and decontaminate.overlaps(table.limit(0), bench).isEmpty()


def test_masks_hit_every_stretch_that_is_accepted():
    decontaminate.check_families(decontaminate.FAMILIES, decontaminate.STRETCH, decontaminate.SHARE)
    two = {**decontaminate.FAMILIES, 15: ("1110110111", "1101111011")}
    for families, stretch, share in ((two, 15, 0.8), (decontaminate.FAMILIES, 15, 0.7), ({5: ("1",)}, 15, 0.8)):
        with pytest.raises(ValueError):
            decontaminate.check_families(families, stretch, share)


def test_long_items_are_compared_once_for_each_diagonal(spark):
    rng = random.Random(11)
    item = [f"w{rng.randrange(5000)}" for _ in range(50_000)]
    edited = [w if rng.random() > 0.15 else "edit" for w in item]
    docs = spark.createDataFrame([(1, " ".join(["lead"] * 7 + edited)), (2, " ".join(item[::-1])), (3, " ".join(edited[40_000:]))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.doc_start, r.item_start, r.aligned, r.equal) for r in decontaminate.overlaps(docs, bench, round_seeds=60_000).collect()}
    same = [a == b for a, b in zip(item, edited)]
    assert got == {1: (7, 0, 50_000, sum(same)), 3: (0, 40_000, 10_000, sum(same[40_000:]))}


def test_native_operators_run_no_python(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    for frame in (decontaminate.overlaps(docs, bench), line_dedup.drop_lines(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
